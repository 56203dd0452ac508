"""Every registered query against its SQL, over the smallest data set, and the shape of its plan."""

import contextlib
import io
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from opporta.catalog import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio"):
        return None if math.isnan(float(value)) else round(float(value), 6)
    return value


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    expected_columns, expected = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(df.columns) == sorted(expected_columns)
    assert counted(df.columns, [tuple(r) for r in df.collect()]) == counted(expected_columns, expected)


@pytest.mark.parametrize("name", ["keyword_matches", "keyword_matches_large_registry", "grounded_records", "item_triage", "dedup_url_feed",
                                  "sync_missing", "lead_upsert", "profile_ingest", "search_results", "section_links", "source_overview", "org_resolution", "top_per_keyword"])
def test_plan_has_no_pairwise_join(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES[name](spark, SF).explain()
    assert "CartesianProduct" not in out.getvalue() and "BroadcastNestedLoopJoin" not in out.getvalue()


def test_scan_reads_only_what_is_needed(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        QUERIES["leads_by_source"](spark, SF).explain()
    plan = out.getvalue()
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
