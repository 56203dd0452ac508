"""Operators that have no SQL counterpart of their own."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opporta.operators import documents, feeds, links, match, profiles, repair, requests, resolve, responses, walk
from opporta.plans import search
from opporta.sources import readers, tables


def ts(*parts):
    return F.lit(dt.datetime(*parts)).cast("timestamp_ntz")


def test_write_raw_documents(spark, tmp_path):
    raw = spark.createDataFrame([(f"https://a.vn/{i}", "a" if i % 3 else "b", dt.datetime(2026, 8, 1 + i % 2), "<p>") for i in range(20)],
                                "url STRING, source_id STRING, fetched_at TIMESTAMP_NTZ, html STRING")
    documents.write_raw_documents(raw, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.count() == 20 and {r.source_id for r in back.select("source_id").distinct().collect()} == {"a", "b"}
    assert readers.raw_documents(spark, str(tmp_path / "raw")).where("url IS NOT NULL").count() == 20


def test_pdf_links(spark):
    html = "<a href='/a.pdf?x=1'>a</a><a href='https://other.vn/b.pdf'>b</a><a href='c.PDF'>c</a>"
    raw = spark.createDataFrame([("https://www.a.vn/x", "s", html)], "url STRING, source_id STRING, html STRING")
    got = {r.target_url for r in links.pdf_links(links.page_links(raw)).collect()}
    assert got == {"https://www.a.vn/a.pdf?x=1", "https://www.a.vn/c.PDF"}


def test_keyword_bypass(spark):
    df = spark.createDataFrame([(1, "generic", False), (2, "specialized", True), (3, "specialized", False)], "id INT, adapter_mode STRING, is_keyword_feed BOOLEAN").withColumns({
        "matched_keywords": F.array(F.lit("k")), "matched_groups": F.array(F.lit("g")), "is_relevant": F.lit(False)})
    got = {r.id: r for r in match.bypass_keywords(df, ["a", "b"]).collect()}
    assert (got[1].matched_keywords, got[1].matched_groups, got[1].is_relevant) == ([], [match.CUSTOM_CATEGORY], True)
    assert (got[2].matched_keywords, got[2].matched_groups) == (["a", "b"], [match.FEED_CATEGORY])
    assert (got[3].matched_keywords, got[3].is_relevant) == (["k"], False)


def test_search_windows(spark):
    now = ts(2026, 8, 23)
    got = spark.range(1).select(*[feeds.posted_limit(F.timestamp_add("DAY", F.lit(-d), now), now) for d in (1, 7, 30, 90)]).first()
    assert list(got) == ["24h", "week", "month", "year"]


def test_search_query_answers(spark):
    df = spark.createDataFrame([("d", "query", '```json\n{"queries": [" ", " website  ABC ", "second"]}\n```')], "doc_url STRING, kind STRING, body STRING")
    assert responses.search_queries(df).first().query == "website ABC"


def test_enrichment_plan(spark):
    df = spark.createDataFrame([(1, "ABC", "https://abc.vn/about?utm_source=x"), (2, "ABC", "https://www.google.com/x"), (3, " ", "https://abc.vn"), (4, "ABC", None), (5, "ABC", "http://10.0.0.1/")],
                               "id INT, organization_name STRING, organization_website STRING")
    got = {r.id: (r.enrichment, r.official_url) for r in profiles.enrichment_plan(df).collect()}
    assert got == {1: ("SITE", "https://abc.vn/"), 2: ("SEARCH", None), 3: ("ORGANIZATION_NOT_IDENTIFIED", None), 4: ("SEARCH", None), 5: ("SEARCH", None)}


def test_requests(spark):
    items = spark.createDataFrame([("d", "src", "T", "body", ["AI", " "])], "doc_url STRING, source_id STRING, title STRING, raw_content STRING, matched_keywords ARRAY<STRING>")
    text = requests.extraction_requests(items).first().request
    assert "- Keyword khớp: AI" in text and text.endswith("- Nội dung gốc:\nbody")
    orgs = spark.createDataFrame([("d", "ABC", None, None, None, None, None, None)], """doc_url STRING, organization_name STRING, organization_type STRING, organization_tax_code STRING,
        official_url STRING, context STRING, supplement STRING, location STRING""")
    assert "(không có website chính thức)" in requests.profile_requests(orgs).first().request
    assert "Tổ chức: ABC" in requests.query_requests(orgs).first().request
    with pytest.raises(ValueError):
        requests.checked_template("short")
    cut = spark.range(1).select(requests.evidence_lines(F.array(*[F.lit("x" * 501)] * 12)).alias("e")).first().e.split("\n")
    assert len(cut) == 10 and cut[0] == "- " + "x" * 500 + "..."


def test_children_are_replaced(spark):
    orgs = spark.createDataFrame([("o1", dt.datetime(2026, 1, 1), [("An", "CEO", "https://a.vn"), ("An", "CEO", "https://a.vn"), ("Bình", None, "https://a.vn")])],
                                 "organization_id STRING, verified_at TIMESTAMP_NTZ, contacts ARRAY<STRUCT<full_name: STRING, raw_title: STRING, source_url: STRING>>")
    fresh = resolve.contact_rows(orgs)
    assert fresh.count() == 2 and all(len(r.id) == 36 for r in fresh.collect())
    stored = spark.createDataFrame([("x", "o1", "Old"), ("y", "o2", "Stay")], "id STRING, organization_id STRING, full_name STRING")
    assert sorted(r.full_name for r in resolve.replace_children(stored, fresh, orgs).collect()) == ["An", "Bình", "Stay"]


def test_merge_compat_takes_the_last_mention(spark):
    df = spark.createDataFrame([("m1", "ABC", "a.vn", None, "IT", dt.datetime(2026, 1, 1)), ("m2", "ABC 2", "a.vn", None, None, dt.datetime(2026, 1, 2)), ("m3", "abc", None, None, "X", dt.datetime(2025, 1, 1))],
                               "mention_id STRING, legal_name STRING, domain STRING, tax_code STRING, industry STRING, verified_at TIMESTAMP_NTZ")
    found = resolve.resolve(df)
    assert {r.component for r in found.collect()} == {"d:a.vn"}
    assert [r.industry for r in resolve.merge_organizations(found, ["industry"]).collect()] == ["IT"]
    assert [r.industry for r in resolve.merge_organizations(found, ["industry"], compat=True).collect()] == [None]


def test_apply_repair(spark):
    df = spark.createDataFrame([("1", "s1", "T", None, dt.datetime(2026, 1, 1, 0, 0, 0, 5), None), ("2", "s2", "T", "Org", None, None)],
                               "id STRING, raw_content_ref STRING, title STRING, organization_name STRING, published_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ")
    parsed = spark.createDataFrame([("s1", "Bộ X: ban hành", "Tin", None)], "raw_content_ref STRING, parsed_title STRING, parsed_content STRING, parsed_published_at TIMESTAMP_NTZ")
    report = repair.repair_report(df, parsed)
    totals = repair.report_totals(report).first()
    assert (totals.scanned, totals.changed, totals.skipped) == (2, 1, 1)
    fixed = {r.id: r for r in repair.apply_repair(df, report, ts(2026, 2, 1)).collect()}
    assert fixed["1"].published_at is None and fixed["1"].organization_name == "Bộ X" and fixed["2"].organization_name == "Org"


def test_collections_come_back(spark):
    orgs = spark.createDataFrame([("o",)], "id STRING")
    cells = spark.createDataFrame([("o", "projects", 2, '{"name":"B"}'), ("o", "projects", 1, '{"name":"A","summary":"s"}'), ("gone", "projects", 1, "{}"), ("o", "news", 3, "")],
                                  "organization_id STRING, kind STRING, position INT, payload STRING").withColumns({
        "title": F.lit("N"), "summary": F.lit(None).cast("string"), "published_at": F.lit("2026"), "source_url": F.lit("u")})
    row = tables.restored_collections(cells, orgs).first()
    assert [p.name for p in row.projects] == ["A", "B"] and row.news[0].title == "N" and row.jobs == []


def test_lead_detail(spark):
    leads = spark.createDataFrame([("1", "o"), ("2", "p")], "id STRING, organization_id STRING")
    orgs = spark.createDataFrame([("o", "ABC", "IT"), ("p", "X", "Read timed out")], "id STRING, legal_name STRING, industry STRING").withColumns(
        {c: F.lit(None).cast("string") for c in ("domain", "tax_code", "profile_status", "size", "employee_count", "official_url")})
    contacts = spark.createDataFrame([("c1", "o", 10), ("c2", "o", None), ("c3", "o", 90), ("c4", "p", 1)], "id STRING, organization_id STRING, decision_score INT")
    detail = search.lead_detail(leads, orgs, contacts, contacts.drop("decision_score"), "1")
    assert detail["lead"].first().industry == "IT" and [r.id for r in detail["contacts"].collect()] == ["c3", "c1", "c2"] and detail["evidence"].count() == 3


def test_search_wildcards(spark):
    df = spark.createDataFrame([("1", "a_b"), ("2", "axb"), ("3", "ĐẤU THẦU")], "id STRING, title STRING").withColumns(
        {c: F.lit(None).cast("string") for c in ("organization_name", "need_summary", "budget_text")}).withColumn("status", F.lit("NEW"))
    ids = lambda **kw: sorted(r.id for r in search.filter_leads(df, **kw).collect())
    assert ids(query="a_b") == ["1", "2"] and ids(query="a_b", escape=True) == ["1"] and ids(query="đấu") == ["3"]


def test_additive_schema(spark):
    df = readers.with_schema(spark.createDataFrame([("1", "9")], "id STRING, score STRING"), "id STRING, score INT, extra ARRAY<STRING>")
    assert df.first().score == 9 and df.first().extra is None


def test_model_answers_are_grounded_by_text(spark):
    body = json.dumps({"organization_website": "www.abc.vn"})
    made = responses.extractions(spark.createDataFrame([("d", "extraction", body), ("e", "extraction", json.dumps({"organization_website": "fake.vn"}))], "doc_url STRING, kind STRING, body STRING"))
    docs = spark.createDataFrame([("d", "xem ABC.vn/lien-he"), ("e", "xem abc.vn")], "doc_url STRING, raw_content STRING")
    got = {r.doc_url: r.organization_website for r in responses.grounded_website(made, docs).collect()}
    assert got == {"d": "https://www.abc.vn", "e": None}


def test_everything_else_imports_without_the_corpus_part(tmp_path):
    """A copy without the two folders: all queries but those of that part, and none of them."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') and n[2:3].isdigit() or n == 'pipeline']; print('FINE')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=200)
    assert "FINE" in done.stdout, done.stderr[-2000:]


def test_texts_nobody_asks_for_are_dropped_at_their_scan(spark, tmp_path):
    from opporta.operators import responses
    texts = spark.range(2000).selectExpr("'u' || id AS doc_url", "repeat('text of page a' || id || '.vn ', 50) AS raw_content")
    texts.write.parquet(f"{tmp_path}/texts")
    spark.range(2000).selectExpr("'u' || id AS doc_url", "CASE WHEN id % 500 = 7 THEN 'https://a' || id || '.vn/' WHEN id % 500 = 9 THEN 'https://other.vn' END AS organization_website").write.parquet(f"{tmp_path}/extracted")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        made = responses.grounded_website(spark.read.parquet(f"{tmp_path}/extracted"), spark.read.parquet(f"{tmp_path}/texts"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan
        assert sorted(r.organization_website for r in made.where("organization_website IS NOT NULL").collect()) == [f"https://a{k}.vn/" for k in (1007, 1507, 507, 7)]
        assert made.count() == 2000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_leads_of_a_page_fetched_twice_a_day(spark):
    df = spark.createDataFrame([("l1", "s/20260801/a.html", 1), ("l2", "s/20260801/a.html", 2), ("l3", "s/20260801/a.html", None), ("l4", "s/20260801/b.html", 1)], "id STRING, raw_content_ref STRING, fetch INT")
    stored = spark.createDataFrame([("s/20260801/a.html", 1, "one"), ("s/20260801/a.html", 2, "two"), ("s/20260801/a.html", None, "none")], "snapshot_path STRING, fetch INT, html STRING")
    got = sorted((r.id, r.html) for r in repair.snapshot_leads(df, stored, also=("fetch",)).collect())
    assert got == [("l1", "one"), ("l2", "two"), ("l3", "none")]
    plain = repair.snapshot_leads(df.drop("fetch"), stored.where("fetch = 1").drop("fetch"))
    assert sorted(plain.columns) == ["html", "id", "raw_content_ref"] and plain.count() == 3


def test_snapshots_are_rows_of_few_files(spark, tmp_path):
    """A page fetched twice on one day, null and line-ending pages, two sources; files as others wrote them beside."""
    rows = [("https://a.vn/1", "s", dt.datetime(2026, 8, 1), "<p>x</p>\n"), ("https://a.vn/1", "s", dt.datetime(2026, 8, 1, 5), "<p>y</p>"), ("https://a.vn/2", "t", dt.datetime(2026, 8, 1), None)]
    rows += [(f"https://a.vn/b{k}", "s", dt.datetime(2026, 8, 2), "<p>") for k in range(200)]
    raw = spark.createDataFrame(rows, "url STRING, source_id STRING, fetched_at TIMESTAMP_NTZ, html STRING")
    documents.write_snapshots(raw, str(tmp_path))
    (tmp_path / "u" / "20260801").mkdir(parents=True)
    (tmp_path / "u" / "20260801" / f"{'0' * 16}.html").write_text("<p>z</p>", "utf-8")
    assert len(list(tmp_path.rglob("*.parquet"))) <= 12
    got = sorted((r.source_id, r.html, str(r.day)) for r in documents.read_snapshots(spark, str(tmp_path), day="20260801").collect())
    assert got == [("s", "<p>x</p>\n", "2026-08-01"), ("s", "<p>y</p>", "2026-08-01"), ("t", "", "2026-08-01"), ("u", "<p>z</p>", "2026-08-01")]
    paths = {r.snapshot_path for r in documents.with_snapshot_path(raw).collect()}
    assert {r.snapshot_path for r in documents.read_snapshots(spark, str(tmp_path), source="s").collect()} == {p for p in paths if p.startswith("s/")}
    assert documents.read_snapshots(spark, str(tmp_path)).count() == 204 and documents.read_snapshots(spark, str(tmp_path), day="20250101").count() == 0
    documents.write_snapshots(raw, str(tmp_path / "alone"))
    assert documents.read_snapshots(spark, str(tmp_path / "alone")).count() == 203


def test_latest_load_of_any_spelling(spark):
    """Spellings of one page, repeated loads, loads without a place; each spelling is made canonical once, after its loads are one."""
    results = spark.createDataFrame([("q", 1, "https://a.vn/x"), ("q", 2, "https://b.vn/y"), ("q", 3, "https://c.vn/")], "query string, position int, url string").withColumns({"title": F.lit("T"), "snippet": F.lit("S")})
    loads = [("https://a.vn/x/", "https://a.vn/x?utm_source=1", "old", 1), ("https://a.vn/x?ref=z", None, "new", 5), ("https://a.vn/x/", None, "mid", 3), ("https://c.vn/", None, "lost", None)]
    pages = spark.createDataFrame(loads, "source_url string, url string, text string, position int")
    made = walk.candidate_blocks(results, pages)
    got = {r.position: (r.loaded, r.block.rsplit(": ", 1)[1]) for r in made.collect()}
    assert got == {1: (True, "new"), 2: (False, "(không tải được)"), 3: (False, "(không tải được)")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [k#") == 1


def test_a_beat_lists_no_timers():
    """A worker's only timer is that of its newest beat, so it is removed by its time."""
    import pandas as pd

    from opporta.streaming import status

    class Handle:
        def __init__(self):
            self.seen, self.timers = None, []
        def getValueState(self, *_):  # noqa: E301
            return self
        def exists(self):  # noqa: E301
            return self.seen is not None
        def get(self):  # noqa: E301
            return self.seen
        def update(self, value):  # noqa: E301
            self.seen = value
        def registerTimer(self, at):  # noqa: E301
            self.timers.append(at)
        def deleteTimer(self, at):  # noqa: E301
            self.timers.remove(at)
    handle, beats = Handle(), status.Heartbeat()
    beats.init(handle)
    for second in (5, 9, 7):
        list(beats.handleInputRows(("w",), iter([pd.DataFrame({"at": [pd.Timestamp(2026, 1, 1, 0, 0, second, 123457)]})]), None))
    assert handle.timers == [int(pd.Timestamp(2026, 1, 1, 0, 0, 9, 123457).timestamp() * 1000) + status.STALE_MS]
