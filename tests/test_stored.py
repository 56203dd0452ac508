"""Tables that are read and changed: buckets replaced, batches that run again, keys that stay in place, results brought up to date."""

import contextlib
import glob
import io
import os
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opporta.operators import dedup, ordering, resolve
from opporta.plans import search
from opporta.sources import lead_table
from opporta.streaming import ingest

LEADS = "id string, content_fingerprint string, status string, crawled_at timestamp"
T0 = datetime(2026, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.select("id", "status").collect()))


def some(spark, ids, status="NEW", day=0):
    return spark.createDataFrame([(f"l{k}", f"f{k}", status, T0 + timedelta(days=day)) for k in ids], LEADS)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/leads"
    lead_table.create(some(spark, range(200)), path, "content_fingerprint", 8)
    return path


def test_publish_leaves_other_buckets_alone(spark, table, tmp_path):
    before = files(table)
    many = lead_table.publish(some(spark, [3], "CONTACTED"), table, "content_fingerprint", f"{tmp_path}/s1", 8)
    after = files(table)
    changed = {os.path.dirname(f) for f in before.items() ^ after.items() for f in [f[0]]}
    assert many == 1 and len(changed) == 1 and len({os.path.dirname(f) for f in after}) == 8
    assert rows_of(lead_table.read(spark, table)) == sorted((f"l{k}", "CONTACTED" if k == 3 else "NEW") for k in range(200))


def test_a_step_published_again_changes_nothing_and_repairs_a_lost_bucket(spark, table, tmp_path):
    updates, step = some(spark, range(190, 230), "QUALIFIED"), f"{tmp_path}/s1"
    lead_table.publish(updates, table, "content_fingerprint", step, 8)
    want = rows_of(lead_table.read(spark, table))
    shutil.rmtree(glob.glob(f"{table}/bucket=*")[0])  # as if the replacement had stopped half-way
    lead_table.publish(updates, table, "content_fingerprint", step, 8)
    assert rows_of(lead_table.read(spark, table)) == want == sorted((f"l{k}", "NEW" if k < 190 else "QUALIFIED") for k in range(230))


def test_known_keys_stay_as_they_are(spark, table, tmp_path):
    arrived = some(spark, range(195, 205), "SEEN").unionByName(some(spark, range(195, 205), "LATER", 1)).unionByName(spark.createDataFrame([("x", None, "SEEN", T0)], LEADS))
    lead_table.publish_new(arrived, table, "content_fingerprint", f"{tmp_path}/s1", ["crawled_at"], 8)
    assert rows_of(lead_table.read(spark, table)) == sorted((f"l{k}", "NEW" if k < 200 else "SEEN") for k in range(205))
    before = files(table)
    assert lead_table.publish_new(some(spark, range(50)), table, "content_fingerprint", f"{tmp_path}/s2", ["crawled_at"], 8) == 0 and files(table) == before
    assert lead_table.publish_new(some(spark, []), table, "content_fingerprint", f"{tmp_path}/s3", ["crawled_at"], 8) == 0


def test_a_batch_that_runs_twice_leaves_the_same_table(spark, table, tmp_path):
    write = ingest.lead_batches(table, f"{tmp_path}/steps", "content_fingerprint", ["crawled_at"], 8)
    write(some(spark, range(150, 250)), 0)
    once = rows_of(lead_table.read(spark, table))
    write(some(spark, range(150, 250)), 0)
    assert rows_of(lead_table.read(spark, table)) == once == sorted((f"l{k}", "NEW") for k in range(250))
    write(some(spark, range(240, 260)), 1)
    assert not os.path.exists(f"{tmp_path}/steps/0") and lead_table.read(spark, table).count() == 260


def test_ingest_goes_on_from_its_checkpoint(spark, table, tmp_path):
    ingest.keep_state_on_disk(spark)

    def run():
        stream = spark.readStream.schema(LEADS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.start_lead_ingest(stream, table, f"{tmp_path}/checkpoint", ["crawled_at"], buckets=8).awaitTermination()
    some(spark, range(190, 210), "A").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    some(spark, range(205, 215), "B").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    once = rows_of(lead_table.read(spark, table))
    # The commit of the last batch is lost, as after a crash: it runs again.
    for name in (max(glob.glob(f"{tmp_path}/checkpoint/commits/[0-9]*"), key=lambda f: int(os.path.basename(f))),):
        os.remove(name)
        with contextlib.suppress(FileNotFoundError):
            os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
    run()
    assert rows_of(lead_table.read(spark, table)) == once
    some(spark, range(212, 220), "C").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = dict(rows_of(lead_table.read(spark, table)))
    assert len(got) == 220 and all(got[f"l{k}"] == "NEW" for k in range(190)) and all(got[f"l{k}"] == "C" for k in range(215, 220))


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_stored_keys_are_read_without_an_exchange(spark, tmp_path):
    known = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("fingerprint"))
    dedup.store_fingerprints(known, "stored_keys_test", f"{tmp_path}/keys", 16)
    items = spark.createDataFrame([(f"f{k}", k) for k in range(490, 520)] * 2, "fingerprint string, page_id int")
    new = dedup.not_stored(items, "stored_keys_test", ["page_id"])
    plan = plan_of(new)
    assert sorted(r.page_id for r in new.collect()) == list(range(500, 520))
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the items' own, to the table's buckets
    spark.sql("DROP TABLE stored_keys_test")


@pytest.mark.parametrize("seed", range(4))
def test_delta_equals_a_full_run(spark, seed):
    rnd = random.Random(seed)

    def mention(k):
        return (k, rnd.choice([None, "", *[f"name{j}" for j in range(12)]]), rnd.choice([None, " ", *[f"d{j}.vn" for j in range(25)]]), rnd.choice([None, None, *[f"t{j}" for j in range(25)]]))
    rows = [mention(k) for k in range(90)]
    kind = "mention_id int, legal_name string, domain string, tax_code string"
    parts = [spark.createDataFrame(p, kind) for p in (rows[:40], rows[40:60], rows[60:60], rows[60:])]
    stored = resolve.resolve(parts[0])
    labels, names = resolve.resolution_state(parts[0])
    for part in parts[1:]:
        delta = resolve.resolve_delta(labels, names, part)
        stored = resolve.relabelled(stored, delta).unionByName(delta.resolved)
        labels, names = resolve.relabelled_state(labels, names, delta)
    whole = spark.createDataFrame(rows, kind)
    full_labels, full_names = resolve.resolution_state(whole)
    for got, want in ((stored.select("mention_id", "component"), resolve.resolve(whole).select("mention_id", "component")), (labels, full_labels), (names, full_names)):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [None, 1, 7, 40])
def test_balanced_top_equals_one_keyword_after_another(spark, most):
    rnd = random.Random(5)
    rows = [(f"s{rnd.randint(0, 2)}", f"k{rnd.randint(0, 5)}", rnd.randint(0, 300), f"u{rnd.randint(0, 60)}") for _ in range(900)] + [(None, "k0", 1, "u1")]
    words = ["k3", "k0", "k5", "none", "k1"]
    got = ordering.balanced_top(spark.createDataFrame(rows, "source_id string, keyword string, position int, target_url string"), words, most, per_keyword=6)
    used = words[:most or len(words)]
    quota = max(1, -(-(most or len(used) * 6) // len(used)))
    want = []
    for source in {r[0] for r in rows}:
        own: list = []
        for order, word in enumerate(used):
            first: dict = {}
            for s, k, p, u in rows:
                if (s, k) == (source, word) and u not in {x[1] for x in own}:
                    first[u] = min(p, first.get(u, p))
            own += [(source, u, word, order, p) for p, u in sorted((p, u) for u, p in first.items())[:quota]]
        want += own[:most]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_plan_of_balanced_top_does_not_grow_with_keywords(spark):
    candidates = spark.createDataFrame([("s", "k1", 1, "u")], "source_id string, keyword string, position int, target_url string")
    few, many = (plan_of(ordering.balanced_top(candidates, [f"k{j}" for j in range(n)])).count("Exchange") for n in (2, 40))
    assert few == many


def test_sought_pages_are_those_of_an_offset(spark):
    rnd = random.Random(2)
    rows = [(f"i{k:03}", rnd.choice([None, 1, 2, 3]), rnd.choice([None, T0, T0 + timedelta(seconds=1)])) for k in range(95)]
    leads = spark.createDataFrame(rows, "id string, score int, crawled_at timestamp")
    for page in (1, 2, 5, 9, 10, 11):
        assert [r.id for r in search.seek_page(leads, page, 10).collect()] == [r.id for r in search.lead_page(leads, page, 10).collect()]


def test_sheet_files_are_bounded(spark, tmp_path, monkeypatch):
    """A CSV file with line ends is read by one task, so that a large sheet is several files."""
    from opporta.sources import tables
    monkeypatch.setattr(tables, "FILE_ROWS", 4, raising=False)
    rows = spark.createDataFrame([(str(k), f'a "{k}"\nb') for k in range(10)], "id string, title string").coalesce(1)
    tables.write_sheet(rows, str(tmp_path / "sheet"))
    assert len(glob.glob(f"{tmp_path}/sheet/part-*.csv")) == 3
    assert sorted(map(tuple, tables.read_sheet(spark, str(tmp_path / "sheet"), ["id", "title"]).collect())) == sorted(map(tuple, rows.collect()))


def test_a_change_is_computed_once(spark, tmp_path):
    """A stream's batch that is used again passes the state again, so its rows are kept while a step is written."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value
    lead_table.create(some(spark, range(4)), str(tmp_path / "leads"), "id", 4)
    change = some(spark, range(2, 8), "CONTACTED").withColumn("id", F.udf(count, "string").asNondeterministic()("id"))
    lead_table.publish(change, str(tmp_path / "leads"), "id", str(tmp_path / "step"), 4)
    assert seen.value == 6
    assert rows_of(lead_table.read(spark, str(tmp_path / "leads"))) == [(f"l{k}", "NEW" if k < 2 else "CONTACTED") for k in range(8)]
