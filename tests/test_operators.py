"""Literal cases and properties of the operators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opporta.operators import dedup, documents, leads, match, ordering, profiles, registry, resolve, responses, triage, walk
from opporta.sources import readers, tables


def ts(*parts):
    return F.lit(dt.datetime(*parts)).cast("timestamp_ntz")


def test_time_windows(spark):
    now = ts(2026, 8, 23, 14, 30)
    got = spark.range(1).select(*[triage.since(w, now).alias(w) for w in ("1_day", "1_week", "1_month")]).first()
    assert list(got) == [dt.datetime(2026, 8, 22, 14, 30), dt.datetime(2026, 8, 16, 14, 30), dt.datetime(2026, 7, 24, 14, 30)]
    assert triage.since(None, now) is None
    with pytest.raises(ValueError):
        triage.since("all", now)


def test_null_publication_falls_back_to_crawl_time(spark):
    df = spark.createDataFrame([(None, dt.datetime(2026, 1, 1))], "published_at TIMESTAMP_NTZ, crawled_at TIMESTAMP_NTZ")
    assert triage.with_effective_date(df).first().effective_at == dt.datetime(2026, 1, 1)


def test_run_rollup(spark):
    df = spark.createDataFrame([("j", "SUCCESS", 5, 2, 1, 2, 0), ("j", "PARTIAL", 4, 1, 0, 1, 2), ("f", "FAILED", 1, 0, 0, 0, 1)],
                               "job_id STRING, status STRING, total_discovered INT, new_leads INT, duplicate_leads INT, filtered_out INT, error_count INT")
    got = {r.job_id: r for r in triage.job_rollup(df).collect()}
    assert (got["j"].status, got["j"].total_discovered, got["j"].new_leads, got["j"].error_count) == ("PARTIAL", 9, 3, 2)
    assert got["f"].status == "FAILED"


def test_outcomes_partition_the_input(spark):
    items = spark.createDataFrame([(i, f"f{i % 7}", None, dt.datetime(2026, 1, 1), i % 3 != 0) for i in range(60)],
                                  "position INT, fingerprint STRING, published_at TIMESTAMP_NTZ, crawled_at TIMESTAMP_NTZ, is_relevant BOOLEAN")
    known = spark.createDataFrame([("f1",)], "fingerprint STRING")
    results = spark.createDataFrame([(f"f{i}", None, i * 20) for i in range(7)], "fingerprint STRING, model_error STRING, score INT")
    out = triage.triage(items, known, results, None, ts(2026, 2, 1))
    counters = triage.run_counters(out.withColumn("run", F.lit(1)), ["run"]).first()
    assert counters.total_discovered == 60 == counters.new_leads + counters.duplicate_leads + counters.filtered_out + counters.error_count
    assert out.where("outcome = 'NEW'").count() == out.where("outcome = 'NEW'").select("fingerprint").distinct().count()


def test_keyword_import(spark):
    df = spark.createDataFrame([(1, "  Chuyển đổi số, camera AI; OCR\ntrung tâm dữ liệu\r\nCAMERA AI  "), (2, " ;, "), (3, "x" * 161), (4, ",".join(f"k{i}" for i in range(1001)))], "id INT, content STRING")
    got = {r.id: r for r in registry.import_keywords(df, "id").collect()}
    assert got[1].keywords == ["Chuyển đổi số", "camera AI", "OCR", "trung tâm dữ liệu"] and got[1].error is None
    assert [got[i].error for i in (2, 3, 4)] == ["empty", "keyword too long", "too many keywords"]


def test_keyword_upsert(spark):
    ddl = "position INT, keyword STRING, group_id STRING, group_name STRING, use_for_filter BOOLEAN, use_for_discovery BOOLEAN"
    stored = spark.createDataFrame([(0, "OCR", "g", "G", True, False)], ddl)
    new = spark.createDataFrame([(i, k, "custom", "C", True, False) for i, k in enumerate(["camera AI", "quản lý tài sản", "camera ai", "ERP mới"])], ddl)
    totals = registry.upsert_totals(registry.upsert_keywords(stored, new)).first()
    assert (totals.added, totals.promoted, totals.duplicates) == (3, 0, 1)


def test_both_keyword_plans_agree(spark):
    items = spark.createDataFrame([(1, "Dự án AI", "số hóa tài liệu C++"), (2, "", "tải logistics"), (3, "x", "dữ liệu ++ ok")], "id INT, title STRING, raw_content STRING")
    words = spark.createDataFrame([(k, "g", k[:1], True, True, True) for k in ["AI", "số hóa", "số hóa tài liệu", "C++", "++", "gis", "dữ liệu"]],
                                  "keyword STRING, group_id STRING, group_name STRING, use_for_filter BOOLEAN, use_for_discovery BOOLEAN, active BOOLEAN")
    small, large = (sorted((r.id, tuple(r.matched_keywords), tuple(r.matched_groups)) for r in match.match_keywords(items, words, "id", n).collect()) for n in (100, 0))
    assert small == large and small[0][1] == ("AI", "C++", "số hóa", "số hóa tài liệu") and small[1][1] == () and small[2][1] == ("++", "dữ liệu")


def test_scores(spark):
    bodies = [(1, {"total_score": 150, "recommended_action": "call"}), (2, {"total_score": 50, "recommended_action": "VISIT"}), (3, {"total_score": "abc", "recommended_action": "EMAIL"})]
    df = spark.createDataFrame([(i, "score", json.dumps(b)) for i, b in bodies], "doc_url INT, kind STRING, body STRING")
    answers = responses.scores(df, "m")
    assert [(r.total_score, r.recommended_action) for r in responses.accepted(answers).collect()] == [(100, "CALL")]
    assert sorted(r.reject_reason for r in responses.rejected(answers, "score").collect()) == ["invalid recommended_action", "invalid total_score"]


def profile(spark, used):
    body = json.dumps({"legal_name": "ABC", "industry": "IT", "size": "10", "locations": ["HN"], "employee_count": "10", "technologies": ["ERP"],
                       "projects": [{"name": "P", "summary": "s", "source_url": "https://abc.vn/du-an"}],
                       "contacts": [{"full_name": "An", "phone": "912345678", "source_url": "https://abc.vn/du-an", "evidence_text": "t", "decision_score": 90}],
                       "evidence": [{"field": "industry", "value": "IT", "source_url": "https://abc.vn/du-an", "evidence_text": "t", "confidence": 0.9}]})
    answers = spark.createDataFrame([("d", "profile", body, "ABC", "https://abc.vn/")], "doc_url STRING, kind STRING, body STRING, name STRING, official_url STRING")
    pages = spark.createDataFrame([("d", used)], "doc_url STRING, url STRING")
    none = F.lit(None).cast("string")
    return profiles.profiles(answers, pages).withColumn("status", profiles.profile_status(F.col("missing_information"), none, none, none)).first()


def test_profile_is_grounded(spark):
    good = profile(spark, "https://abc.vn/du-an/?utm_source=x")
    assert good.status == "COMPLETE" and good.contacts[0].phone == "0912345678" and len(good.projects) == 1
    bad = profile(spark, "https://abc.vn/khac")
    assert (bad.projects, bad.contacts, bad.evidence) == ([], [], []) and "contacts" in bad.missing_information and bad.status == "PROFILE_INCOMPLETE"


def test_pending_never_synced(spark):
    df = spark.createDataFrame([("1", "PENDING_AI", "x", 90), ("2", "NEW", "[Hàng đợi AI] x", 90), ("3", "NEW", "x", 90), ("4", "ARCHIVED", "x", 90), ("5", "NEW", None, 39)],
                               "id STRING, status STRING, need_summary STRING, score INT")
    assert [r.id for r in leads.sync_missing(df, spark.createDataFrame([("9",)], "id STRING")).collect()] == ["3"]


def test_site_walk_with_sitemap_and_cap(spark):
    seeds = spark.createDataFrame([("s", "/", 0)], "site STRING, url STRING, position INT")
    sitemap = spark.createDataFrame([("s", "/map", 0)], "site STRING, url STRING, position INT")
    edges = spark.createDataFrame([("s", a, b, p) for a, b, p in [("/", "/news", 0), ("/", "/gone", 1), ("/news", "/n1", 0), ("/n1", "/n2", 0), ("/n2", "/n3", 0), ("/gone", "/x", 0), ("/news", "/", 1)]],
                                  "site STRING, src_url STRING, dst_url STRING, position INT")
    pages = spark.createDataFrame([(u,) for u in ["/", "/map", "/news", "/n1", "/n2", "/n3", "/x"]], "url STRING")
    got = {r.url: r.depth for r in walk.site_walk(seeds, edges, pages, sitemap).collect()}
    assert got == {"/": 0, "/map": 1, "/news": 1, "/n1": 2, "/n2": 3}
    assert {r.url for r in walk.site_walk(seeds, edges, pages, sitemap, max_pages=3).collect()} == {"/", "/map", "/news"}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.format_string("n%04d", "id").alias("u"), F.format_string("n%04d", F.col("id") + 1).alias("v"))
    star = spark.range(200).select(F.lit("z").alias("u"), F.format_string("z%04d", "id").alias("v"))
    got = resolve.connected_components(chain.unionByName(star)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {("n0000", 301), ("z", 201)}


def test_interleave_is_a_permutation(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).alias("source_order"), F.col("id").alias("position"))
    small, hot = (sorted((r.source_order, r.position, r.round) for r in ordering.fair_interleave(df.repartition(n)).collect()) for n in (1, 7))
    assert small == hot and len(small) == 500
    assert max(c["count"] for c in ordering.fair_interleave(df).groupBy("source_order", "round").count().collect()) == 25


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k STRING, pos INT, v STRING")
    assert sorted((r.k, r.v) for r in dedup.first_wins(df, ["k"], ["pos"]).collect()) == [("a", "y"), ("b", "z")]


def test_each_page_is_stored_once_over_many_batches(spark, tmp_path):
    from opporta.streaming import ingest
    ingest.keep_state_on_disk(spark)
    for i in range(12):
        spark.createDataFrame([(f"https://a.example.com/{k}?utm_source=s{i}", i) for k in range(i, i + 3)], "url STRING, batch INT").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    pages = ingest.document_stream(spark, f"{tmp_path}/in", "url STRING, batch INT", files_per_batch=1)
    for _ in range(2):  # a restart takes up where the first run ended
        ingest.start_ingest(pages, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    stored = ingest.stored_pages(spark, f"{tmp_path}/out")
    assert stored.count() == stored.select("fingerprint").distinct().count() == 14



def test_csv_export_has_one_mark_and_reloads(spark, tmp_path):
    cols = {name: F.lit(None).cast("string") for _, name in tables.CSV_COLUMNS}
    cols.update(id=F.lit("1"), score=F.lit(95), need_categories=F.array(F.lit("a"), F.lit("b")), score_reasons=F.array(F.lit("r")), budget_value=F.lit(0.0),
                title=F.lit("t"), crawled_at=ts(2026, 1, 2, 3, 4), published_at=F.lit(None).cast("timestamp_ntz"), organization_name=F.lit('Sở "Y", tế'))
    df = spark.range(1).select(*[c.alias(n) for n, c in cols.items()])
    tables.write_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8")
    assert text.count("﻿") == 1 and text.startswith("﻿Lead ID,") and "a, b" in text and "02/01/2026 03:04" in text
    back = tables.read_sheet(spark, str(tmp_path / "csv"), [label for label, _ in tables.CSV_COLUMNS]).first()
    assert back["Đơn vị / Cơ quan (Organization)"] == 'Sở "Y", tế' and back["Ngân sách (Budget VND)"] is None
    with pytest.raises(ValueError):
        tables.read_sheet(spark, str(tmp_path / "csv"), ["id"])


def test_snapshot_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("https://a.vn/1", "src", dt.datetime(2026, 8, 1), "<p>x</p>")], "url STRING, source_id STRING, fetched_at TIMESTAMP_NTZ, html STRING")
    path = documents.with_snapshot_path(raw).first()
    (tmp_path / path.snapshot_path).parent.mkdir(parents=True)
    (tmp_path / path.snapshot_path).write_text("<p>x</p>", "utf-8")
    got = documents.read_snapshots(spark, str(tmp_path)).first()
    assert (got.html, got.source_id, got.snapshot_hash, got.snapshot_path) == ("<p>x</p>", "src", path.snapshot_hash, path.snapshot_path)


def test_yaml_registries(spark, tmp_path):
    (tmp_path / "k.yaml").write_text("discovery_search:\n  keywords: [số hóa]\nkeyword_groups:\n  a: {name: A, keywords: [AI, SỐ HÓA]}\n  b: {keywords: [ai]}\n", "utf-8")
    got = {r.keyword: r for r in registry.seed_keywords(*readers.yaml_keywords(spark, str(tmp_path / "k.yaml"))).collect()}
    assert (got["số hóa"].group_id, got["số hóa"].use_for_filter, got["số hóa"].use_for_discovery) == ("a", True, True)
    assert (got["AI"].group_id, got["AI"].group_name) == ("b", "b")
    (tmp_path / "s.yaml").write_text("sources:\n  - {id: x, name: X, seed_urls: [Example.vn], enabled: true}\n  - {id: y, seed_urls: []}\n", "utf-8")
    rows = registry.clean_sources(readers.yaml_sources(spark, str(tmp_path / "s.yaml"))).collect()
    assert [(r.id, r.seed_urls, r.enabled) for r in rows] == [("x", ["https://example.vn/"], True)]


def test_error_classes(spark):
    df = spark.createDataFrame([("HTTP 404 for x",), ("timeout",), ("Connection refused",)], "m STRING")
    assert [r[0] for r in df.select(documents.error_class(F.col("m"))).collect()] == ["permanent", "transient", "permanent"]
