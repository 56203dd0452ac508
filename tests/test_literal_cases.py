"""Small literal inputs whose answers once were wrong, lost or dependent on size."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from opporta.operators import documents, feeds, match, ordering, parse, profiles, resolve, rule_based
from opporta.streaming import status

REGISTRY = "keyword STRING, group_id STRING, group_name STRING, use_for_filter BOOLEAN, use_for_discovery BOOLEAN, active BOOLEAN"


@pytest.fixture
def now(spark):
    return F.lit("2026-08-23 00:00:00").cast("timestamp_ntz")


def test_registry_size_does_not_change_answers(spark):
    items = spark.createDataFrame([(None, "erp here", None), (1, "an erp", "x"), (1, "no", "++ sign"), (1, "no", "++ sign"), (2, None, None)], "id INT, title STRING, raw_content STRING")
    words = spark.createDataFrame([(k, "g", "G", True, True, True) for k in ("erp\t", " erp", "++", "  ", "")], REGISTRY)
    small, large = (sorted(((r.id, r.title, r.matched_keywords, r.is_relevant) for r in match.match_keywords(items, words, "id", n).collect()), key=repr) for n in (100, 0))
    assert small == large
    assert (None, "erp here", ["erp"], True) in small and small.count((1, "no", ["++"], True)) == 2


def test_many_signs_are_no_error(spark):
    items = spark.createDataFrame([(1, "", "a §§ b")], "id INT, title STRING, raw_content STRING")
    words = spark.createDataFrame([(k, "g", "G", True, True, True) for k in ["§§", *("+" * n for n in range(1, 60))]], REGISTRY)
    assert match.match_keywords(items, words, "id", 0).first().matched_keywords == ["§§"]


@pytest.mark.parametrize("text", ["{hello} world", "{", "[x] y", "plain"])
def test_post_texts_with_brackets_stay(spark, now, text):
    body = json.dumps({"url": "https://www.linkedin.com/posts/1", "text": text, "author": "{A}"})
    got = feeds.social_posts(spark.createDataFrame([(1, body)], "position INT, body STRING"), now).collect()
    assert [(r.title, r.author) for r in got] == [(text, "{A}")]


def test_search_titles_with_brackets_stay(spark):
    body = json.dumps({"results": [{"url": "https://a.example.com/1", "title": "[Hot] Goi thau"}, {"url": "https://b.example.com/", "title": "{x"}]})
    got = feeds.search_results(spark.createDataFrame([("q", body)], "query STRING, body STRING")).orderBy("position").collect()
    assert [r.title for r in got] == ["[Hot] Goi thau", "{x"]


@pytest.mark.parametrize("depth", [0, 1, 5, 8])
def test_answers_nested_to_any_depth(spark, depth):
    value = [{"url": f"https://a.example.com/{i}", "title": "T"} for i in range(7)]
    for _ in range(depth):
        value = {"data": value}
    rows = feeds.search_results(spark.createDataFrame([("q", json.dumps({"results": value}))], "query STRING, body STRING")).collect()
    assert sorted(r.position for r in rows) == [1, 2, 3, 4, 5, 6, 7]
    assert feeds.search_results(spark.createDataFrame([("q", json.dumps({"results": value}))], "query STRING, body STRING"), max_results=5).count() == 5


def test_generic_items_take_the_body_only(spark, now):
    pages = [("https://x.example.com/a", "<html><head><title>Head T</title></head><body><p>body</p></body></html>"), ("https://x.example.com/b", "<head><title>Only</title></head><body> </body>"),
             ("https://x.example.com/c", "<p>no body tag</p>")]
    raw = spark.createDataFrame([(u, "own", h) for u, h in pages], "url STRING, source_id STRING, html STRING").withColumn("fetched_at", now)
    got = {r.url[-1]: (r.title, r.raw_content, r.error) for r in parse.parse_items(raw, now).collect()}
    assert got["a"] == ("Head T", "body", None) and got["b"][2] == "no text" and got["c"][1:] == ("no body tag", None)


def test_unreadable_profiles_are_reported(spark):
    answers = spark.createDataFrame([("d1", "profile", "no json"), ("d2", "profile", '{"legal_name": "A"}'), ("d3", "score", "no json")], "doc_url STRING, kind STRING, body STRING")
    assert [(r.doc_url, r.reject_reason) for r in profiles.rejected_profiles(answers).collect()] == [("d1", "invalid profile")]


def test_nameless_mentions_are_no_organization(spark):
    mentions = spark.createDataFrame([(1, None, None, None), (2, " ", "", None), (3, None, None, "Firm"), (4, "a.vn", None, None)], "mention_id INT, domain STRING, tax_code STRING, legal_name STRING")
    assert {r.mention_id for r in resolve.resolve(mentions).collect()} == {3, 4}
    assert {r.mention_id for r in resolve.nameless(mentions).collect()} == {1, 2}


def test_challenge_marker_anywhere(spark):
    page = spark.createDataFrame([("x" * 40_000 + "just a moment", 200)], "html STRING, status_code INT").withColumn("headers", F.create_map(F.lit("a"), F.lit("b")))
    assert documents.quality_gate(page).first().reject_reason == "challenge"
    assert documents.quality_gate(page, window=30_000).first().reject_reason is None


def test_quotas_read_the_candidates_once_per_keyword(spark):
    rows = [("s", f"k{i % 6}", i, f"u{i // 2}") for i in range(600)]
    frame = spark.createDataFrame(rows, "source_id STRING, keyword STRING, position INT, target_url STRING")
    got = ordering.balanced_top(frame, [f"k{i}" for i in range(6)])
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ") <= 6
    assert got.groupBy("keyword").count().where("count = 10").count() == 6


def test_positions_with_null_keys(spark):
    frame = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(5)], "k STRING, p INT")
    got = ordering.with_row_number(frame, ["k"], ["p"], "n").collect()
    assert sorted(r.n for r in got if r.k is None) == list(range(1, 51)) and dict(ordering.with_row_number(frame, ["k"], ["p"], "n").dtypes)["n"] == "bigint"


def test_events_without_time_or_status_do_not_decide(spark):
    import pandas as pd

    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value
    fold = status.StatusFold()
    fold.state = Value()
    t = pd.Timestamp("2026-01-01")
    batch = pd.DataFrame({"adapter_mode": ["x"] * 3, "status": ["OK", None, "BAD"], "error": [None, None, None], "at": [t, t, pd.NaT]})
    out = list(fold.handleInputRows(("s",), iter([batch]), None))[0]
    assert out["status"].tolist() == ["OK"] and out["at"].tolist() == [t]
    empty = status.StatusFold()
    empty.state = Value()
    assert list(empty.handleInputRows(("s",), iter([batch.iloc[2:]]), None))[0]["at"].isna().all()


def test_rule_names_and_deadlines(spark, now):
    texts = [
        ("Tin", "Chủ đầu tư: Sở Y tế tỉnh A Địa chỉ: số 1\nBên mời thầu: Công ty B", "Sở Y tế tỉnh A", None),
        ("Tin", "Bên mời thầu khác: không rõ. Công ty Cổ phần X triển khai dự án", "Công ty Cổ phần X", None),
        ("Bộ Tài chính: quy định", "không có gì", "Bộ Tài chính: quy định", None),
        ("Tin", "Thời điểm đóng thầu: 24/08/2026 09:30, xem thêm", None, "2026-08-24 09:30:00"),
        ("Tin", "hạn nộp vào 25/08/2026 10:00.", None, "2026-08-25 10:00:00"),
    ]
    frame = spark.createDataFrame([(i, t, x) for i, (t, x, _, _) in enumerate(texts)], "i INT, title STRING, raw_content STRING")
    got = {r.i: r for r in rule_based.extract_by_rules(frame, now).collect()}
    for i, (_, _, name, due) in enumerate(texts):
        assert got[i].organization_name == name, texts[i]
        assert (None if got[i].deadline is None else str(got[i].deadline)) == due, texts[i]


def test_one_pass_reads_what_the_expressions_read(spark, now):
    """Owner, deadline, requirements and place of one pass equal the column expressions, over texts drawn from their words."""
    import random

    from opporta.functions import dates, text as tx
    from opporta.functions.places import PROVINCES, listed_place, with_location
    rnd = random.Random(4)
    lists = [rule_based.OWNER_LABELS, rule_based.NO_OWNER, rule_based.NEXT_LABELS, rule_based.BODIES, rule_based.ACTS, rule_based.DEADLINE_LABELS, rule_based.DEADLINE_WORDS,
             rule_based.NOISE_WORDS, PROVINCES, rule_based._NEED_WORDS.split("|"), [": ", ":", ".", "\n", ";", ",", " ", "  ", "-", " – ", "vào ", "ngày "], ["24/08/2026 09:30", "1-2-2026", "Tỉnh A", "dự án", "x_", "số 12", "xã"]]

    def piece():
        word = rnd.choice(rnd.choice(lists))
        return rnd.choice([word, word.upper(), word.lower()]) + rnd.choice(["", " ", " ", ": "])
    rows = [(k, rnd.choice([None, "", "".join(piece() for _ in range(rnd.randint(1, 5)))]), rnd.choice([None, "", *["".join(piece() for _ in range(rnd.randint(1, 40)))] * 8])) for k in range(1500)]
    frame = spark.createDataFrame(rows, "i int, title string, raw_content string").repartition(8)
    text = F.col("raw_content")
    plain = with_location(frame, text, "location").select("i", rule_based.organization_name(F.col("title"), text).alias("o"), rule_based.deadline(text, now).alias("d"),
                                                         F.coalesce(rule_based.need_sentences(text), F.array().cast("array<string>")).alias("n"), "location")
    read = F.arrow_udf(rule_based._read, rule_based._PARTS)("title", text)
    one = frame.select("i", read.alias("r")).select("i", F.col("r.organization").alias("o"), F.coalesce(
        dates.parse_datetime(tx.squeeze(F.col("r.due")), now), dates.parse_datetime(tx.squeeze(F.col("r.due_day")), now)).alias("d"), F.col("r.needs").alias("n"), listed_place(F.col("r.place")).alias("location"))
    a, b = ({r.i: (r.o, r.d, r.n, r.location) for r in df.collect()} for df in (plain, one))
    wrong = [(rows[i], a[i], b[i]) for i in a if a[i] != b[i]]
    assert not wrong, (len(wrong), wrong[0])
    assert sum(x[0] is not None for x in a.values()) > 300 and sum(x[1] is not None for x in a.values()) > 30


def test_package_reaches_the_workers(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
            "print('ROWS', e.queries()['parsed_titles'](s, '/root/testdata/sf0.001').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_links_of_unclosed_lists_take_linear_time():
    import time

    from opporta.functions.html import Page
    start = time.perf_counter()
    links, _ = Page("".join(f'<li><a href="/{i}">x</a> 0{i % 9 + 1}/02/2024 ' for i in range(20_000))).anchors("http://a.vn/", with_blocks=False)
    Page("<div>" * 20_000 + "</p>" * 20_000 + "</div>" * 20_000)
    assert time.perf_counter() - start < 4
    assert len(links) == 20_000 and links[3]["near_date"] == "04/02/2024"
