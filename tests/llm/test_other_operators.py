"""Pages, mixing, neighbours, components and the pipeline."""

import re

import numpy as np
import pytest

import corpus_pipeline
from opporta.llm import common, mixing, neighbours, page_labels, page_text, queries
from tests.llm.conftest import ODD

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def test_blocks_of_pages_that_the_tree_has_not_seen():
    """Precision and recall of blocks on pages drawn with another seed, whole and by where the blocks stand."""
    tree = page_text.trained()
    x, y = page_text.labelled(page_labels.drawn(300, 7))
    main = page_text.judged(tree, x) > 0.5
    assert y[main].mean() > 0.98 and main[y == 1].mean() > 0.98
    article, bare = x[:, 8] == 1, (x[:, 8] == 0) & (x[:, 9] == 0)
    for part in (article, bare):
        assert y[part & main].mean() > 0.97 and main[part & (y == 1)].mean() > 0.97
    assert not main[(x[:, 6] == 1) | (x[:, 7] == 1)].any()
    assert page_text.LEAST_LEAF > 1 and page_labels.MARK not in "".join(b[0] for b in page_text.blocks(page_labels.LABELLED[0].replace(page_labels.MARK, "")))


_LINE = "the committee met on Tuesday to look at plans for the old harbour and agreed to ask for more"
_P = f"<p>{_LINE}</p>"


@pytest.mark.parametrize(("html", "want"), [
    (f"<nav><a href=/>Home</a> | <a href=/w>World news</a> | <a href=/s>Sport</a></nav><article><h1>Title here</h1>{_P}</article>", ["Title here", _LINE]),
    (f"<article>{_P}</article><footer><a href=/t>Terms of use and privacy policy of this site</a> <a href=/c>Contact us</a></footer>", [_LINE]),
    (f"<article>{_P}{_P}</article><aside class=sidebar><a href=/r>A long related story title that has more than seven words</a></aside>", [_LINE, _LINE]),
    (f"<article>{_P}<div class=advert><a href=/b>Buy the best new car of the year today with us</a></div>{_P}</article>", [_LINE, _LINE]),
    (f"<article>{_P}<p><a href=/x>Read it here</a></p><p>A last line.</p></article>", [_LINE, "Read it here", "A last line."]),
    (f"<article>{_P}</article><div>Copyright 2024 the publisher all rights reserved</div>", [_LINE]),
    (f"<article>{_P}</article><div><p>Anna</p><p>I fully agree with what was said here, well done to all of you who came</p></div>", [_LINE]),
])
def test_frame_goes_and_article_stays(html, want):
    assert page_text.main_text(html, page_text.trained()).split("\n") == want


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body><div id="header">Site name</div><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work and to count our readers, which is fine.</div>
<article><header><h1>Fish &amp; chips</h1></header><p>One   two&nbsp;three<br>four 1 < 2<p>Unclosed <b>bold <i>text</p><ul><li>first<li>second</ul>
<div class="ad-box">Buy this thing now</div><script>var x = "<p>no</p>";</script><form><p>Sign up</p></form><!-- <p>no</p> --><section class="comments"><p>I do not agree with this at all.</p></section></article>
<aside><p>Weather tonight is cold with rain.</p></aside><footer>&copy; 2024</footer>"""


def test_page_text_of_odd_pages(spark):
    tree = page_text.trained()
    assert page_text.main_text(PAGE, tree) == "Fish & chips\nOne two three four 1 < 2\nUnclosed bold text\nfirst\nsecond"
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (3, "u", "<p"), (3, "u", "<p"), (4, "u", PAGE), (5, "u", "<" * 50)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in page_text.report(pages).collect()}
    assert got[1] == got[3] == got[None] == ("", 0) and got[4][1] == len(got[4][0])
    assert page_text.report(pages.limit(0)).collect() == []
    clash = pages.withColumnRenamed("url", "main_text")
    assert page_text.extracted(clash)[0].columns == ["page_id", "main_text", "html", "main_text_"]


def test_open_heads_and_page_forms_keep_the_article():
    tree = page_text.trained()
    text = "The council voted on Monday to repair the old sea wall, and the work is to start in the first week of spring if the weather allows it."
    assert page_text.main_text(f"<!doctype html><head><title>t</title><style>p{{}}</style><article><p>{text}</p></article>", tree) == text
    assert page_text.main_text(f"<head><title>t</title>{text}", tree) == text
    menu = "<nav><ul><li><a href='/'>Home</a></ul></nav>"
    assert page_text.main_text(f"<body><form id='aspnetForm'>{menu}<article><p>{text}</p><form><p>Sign up</p></form></article></form>", tree) == text
    assert page_text.main_text(f"<body><form id='aspnetForm'>{menu}<div><p>{text}</p><p>{text}</p></div></form>", tree) == f"{text}\n{text}"


@pytest.mark.parametrize("page", ["<li>" * 30_000, "<a <a " * 20_000, '<div class="' * 20_000, "<!--" * 20_000, "<div>" * 30_000, "</p>" * 30_000])
def test_broken_pages_take_linear_time(page):
    import time
    start = time.perf_counter()
    page_text.main_text(page, page_text.trained())
    assert time.perf_counter() - start < 4


def test_targets_share_out_what_small_sources_cannot_take():
    assert mixing.targets([100, 100, 100]) == [50, 100, 150]
    got = mixing.targets([10, 1000, 5, 0, 400])
    assert got[0] <= 30 and got[2] == 15 and got[3] == 0 and abs(sum(got) - 1415) < 1e-9
    assert mixing.targets([]) == []


def test_permutation_takes_every_block_once():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, dtype=np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_of_odd_rows(spark, odd):
    got = mixing.report(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(SIZE.findall(t or ""))) for i, t, *_ in ODD)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert abs(sum(taken) - target) <= 2 * mixing.BLOCK_WORDS or size == 0
    again = mixing.report(odd).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    words = sum(len(SIZE.findall(r.text)) for r in mixing.sample(odd).collect())
    assert words == sum(r.taken for r in got)
    assert mixing.sample(odd).columns == odd.columns


def test_neighbours_of_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.standard_normal(8)], 1) for i in range(700)]
    rows += [(700, None, 1), (800, [0.0] * 8, 1), (900, [1.0, None] + [1.0] * 6, 1), (1000, [float("nan")] * 8, 1), (1100, [1.0] * 3, 1), (None, rows[0][1], 1), (100, rows[5][1], 2), (0, rows[0][1], 3)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, row int").repartition(4)
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for k, (q, v) in enumerate(good):
        if q is not None and q % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i is None, i or 0, i) for j, (i, w) in enumerate(good) if j != k)[:10]
            want += [(q, r + 1, i, round(s, 9)) for r, (s, _, _, i) in enumerate(near)]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.report(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    few = neighbours.report(table.where("vec_id < 3")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"]) if r.query_id == 0].count(1) == 2
    assert neighbours.report(table.limit(0)).collect() == []


def test_large_ids_come_back_exactly(spark):
    big = 2**60
    rows = [(big + 1, [1.0, 0.0]), (big + 3, [2.0, 0.0]), (big + 2, [2.0, 0.0]), (None, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    got = sorted((r["rank"], r.vec_id) for r in neighbours.search(table, table["vec_id"] == big + 1).collect() if r.query_id == big + 1)
    assert got == [(1, big + 2), (2, big + 3), (3, None)]


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    every = table.toPandas().sort_values("vec_id")
    v, ids = np.stack(every["embedding"].to_numpy()).astype(float), every["vec_id"].to_numpy()
    got = {}
    for r in neighbours.search(table, table["vec_id"] % 100 == 0, leaf_rows=20, visits=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((v - v[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(found & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
    assert hits >= 9 * len(got)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 7 for k in range(200, 260)) and got[9] == 8 and got[8] == 8
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_pipeline_over_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    odd.selectExpr("doc_id AS item_id", "'no such words anywhere in these few odd rows at all' AS text").limit(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, str(tmp_path)), name)
        if name != "token_output":
            assert out.columns == docs.columns, name
        docs = out
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] == seen[2] and seen[5] == seen[4]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_over_no_rows(spark, no_rows, tmp_path):
    no_rows.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    no_rows.selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
