"""Huffman codes and token files: optimal, canonical, and an exact round trip."""

import glob
import heapq
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opporta.llm import token_files
from tests.llm.conftest import ODD, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_files_give_back_every_id(odd):
    want = sorted(token_files.brute([(i, t) for i, t, *_ in ODD], PATH), key=repr)
    got = [tuple(r) for r in token_files.report(odd).collect()]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    before = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == before
        before += n
    ids = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_files_are_in_ascending_order(spark, odd, tmp_path, monkeypatch):
    """Read file by file in name order, every block starts where the one before ended."""
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    docs = odd.select("doc_id", "text").union(spark.range(100, 160).selectExpr("id", "repeat(concat('w', id, ' '), 200)")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(docs, f"{tmp_path}/t", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{tmp_path}/t/blocks/part-*.parquet"))
    blocks = [r for f in files for r in pq.read_table(f, columns=["start", "doc_ids", "sizes"]).to_pylist()]
    ends = [b["start"] + sum(b["sizes"]) for b in blocks]
    assert len(files) > 1 and len(blocks) > 30 and [b["start"] for b in blocks] == [0, *ends[:-1]]
    ids = [i for b in blocks for i in b["doc_ids"]]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


@pytest.fixture(scope="module")
def cache():
    return token_files.WordCache(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="ab \n\t.,'s 　é<|endoftext|>\x00\x1c1")), max_size=6))
def test_word_cache_equals_whole_encoding(cache, texts):
    ids, many = cache.encode(pa.array(texts, pa.string()))
    want = [cache.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert many.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_many_words_take_little_memory_beside_their_ids(cache):
    """Places of words are held for some words at a time, not for all of a part; so are windows of coded bits."""
    texts = pa.array([prose(1_000, k) for k in range(1_500)])
    cache.encode(texts)
    tracemalloc.start()
    ids, _ = cache.encode(texts)
    encoding = tracemalloc.get_traced_memory()[1]
    lengths = token_files.code_lengths(np.bincount(ids))
    codes = token_files.canonical(lengths)
    packed = [token_files.pack(ids[a:a + 16_384], lengths, codes) for a in range(0, len(ids), 16_384)]
    blocks, marks = zip(*packed, strict=True)
    counts, table = [len(ids[a:a + 16_384]) for a in range(0, len(ids), 16_384)], token_files.decoding_table(lengths, codes)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    back = token_files.unpack([*blocks], [*marks], counts, table)
    decoding = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert (back == ids).all() and encoding < 30 * len(ids) and decoding < 17 * len(ids)


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60))
def test_lengths_are_optimal_and_blocks_decode(counts):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == (counts > 0).tolist()
    if len(used) > 1:
        assert np.sum(2.0 ** -used) == 1
        assert int((lengths * counts).sum()) == huffman_cost(counts.tolist())
    if counts.sum():
        codes = token_files.canonical(lengths)
        ids = np.repeat(np.arange(len(counts)), counts)[::-1][:3000].astype(np.uint32)
        np.random.default_rng(1).shuffle(ids)
        table = token_files.decoding_table(lengths, codes)
        blocks = [token_files.pack(x, lengths, codes) for x in (ids, ids[:1], ids[:777])]
        got = token_files.unpack([b for b, _ in blocks], [m for _, m in blocks], [len(ids), 1, len(ids[:777])], table)
        assert got.tolist() == [*ids, *ids[:1], *ids[:777]]


def test_lengths_keep_to_the_limit():
    counts = np.array([2**k for k in range(40)])
    lengths = token_files.code_lengths(counts, 8)
    assert lengths.max() <= 8 and np.sum(2.0 ** -lengths.astype(float)) <= 1
    assert (np.diff(lengths.astype(int)) <= 0).all()
