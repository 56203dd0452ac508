"""Merkle manifest, SentencePiece encoding and whitening against plain versions of them."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from opporta.llm import merkle, pieces, whitening

GIVEN = "/root/testdata/sf0.01"


def h(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def plain_manifest(rows):
    """Rows `doc_id, source, lang, n_chars, text` -> what `merkle.report` returns, without equal ids inside a source."""
    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def levels(hs):
        out = [hs]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def climb(out, at, own):
        others = []
        for level in out[:-1]:
            run = level[at // 16 * 16:at // 16 * 16 + 16]
            k = at % 16
            others += run[:k] + run[k + 1:]
            own = h(*run[:k], own, *run[k + 1:])
            at //= 16
        return others, own
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for k, row in enumerate(groups[s]):
            found = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                found = leaf((*row[:4], row[4].translate(str.maketrans(merkle.UPPER, merkle.LOWER))))
            low, own = climb(trees[s], k, found)
            high, own = climb(top, g, own)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], h(*low, *high), own, own == top[-1][0]))
    return out


@pytest.mark.parametrize("sizes", [[1], [2], [16, 1], [17, 5, 1], [256, 257, 3], [4097, 20] + [1] * 20])
def test_manifest_equals_a_plain_tree(spark, sizes):
    rows = [(100 * k + s, None if s == 2 else f"s{s}", "en", k, None if k % 7 == 3 else f"Text {k} ÄB") for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert sorted(map(tuple, merkle.report(docs).collect())) == sorted(plain_manifest(rows))


def test_manifest_of_odd_rows(odd, no_rows):
    rows = [tuple(r)[:5] for r in odd.select(*merkle.FIELDS).collect()]
    got = [tuple(r) for r in merkle.report(odd.withColumnRenamed("fp", "leaf").withColumnRenamed("language", "g")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_manifest(rows)))
    assert merkle.report(no_rows).count() == 0


def test_a_proof_leads_from_its_leaf_to_the_root_and_no_other_leaf_does(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    rows = merkle.proofs(docs).select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("own"), merkle.folded(F.lit("0" * 64), F.col("path")).alias("other"))
    assert rows.where("own <> root or other = root").count() == 0


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(public_tokenizers.path(pieces.MODEL))


def noisy(n):
    rnd = random.Random(3)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "é", "日本", "中", "\x00", "½", "🙂", "ﬁ", "the", "ing", " of", "　", "\t", "<s>", "</s>", "<0x0A>", "한", "하", "ｱﾞ", "​", "﻿", "IV²", "..."]
    return ["", " ", "  \n ", "a" * 3000, " " * 500, "日本語" * 500, "x▁" * 200] + ["".join(rnd.choices(parts, k=rnd.randint(1, 60))) for _ in range(n)]


def test_ids_and_spans_are_those_of_the_library(coder):
    for text in noisy(600):
        ids, begins, ends = coder.encoded(text)
        proto = coder.processor.encode(text, return_type="proto")
        assert ids.tolist() == coder.processor.encode(text, add_eos=True)
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[:-1] == [(p.begin, p.end) for p in proto.pieces]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_normalisation_and_alignment_are_those_of_the_library(rule, trim):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    own = pieces.Normaliser(library.serialized_normalizer_spec())
    for text in noisy(400):
        want, places = library.normalize(text, with_offsets=True)
        got, align = own.normalised(text.encode())
        starts = [k for k in range(len(got)) if got[k] & 0xC0 != 0x80] + [len(got)]
        assert got.decode() == want and [len(text.encode()[:align[k]].decode()) for k in starts] == list(places)


def test_other_models_are_refused(tmp_path, coder):
    with open(public_tokenizers.path(pieces.MODEL), "rb") as f:
        model = f.read()
    (tmp_path / "bad.model").write_bytes(model[: len(model) // 2])
    with pytest.raises((ValueError, IndexError, RuntimeError)):
        pieces.Coder(str(tmp_path / "bad.model"))


def test_pieces_of_odd_and_given_documents(spark, odd, no_rows, coder):
    path = public_tokenizers.path(pieces.MODEL)
    for docs in (odd.withColumnRenamed("fp", "pieces").withColumnRenamed("language", "decoded_text"), spark.read.parquet(f"{GIVEN}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = coder.processor.encode(r.text or "", add_eos=True)
            raw = (r.text or "").encode()
            want.append((r.doc_id, len(ids), h(" ".join(map(str, ids))), h(coder.processor.decode(ids)), len(raw), len(raw)))
        assert sorted(map(repr, map(tuple, pieces.report(docs).collect()))) == sorted(map(repr, want))
    assert pieces.report(no_rows).count() == 0
    coded, name = pieces.encoded(odd, path)
    assert coded.where(F.col(name).isNull() != F.col("text").isNull()).count() == 0


def plain_whitening(vectors):
    """n, sums and covariance by Python integers, eigenvectors by numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    w = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], dtype=object)
    cov = (w.T @ w).astype(np.float64) / float(n) ** 3
    values, vecs = np.linalg.eigh(cov)
    return n, sums, x, values[::-1], vecs[:, ::-1], np.trace(cov)


def same_as_plain(rows, vectors, ids):
    n, sums, x, values, vecs, trace = plain_whitening(vectors)
    keep = sum(values[:16] > len(values) * 2.0**-52 * values[0])
    got = collections.defaultdict(dict)
    for r in rows:
        got[r.vec_id][r.component] = r
    assert set(got) == set(ids) and all(sorted(v) == list(range(1, keep + 1)) for v in got.values())
    flips = {}
    for vec_id, v in zip(ids, x, strict=True):
        w = [n * c - s for c, s in zip(v, sums, strict=True)]
        for k, r in got[vec_id].items():
            want = float(np.dot(np.array(w, dtype=float) / n, vecs[:, k - 1]) / np.sqrt(values[k - 1]))
            if k not in flips and abs(want) > 1e-3:
                flips[k] = 1 if want * r.whitened > 0 else -1
            assert (r.n, r.deviation) == (n, sum(c * c for c in w)) and r.identity_error < 1e-9
            assert abs(r.whitened * flips.get(k, 1) - want) < 1e-6 * max(1, abs(want)) and abs(r.explained - values[k - 1] / trace) < 1e-9


def test_whitening_of_given_vectors(spark):
    table = spark.read.parquet(f"{GIVEN}/embeddings.parquet")
    rows = table.collect()
    same_as_plain(whitening.report(table).collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    fine = [(k, rng.normal(size=5).tolist()) for k in range(40)] + [(50, [1.0] * 5), (51, [1.0] * 5), (52, [1.0] * 5)]
    odd = [(60, None), (61, []), (62, [1.0, None, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (64, [float("inf")] * 5), (65, [1.0]), (66, [1e300] * 5)]
    table = spark.createDataFrame(fine + odd, "vec_id bigint, embedding array<double>").withColumn("z", F.lit(1)).withColumn("component", F.lit("x"))
    same_as_plain(whitening.report(table).collect(), [v for _, v in fine], [k for k, _ in fine])
    null_id = spark.createDataFrame([(None, v) for _, v in fine], table.drop("z", "component").schema)
    assert whitening.report(null_id).where("vec_id is null").count() == 5 * len(fine)
    assert whitening.report(table.limit(0)).count() == 0
    assert whitening.report(table.where("vec_id = 3")).count() == 0 and whitening.report(table.where("vec_id >= 50 and vec_id < 60")).count() == 0
    two = whitening.report(table.where("vec_id in (1, 2)")).collect()
    assert sorted((r.component, round(abs(r.whitened), 9)) for r in two) == [(1, 1.0), (1, 1.0)]
    huge = spark.createDataFrame([(1, [2.0**54, 0.0]), (2, [0.0, 2.0**53]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert {(r.deviation, r.n) for r in whitening.report(huge).collect()} == {(None, 3)}


@pytest.mark.parametrize("width", [0.0, 1e-16, 1e-13, 1e-9, 1e-5])
def test_clustered_eigenvalues_are_told_apart(width):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(24, dtype=q.dtype) - q.T @ q) / 2
    values = np.linspace(3, 1, 24).astype(np.longdouble)
    values[6:12] = 2 - width * np.arange(6).astype(np.longdouble)
    order = np.argsort(-values)
    values, q = values[order], q[:, order]
    found, vecs = whitening.eigen((q * values) @ q.T)
    assert np.abs(found - values).max() < 1e-17 and np.abs(vecs.T @ vecs - np.eye(24)).max() < 1e-18
    error = np.abs(np.abs((q * vecs).sum(axis=0)) - 1)
    assert error[values != 2].max() < 1e-12 if width >= 1e-13 else error[(values > 2.05) | (values < 1.95)].max() < 1e-15


def test_products_and_centring_are_exact():
    rng = np.random.default_rng(2)
    for bits in (3, 20, 45, 61):
        w = rng.integers(-2**bits, 2**bits, (500, 4))
        assert (whitening.exact_gram(w) == w.astype(object).T @ w.astype(object)).all()
        z = whitening.centred(w, 10**9, [5, -7, 2**60, 0])
        assert (z.astype(object) == w.astype(object) * 10**9 - np.array([5, -7, 2**60, 0], dtype=object)).all()
        assert (whitening.exact_gram(z) == z.astype(object).T @ z.astype(object)).all()
