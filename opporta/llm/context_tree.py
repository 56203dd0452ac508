"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision is predicted in the contexts of the 0 to `DEPTH` bytes before it, with
the Krichevsky-Trofimov estimate of what followed each context in training, and the estimates of all depths are mixed
with the weights of the context tree. The counts of (context, byte) strings are the whole model: Spark sums them, turns
each into the mixed log probability of its byte, and a text's score is a sum of these over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common
from opporta.llm.language import fold

DEPTH = 5
TOP = 2  # depths below this are finished on the driver: at most 256 ** TOP contexts
END = 0xFF  # closes a text and pads its start; no byte of UTF-8
TEXT_BYTES = 2_000_000  # of texts whose strings a worker holds at a time (more only for one longer text)
TABLE_ROWS = 8_000_000  # of a table sent to the workers at a time; a larger one is used in several passes
ALPHA = 0.1
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def normal(text: str) -> bytes:
    """The words of a text in lower case (A-Z only), one space between them."""
    return b" ".join(w for w in text.encode().translate(_NORMAL).split(b" ") if w)


def strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of each text and its end, packed with the bytes before it; the number of them in each text."""
    pad = bytes([END]) * depth
    flat = np.frombuffer(pad + b"".join(x for t in texts for x in (t, pad)), dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    packed = np.zeros(len(flat) - depth, dtype=np.int64)
    for k in range(depth + 1):
        packed <<= 8
        packed |= flat[k:len(flat) - depth + k]
    start = np.cumsum(size + depth - 1) - (size + depth - 1)
    keep = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return packed[keep], size


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct token of some texts, number of each token in order, and the number of tokens in each text.

    The end is the empty token.
    """
    split = pc.split_pattern(pa.array(texts, pa.binary()), pattern=b" ")
    ends = split.offsets.to_numpy()[1:]
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    full = np.array([len(t) > 0 for t in texts], dtype=bool)  # an empty text is split into one empty token
    end = distinct.index(b"") if not full.all() else len(distinct)
    code = np.insert(coded.indices.to_numpy().astype(np.int64), ends[full], end)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (distinct if end < len(distinct) else [*distinct, b""])], dtype=np.uint64)
    return hashes.view(np.int64), code, np.diff(np.r_[0, ends]) + full


def _groups(texts: list, *more: list) -> Iterator[tuple[list, ...]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > TEXT_BYTES:
            yield tuple(x[start:i] for x in (texts, *more))
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield tuple(x[start:] for x in (texts, *more))


def counts(docs: DataFrame, teaches, text: str = "text", depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Strings of all rows and tokens of all rows as `key, n`; `n` counts the rows where `teaches` holds, else 0.

    Summed in each batch, in each task, then over all tasks; what moves grows with the distinct strings of the tasks.
    """
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t or "") for t in batch.column(0).to_pylist()]
            for some, taught in _groups(texts, batch.column(1).to_pylist()):
                weight = np.array(taught, dtype=np.int64)
                packed, size = strings(some, depth)
                code, keys = pd.factorize(packed)
                yield _tallied(0, keys, code, np.repeat(weight, size))
                keys, code, size = words(some)
                yield _tallied(1, keys, code, np.repeat(weight, size))
    rows = docs.select(F.col(text).alias("t"), F.coalesce(teaches.cast("int"), F.lit(0)).alias("w"))
    both = common.stored(rows.mapInArrow(tally, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")
    return both.where("kind = 0").select("key", "n"), both.where("kind = 1 AND n > 0").select("key", "n")


def _tallied(kind: int, keys: np.ndarray, code: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    n = np.bincount(code, weights=weight, minlength=len(keys)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x > 0 (Stirling's series after eight steps up)."""
    y = x + 8
    down = np.log(np.prod([x + k for k in range(8)], axis=0)) if len(x) else x
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth: `key` = context bytes and decision, counts, log of the estimate and of the weighted probability."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None):
        self.key, self.row = np.unique(key, return_inverse=True)
        self.n0, self.n1 = (np.bincount(self.row, weights=n, minlength=len(self.key)) for n in (n0, n1))
        self.estimate = log_kt(self.n0, self.n1)
        self.weighted = self.estimate
        if below is not None:
            children = np.bincount(np.searchsorted(self.key, below[0]), weights=below[1], minlength=len(self.key))
            self.weighted = np.logaddexp(self.estimate, children) - np.log(2)

    def stop(self) -> np.ndarray:
        """Weight of the node's own estimate against its children's."""
        return np.exp(self.estimate - np.log(2) - self.weighted)

    def chance(self, ones: np.ndarray) -> np.ndarray:
        """Estimate, for every input row, that its next bit is as it is."""
        return (np.where(ones, self.n1[self.row], self.n0[self.row]) + 0.5) / (self.n0[self.row] + self.n1[self.row] + 1)


def _decisions(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Context, decision (the bits so far after a leading 1), bit and count, for the eight bits of every string."""
    byte, context = keys & 0xFF, keys >> 8
    step = np.arange(8)
    decision = (1 << step[None, :]) | (byte[:, None] >> (8 - step)[None, :])
    return np.repeat(context, 8), decision.ravel(), ((byte[:, None] >> (7 - step)[None, :]) & 1).ravel().astype(bool), np.repeat(n, 8)


def _drop(key: np.ndarray, depth: int) -> np.ndarray:
    """Keys of the parents, whose context has `depth` bytes."""
    return key & ((1 << 8 * (depth + 1)) - 1)


def _tree(keys: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Level], np.ndarray]:
    """Levels `top` to `depth` over some strings, all of them that share their nearest `top` context bytes."""
    context, decision, bit, many = _decisions(keys, n)
    levels: list[Level] = []
    below = None
    for d in range(depth, top - 1, -1):
        key = _drop(context << 8 | decision, d)
        levels.append(Level(key, np.where(bit, 0, many), np.where(bit, many, 0), below))
        below = (_drop(levels[-1].key, d - 1), levels[-1].weighted) if d > top else None
    return levels[::-1], bit


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for b in batches:
        keys.append(b["key"].to_numpy())
        n.append(b["n"].to_numpy())
    return np.concatenate(keys), np.concatenate(n)


def model(table: DataFrame, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """Log10 probability of the last byte of every string after the bytes before it, as `key, logp`.

    Strings are dealt by the `top` bytes before the last one, so that a task holds whole subtrees; a task's share grows
    with the distinct strings only. What lies nearer the root is finished on the driver, 256 ** top contexts at most.
    """
    spark = table.sparkSession
    near = F.shiftright("key", 8).bitwiseAND((1 << 8 * top) - 1)
    dealt = table.withColumn("near", near).repartition("near").select("key", "n")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if len(keys):
            level = _tree(keys, n, depth, top)[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.key, level.n0, level.n1, level.weighted)], names=["key", "n0", "n1", "weighted"])
    found = dealt.mapInArrow(roots, "key bigint, n0 double, n1 double, weighted double").toPandas().sort_values("key")
    upper: list[Level] = []
    below = (_drop(found["key"].to_numpy(), top - 1), found["weighted"].to_numpy())
    n0, n1 = found["n0"].to_numpy(), found["n1"].to_numpy()
    key = found["key"].to_numpy()
    for d in range(top - 1, -1, -1):
        upper.append(Level(_drop(key, d), n0, n1, below))
        below = (_drop(upper[-1].key, d - 1), upper[-1].weighted) if d else None
    # p = given + rest * (probability at depth `top`), for each node at depth top - 1 and either bit
    given, rest = {True: 0.0, False: 0.0}, 1.0
    for level in upper[::-1]:
        stop = level.stop()[level.row]
        for one in (True, False):
            given[one] = given[one] + rest * stop * level.chance(np.full(len(key), one))
        rest = rest * (1 - stop)
    sent = spark.sparkContext.broadcast((key, given[True], given[False], rest))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gathered(batches)
        if not len(keys):
            return
        levels, bit = _tree(keys, n, depth, top)
        p = levels[-1].chance(bit)
        for level in levels[-2::-1]:
            stop = level.stop()[level.row]
            p = stop * level.chance(bit) + (1 - stop) * p
        known, one, zero, left = sent.value
        at = np.searchsorted(known, levels[0].key)[levels[0].row]
        p = np.where(bit, one[at], zero[at]) + left[at] * p
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.log10(p).reshape(-1, 8).sum(axis=1))], names=["key", "logp"])
    return dealt.mapInArrow(scored, "key bigint, logp double")


def _sorted(table: DataFrame, value: str, kind) -> tuple[np.ndarray, np.ndarray]:
    got = table.select("key", value).toArrow()
    key, what = got["key"].to_numpy(), got[value].to_numpy()
    what = what.astype(np.int32 if kind is np.int64 and what.max(initial=0) < 1 << 31 else kind)
    order = np.argsort(key)
    return key[order], what[order]


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values of keys, 0 for those that are not in the table."""
    if not len(table[0]):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


RESULT = "struct<n_tokens: bigint, n_known: bigint, base: double, score: double>"


def scores(docs: DataFrame, teaches, text: str = "text", depth: int = DEPTH) -> tuple[DataFrame, str, int]:
    """Add a struct column (`n_tokens, n_known, base, score`) to every row; frame, its name, number of training tokens.

    The score is the log10 probability of the text's words in lower case, one space between them, and its end. A null
    text is empty: only the end is scored. With no training text every bit has probability one half. Tables of the model
    are sent to the workers up to `TABLE_ROWS` rows; larger ones are used in parts, a pass over the documents for each.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    table, tokens = counts(docs, teaches, text, depth)
    total = tokens.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    all_tokens, distinct = total.n or 0, total.v
    logp = common.stored(model(table, depth), "ctw-model")
    parts = max(1, -(-max(logp.count(), distinct) // TABLE_ROWS))
    scale = np.log10(all_tokens + ALPHA * (distinct + 1))
    name, th = common.free_name(docs, "ctw"), common.free_name(docs, "ctw_th")
    done = []
    for k in range(parts):
        share = F.pmod(F.xxhash64("key"), F.lit(parts)) == k
        sent = spark.sparkContext.broadcast((_sorted(logp.where(share), "logp", np.float64), _sorted(tokens.where(share), "n", np.int64)))
        scored = F.arrow_udf(_scorer(sent, scale, depth, k == 0), RESULT).asNondeterministic()(F.col(text))
        if parts == 1:
            return docs.withColumn(name, scored), name, all_tokens
        done.append(common.stored(docs.select(F.xxhash64(text).alias(th), scored.alias("r")).dropDuplicates([th]), "ctw-part"))
        sent.unpersist()
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    summed = whole.groupBy(th).agg(*[F.sum(f"r.{c}").alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    out = docs.withColumn(th, F.xxhash64(text)).join(summed.select(th, F.struct("n_tokens", "n_known", "base", "score").alias(name)), th, "left").drop(th)
    return out, name, all_tokens


def _scorer(sent, scale: float, depth: int, first: bool):
    """Sums over what is in this part of the tables; tokens that are in no part are counted with the first one."""
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logp, tokens = sent.value
        for batch in batches:
            texts, rows = [normal(t or "") for t in batch.to_pylist()], []
            for (some,) in _groups(texts):
                packed, size = strings(some, depth)
                code, keys = pd.factorize(packed)
                score = np.add.reduceat(_found(logp, keys)[code], np.cumsum(size) - size)
                keys, code, many = words(some)
                seen = _found(tokens, keys)[code]
                begin = np.cumsum(many) - many
                known = np.add.reduceat((seen > 0).astype(np.int64), begin)
                base = np.add.reduceat(np.log10(seen + ALPHA) - np.log10(ALPHA), begin) + (first * many) * (np.log10(ALPHA) - scale)
                rows.append((first * many, known, base, score))
            n, known, base, score = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int),) * 4
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
                                             names=["n_tokens", "n_known", "base", "score"])
    return score


def report(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of every row; rows of fold 0, and those without an id, are held out of training."""
    held = F.coalesce(fold("doc_id", folds) == 0, F.lit(True))
    out, name, tokens = scores(docs.select("doc_id", "text"), ~held)
    return out.select("doc_id", held.alias("held_out"), f"{name}.n_tokens", f"{name}.n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
                      F.col(f"{name}.base").alias("base_score"), f"{name}.score")
