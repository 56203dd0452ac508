"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

Every `LENGTH`-byte string holds a suffix chosen by its content: the one whose first bytes have the smallest hash among
the first `WINDOW` starts. Equal strings choose equal suffixes at equal places, so only chosen suffixes are indexed, about
two in `WINDOW`, by their first 8 bytes and a digest of the part that all strings choosing them share. A batch of
documents gets a sorted table of them, which is merge-joined with the existing levels to find what is repeated; two
levels of one size merge into one of twice the size.

Strings that chose one repeated suffix differ only in how far they reach to its left and right. If all that they cover
is repeated, all of them are, and one place stands for its copies; other places are compared offset by offset among
those that share the suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common

LENGTH = 400
WINDOW = 192
SHARED = LENGTH - WINDOW + 1  # bytes from a chosen suffix's start that every string choosing it has
GRAM = 16  # bytes that are hashed to choose
BATCHES = 4
TEXT_BYTES = 2_000_000  # of texts whose suffixes are chosen at a time (more only for one longer text)
HOT = 20_000  # suffixes with more unequal surroundings are compared through a shuffle, not in a task
_CHOSEN = "doc_id bigint, th bigint, head bigint, digest bigint, whole bigint, low bigint, high bigint, at bigint"
_KEY = ["head", "digest"]


def chosen(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, start of the suffix, first and last start of the strings that choose it, all within the text."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(texts) + bytes(GRAM), dtype=np.uint8)
    long = np.flatnonzero(size >= LENGTH)
    many = size[long] - LENGTH + 1
    if not len(long):
        return (np.zeros(0, dtype=np.int64),) * 4
    eight = np.ndarray(shape=(len(flat) - 7,), dtype="<u8", buffer=flat.data, strides=(1,))
    mixed = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed += eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    least = (mixed >> np.uint64(32) << np.uint64(32)) | np.arange(len(mixed), dtype=np.uint64)  # ties: the first
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[:width - WINDOW], least[WINDOW - width:])
    p = np.repeat(start[long] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    owner = np.repeat(long, many)
    at = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    who = owner[first]
    return who, at[first] - start[who], p[first] - start[who], p[last] - start[who]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > TEXT_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def suffixes(docs: DataFrame, text: str = "text") -> DataFrame:
    """The chosen suffixes of every row `doc_id, th, text`: `whole` is a digest of all that its strings may cover."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = [t.encode() for t in batch["text"].to_pylist()]
            for a, b in _groups(texts):
                some = texts[a:b]
                who, at, low, high = chosen(some)
                heads, shared, whole = [], [], []
                for i, s in zip(who.tolist(), at.tolist(), strict=True):
                    t = some[i]
                    left = max(0, s - WINDOW + 1)
                    heads.append(int.from_bytes(t[s:s + 8]))
                    shared.append(digest(t[s:s + SHARED]))
                    whole.append(digest(t[left:s + LENGTH], s - left))
                row = pa.array(who + a)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(row), batch["th"].take(row), _signed(heads), _signed(shared), _signed(whole), pa.array(low), pa.array(high), pa.array(at)],
                                                 names=[x.split()[0] for x in _CHOSEN.split(", ")])
    return docs.where(F.octet_length(text) >= LENGTH).mapInArrow(choose, _CHOSEN)


class Levels:
    """The index family: sorted tables of suffix keys, of which no two hold equally many batches."""

    def __init__(self):
        self.held: dict[int, DataFrame] = {}

    def scan(self, batch: DataFrame) -> list[DataFrame]:
        """Keys of a batch that an existing level has, for each level: a merge join of two sorted tables."""
        return [batch.select(*_KEY).hint("merge").join(level, _KEY) for level in self.held.values()]

    def add(self, batch: DataFrame) -> None:
        size, level = 1, batch.select(*_KEY)
        while size in self.held:
            level = self.held.pop(size).union(level).distinct()
            size *= 2
        self.held[size] = _by_key(level, f"suffix-level-{size}") if size > 1 else level


def _by_key(keys: DataFrame, name: str) -> DataFrame:
    return common.stored(keys.repartition(*_KEY).sortWithinPartitions(*_KEY), name)


def repeated(found: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, Levels]:
    """Keys that occur more than once in `found`, and the family of levels after all batches."""
    levels, again = Levels(), []
    for k in range(batches):
        own = found.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches)) == k)
        batch = common.stored(own.groupBy(*_KEY).agg(F.count("*").alias("n")).sortWithinPartitions(*_KEY), "suffix-batch")
        again += [batch.where("n > 1").select(*_KEY), *levels.scan(batch)]
        levels.add(batch)
    keys = again[0]
    for more in again[1:]:
        keys = keys.union(more)
    return common.stored(keys.distinct(), "suffix-repeated"), levels


def _surroundings(rows: DataFrame) -> DataFrame:
    """For rows `doc_id, th, text, places`: what lies left and right of the shared part of each place's suffix."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t, places = batch["text"][k].as_py().encode(), batch["places"][k].as_py()
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["doc_id"][k].as_py()] * n, pa.int64()), pa.array([batch["th"][k].as_py()] * n, pa.int64()), *[pa.array([p[x] for p in places], pa.int64()) for x in (*_KEY, "low", "high", "at")],
                     pa.array([t[max(0, p["at"] - WINDOW + 1):p["at"]] for p in places], pa.binary()), pa.array([t[p["at"] + SHARED:p["at"] + LENGTH] for p in places], pa.binary())],
                    names=["doc_id", "th", *_KEY, "low", "high", "at", "left", "right"])
    return rows.mapInArrow(cut, "doc_id bigint, th bigint, head bigint, digest bigint, low bigint, high bigint, at bigint, left binary, right binary")


def _prefix_hashes(parts: list[bytes], backwards: bool) -> np.ndarray:
    """Hash of the nearest 0, 1, ... `WINDOW` - 1 bytes of each part, one column for each number of bytes."""
    wide = np.zeros((len(parts), WINDOW - 1), dtype=np.uint64)
    for i, x in enumerate(parts):
        one = np.frombuffer(x, dtype=np.uint8)
        wide[i, :len(one)] = (one[::-1] if backwards else one)[:WINDOW - 1]
    out = np.zeros((len(parts), WINDOW), dtype=np.uint64)
    for k in range(WINDOW - 1):
        out[:, k + 1] = (out[:, k] + wide[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 if backwards else 0xD6E8FEB86659FD93)
        out[:, k + 1] ^= out[:, k + 1] >> np.uint64(31)
    return out


def _string_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every string of every place and the place's number; strings by falling start."""
    low, high, at = (batch[x].to_numpy() for x in ("low", "high", "at"))
    left, right = _prefix_hashes(batch["left"].to_pylist(), True), _prefix_hashes(batch["right"].to_pylist(), False)
    many = high - low + 1
    row = np.repeat(np.arange(len(many)), many)
    offset = np.repeat(at - high, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = (batch["head"].to_numpy().view(np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ batch["digest"].to_numpy().view(np.uint64)
    mixed = (left[row, offset] * np.uint64(0xE7037ED1A0B428DB)) ^ (right[row, WINDOW - 1 - offset] + key[row])
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x8EBC6AF09C88C6E3) + offset.astype(np.uint64)
    return (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x589965CC75374CC3), row


def _compared(places: DataFrame) -> DataFrame:
    """Starts `low` to `high` of repeated strings, among places with the same suffix, which are all in one task."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            head, digest = batch["head"].to_numpy(), batch["digest"].to_numpy()
            cut = np.flatnonzero((head[1:] != head[:-1]) | (digest[1:] != digest[:-1])) + 1
            whole = len(held) and batch.num_rows and (held[-1]["head"][-1] != batch["head"][0] or held[-1]["digest"][-1] != batch["digest"][0])
            end = int(cut[-1]) if len(cut) else 0
            if whole or end:
                yield from _repeats(held + [batch.slice(0, end)])
                held = []
            held.append(batch.slice(end))
        yield from _repeats(held)
    dealt = places.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(compare, "doc_id bigint, th bigint, low bigint, high bigint")


def _repeats(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
    if rows is None:
        return
    batch = rows.combine_chunks().to_batches()[0]
    hashes, row = _string_hashes(batch)
    _, code, n = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = n[code] > 1
    edge = np.r_[True, (twice[1:] != twice[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(edge)
    last = np.r_[first[1:], len(row)] - 1
    first, last = first[twice[first]], last[twice[first]]
    who = row[first]
    begin = np.searchsorted(row, who)
    top = batch["high"].to_numpy()[who]
    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(who)), batch["th"].take(pa.array(who)), pa.array(top - (last - begin)), pa.array(top - (first - begin))],
                                     names=["doc_id", "th", "low", "high"])


def _compared_widely(places: DataFrame) -> DataFrame:
    """The same for suffixes of very many places: a row for each string, counted with map-side sums."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                hashes, row = _string_hashes(part)
                start = part["high"].to_numpy()[row] - (np.arange(len(row)) - np.searchsorted(row, row))
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(row)), part["th"].take(pa.array(row)), pa.array(start), pa.array(hashes.view(np.int64))], names=["doc_id", "th", "low", "hash"])
    strings = common.stored(places.mapInArrow(spread, "doc_id bigint, th bigint, low bigint, hash bigint"), "suffix-strings")
    twice = common.stored(strings.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "suffix-twice")
    return strings.join(twice, "hash").select("doc_id", "th", "low", F.col("low").alias("high"))


def repeats(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """Starts `low` to `high` of strings of rows `doc_id, th, text` that also start anywhere else."""
    found = common.stored(suffixes(docs), "suffixes")
    keys, _ = repeated(found, batches)
    again = common.stored(found.join(keys, _KEY), "suffix-again")
    whole = common.stored(again.groupBy("whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at", *_KEY, "low", "high")).alias("first")), "suffix-whole")
    alone = whole.where("n = 1").select("first.*")
    stands_for = whole.where("n > 1").select("first.*").join(alone.select(*_KEY).distinct(), _KEY, "left_semi").select(*alone.columns)
    partly = alone.union(stands_for).groupBy("doc_id", "th").agg(F.collect_list(F.struct(*_KEY, "low", "high", "at")).alias("places"))  # no more than the text has
    texts = docs.join(partly.withColumnsRenamed({"doc_id": "id_", "th": "th_"}), docs["doc_id"].eqNullSafe(F.col("id_")) & (docs["th"] == F.col("th_"))).dropDuplicates(["doc_id", "th"])
    near = common.stored(_surroundings(texts.select("doc_id", "th", "text", "places")), "suffix-surroundings")
    common_keys = near.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*_KEY)
    out = again.join(whole.where("n > 1").select("whole"), "whole").select("doc_id", "th", "low", "high")
    if common_keys.isEmpty():
        return out.union(_compared(near))
    common_keys = common.stored(common_keys, "suffix-hot")
    return out.union(_compared(near.join(common_keys, _KEY, "left_anti"))).union(_compared_widely(near.join(common_keys, _KEY)))


def _removed(text: pa.Array, runs: pa.Array) -> pa.Array:
    """Removed spans of bytes and what is left."""
    rows = []
    for t, found in zip(text.to_pylist(), runs.to_pylist(), strict=True):
        raw, spans = (t or "").encode(), []
        for r in sorted(found or [], key=lambda r: r["low"]):
            if spans and r["low"] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], r["high"] + LENGTH)
            else:
                spans.append([r["low"], r["high"] + LENGTH])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
        rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept,
                     "spans": [{"start": a, "end": b} for a, b in spans]})
    return pa.array(rows, type=pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
                                          ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, hot: int = HOT) -> tuple[DataFrame, str]:
    """All rows and columns of `docs` with a struct (`n_bytes, n_removed, kept_sha256, kept, spans`); frame and its name.

    Removed is every byte covered by a string of `LENGTH` bytes that also starts anywhere else, in the same text too.
    Strings are judged on the input. Offsets count bytes of the UTF-8 text; what is left need not be valid UTF-8. A null
    text is empty. Rows with the same id and text share their result.
    """
    common.bound_batches(docs.sparkSession)
    id_, th, runs = (common.free_name(docs, x) for x in ("suffix_id", "suffix_th", "suffix_runs"))
    name = common.free_name(docs, "suffix_dedup")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = repeats(rows, batches, hot).groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.collect_list(F.struct("low", "high")).alias(runs))
    out = docs.join(found, F.col(f"`{doc_id}`").cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(th)), "left")
    made = F.arrow_udf(_removed, "struct<n_bytes: bigint, n_removed: bigint, kept_sha256: string, kept: binary, spans: array<struct<start: bigint, end: bigint>>>").asNondeterministic()
    return out.withColumn(name, made(F.col(text), runs)).drop(id_, th, runs), name


def report(docs: DataFrame) -> DataFrame:
    out, name = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", F.size(f"{name}.spans").cast("bigint").alias("n_spans"), f"{name}.kept_sha256")
