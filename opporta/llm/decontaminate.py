"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm.common import bound_batches, free_name, worker_state

WINDOW = 10
SHARD_BYTES = 8_000_000  # of benchmark text in one automaton
SPANS = "array<struct<start: bigint, end: bigint, first: bigint, after: bigint>>"
FOUND = f"struct<n_words: bigint, item_ids: array<string>, spans: {SPANS}>"
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("after", pa.int64())]))
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", _SPANS_TYPE)])
# A word is a run of bytes other than these ASCII ones, after A-Z became a-z.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def _windows(text: str, window: int) -> set[tuple[bytes, ...]]:
    found = words(text)
    if len(found) <= window:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + window]) for i in range(len(found) - window + 1)}


def _automaton(items: list[tuple[str, str]], window: int) -> tuple:
    """Automaton over word numbers, with the length and the items of each pattern, and the numbers of the words."""
    owners: dict[tuple, list[str]] = {}
    for item, text in items:
        for w in _windows(text, window):
            owners.setdefault(w, []).append(item)
    number: dict[bytes, int] = {}
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, names in owners.items():
        machine.add_word(tuple(number.setdefault(w, len(number) + 1) for w in pattern), (len(pattern), names))
    if not owners:
        return None, number
    machine.make_automaton()
    return machine, number


def _covered(machine, number: dict[bytes, int], found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged runs [first, after) of words inside any occurrence, and the items that occur."""
    runs: list[tuple[int, int]] = []
    names: set[str] = set()
    get = number.get
    for last, (length, owners) in machine.iter(tuple([get(w, 0) for w in found])):
        runs.append((last - length + 1, last + 1))
        names.update(owners)
    return merged(runs), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open runs, in order; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for first, after in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with their character offsets in the original text."""
    raw, at, ends = text.encode(), 0, []
    normal = raw.translate(_NORMAL)
    for w in normal.split():
        at = normal.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    return [{"start": len(raw[:ends[a][0]].decode()), "end": len(raw[:ends[b - 1][1]].decode()), "first": a, "after": b} for a, b in runs]


def _scanner(sent, window: int):
    @F.arrow_udf(FOUND)
    def scan_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key, items = sent.value
        machine, number = worker_state("automaton", key, lambda: _automaton(items, window))
        for batch in batches:
            rows = []
            for value in batch:
                text = value.as_py() or ""
                found = words(text)
                runs, names = _covered(machine, number, found) if machine and found else ([], set())
                rows.append({"n_words": len(found), "item_ids": sorted(names), "spans": _spans(text, runs) if runs else []})
            yield pa.array(rows, type=_FOUND_TYPE)
    return scan_texts.asNondeterministic()  # evaluated once, also where a filter follows


def _joined(parts: pa.Array) -> pa.Array:
    """Spans found by several scans of one text, merged."""
    rows = []
    for found in parts.to_pylist():
        starts = {s["first"]: s["start"] for one in found for s in one}
        ends = {s["after"]: s["end"] for one in found for s in one}
        rows.append([{"start": starts[a], "end": ends[b], "first": a, "after": b} for a, b in merged([(s["first"], s["after"]) for one in found for s in one])])
    return pa.array(rows, type=_SPANS_TYPE)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """Add a struct column (`n_words, n_hit, item_ids, spans`) to every row of `docs`; returns the frame and its name.

    A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Texts are
    scanned once, words as symbols, so the automaton's offsets are word numbers; `spans` maps merged runs of hit words
    to character offsets of the original text. A null text has no words. A null item id counts as the id "". Repeated
    items and ids count once per id. All columns of `docs` stay, whatever their names.

    Test items are broadcast in shards of at most `shard_bytes` of text (more only for one longer item), one scan for
    each shard, so a worker's memory does not grow with the benchmark. No row of `docs` is shuffled.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = 1 if total <= shard_bytes else -(-total // (shard_bytes // 2))
    out, parts = docs, []
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) if shards > 1 else items
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.i, r.t) for r in mine.toLocalIterator())))
        parts.append(free_name(out, f"decontamination_{k}"))
        out = out.withColumn(parts[-1], _scanner(sent, window)(F.col(text)))
    name, spans = free_name(out, "decontamination"), free_name(out, "hit_spans")
    out = out.withColumn(spans, F.col(f"{parts[0]}.spans") if shards == 1 else F.arrow_udf(_joined, SPANS)(F.array(*[f"{p}.spans" for p in parts])))
    return out.withColumn(name, F.struct(
        F.col(f"{parts[0]}.n_words").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, r: s + r["after"] - r["first"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[f"{p}.item_ids" for p in parts])))).alias("item_ids"),
        F.transform(spans, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))).drop(spans, *parts), name


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of `docs` without any hit word; same columns."""
    out, name = scan(docs, benchmark, **options)
    return out.where(F.col(f"{name}.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of `docs`: counts, a digest of the items found, the verdict, and the spans."""
    out, name = scan(docs, benchmark)
    ids = F.col(f"{name}.item_ids")
    return out.select("doc_id", f"{name}.n_words", f"{name}.n_hit", F.size(ids).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col(f"{name}.n_hit") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, win.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
