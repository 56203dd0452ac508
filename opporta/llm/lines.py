"""Substring dedup by hashed units: of a repeated line or sentence of a line only the earliest stays.

A text is cut at line ends, and a line after its sentence ends, so that a passage spliced into a line is seen too. Units
are normalised (lower case, white space as one space), their digests are grouped over all documents, the earliest by
document id and offset is kept, and the rest is removed by its offsets in the original text.

`kind="all"` digests every word: whole lines of any length, and around every sentence the shortest run of sentences of its
line, forwards and backwards, that has the least number of words. A run of repeated sentences with that many words then
goes entirely, whatever stands around it. Passages cut inside sentences or over line ends are found by runs of words
between content-chosen places: any 50 words of a text hold at least one such run (periodic texts apart). `kind="lines"` digests whole
lines of any length and nothing else, `kind="sentences"` only sentences of the least number of words; SQL can express these two.

Defined results: null texts stay null and have no units; empty and blank lines are no units; null ids rank last; rows with the
same id and text are one document and keep the same units; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common

UNIT = re.compile(r"[^\n.?]+[.?!]*")  # an exclamation mark alone ends none: some texts have one after every word
LEAST_WORDS = 8  # shorter units repeat by chance and stay
GRAM, REACH = 8, 21  # words at a content-chosen place, places of which the one with the smallest hash is chosen
WORD = re.compile(r"\S+")
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(1, GRAM + 1)]


def runs(text: str, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, str]]:
    """`start, end, normalised text` of every line with a word, and of the shortest runs of its sentences with `least` words.

    One run begins and one ends at every sentence where the line has that many words; equal runs are given once.
    """
    at = 0
    for line in text.split("\n"):
        words = line.lower().split()
        if words:
            yield at, at + len(line), " ".join(words)
            if len(words) > least:
                yield from _runs_of(line, at, least, words)
        at += len(line) + 1


def _runs_of(line: str, at: int, least: int, words: list[str]) -> Iterator[tuple[int, int, str]]:
    parts = [(m.start(), m.end(), own) for m in UNIT.finditer(line) if (own := m.group().lower().split())]
    upto = [0]
    for _, _, own in parts:
        upto.append(upto[-1] + len(own))
    found, i, j = [], 0, 0
    for i in range(len(parts)):  # the shortest run that begins with sentence i
        while j < len(parts) and upto[j] - upto[i] < least:
            j += 1
        if upto[j] - upto[i] < least:
            break
        found.append((i, j))
    i = 0
    for j in range(1, len(parts) + 1):  # and the one that ends before sentence j
        while upto[j] - upto[i + 1] >= least:
            i += 1
        if upto[j] - upto[i] >= least:
            found.append((i, j))
    for i, j in dict.fromkeys(found):
        own = [w for part in parts[i:j] for w in part[2]]
        if own != words:  # else it is the line
            yield at + parts[i][0], at + parts[j - 1][1], " ".join(own)


def passages(text: str) -> Iterator[tuple[int, int, str]]:
    """`start, end, normalised text` of the words from each content-chosen place to the last word of the next one."""
    words = text.lower().split()
    if len(words) < GRAM + REACH:
        return
    one = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    many = len(one) - GRAM + 1
    gram = np.zeros(many, dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        gram += one[k:k + many] * factor
    gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.unique(np.lib.stride_tricks.sliding_window_view(gram, REACH).argmin(axis=1) + np.arange(many - REACH + 1))
    chosen: list[int] = []
    last = None
    for p, g in zip(least.tolist(), gram[least].tolist(), strict=True):
        if not chosen or p - chosen[-1] >= REACH or g != last:  # not every place of a text that repeats itself
            chosen.append(p)
            last = g
    at = [m.span() for m in WORD.finditer(text)]
    for a, z in zip(chosen, chosen[1:]):  # noqa: B905
        yield at[a][0], at[z + GRAM - 1][1], "\n" + " ".join(words[a:z + GRAM])  # no line's digest: both stand at one place


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, kind: str = "all") -> DataFrame:
    """`doc_id, th, digest, start, end` of every unit of a kind; `th` is a hash of the text."""
    def sentences(text_: str) -> Iterator[tuple[int, int, str]]:
        for m in UNIT.finditer(text_):
            words = m.group().lower().split()
            if len(words) >= least:
                yield m.start(), m.end(), " ".join(words)

    def lines(text_: str) -> Iterator[tuple[int, int, str]]:
        at = 0
        for line in text_.split("\n"):
            if line.split():
                yield at, at + len(line), " ".join(line.lower().split())
            at += len(line) + 1
    cut_into = {"sentences": sentences, "lines": lines, "all": lambda text_: itertools.chain(runs(text_, least), passages(text_))}[kind]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digest, start, end = [], [], [], []
            for i, text_ in enumerate(batch["text"]):
                for a, z, unit in cut_into(text_.as_py()):
                    row.append(i)
                    digest.append(xxhash.xxh3_128_digest(unit))
                    start.append(a)
                    end.append(z)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), batch["th"].take(pa.array(row, pa.int64())), pa.array(digest, pa.binary()),
                                              pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "th", "digest", "start", "end"])
    common.bound_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, th bigint, digest binary, start bigint, end bigint")


def repeats(cut: DataFrame, keep: bool = False) -> DataFrame:
    """Units that are not the earliest of their digest, by document id (null last), text hash and offset.

    Rows with the same id and text are one document. Counting is map-side combined and only repeated digests are joined
    back, so a unit that half of all documents hold is many rows but no single task. With `keep` the joined rows are
    written once, so that all units are shuffled one time only.
    """
    last = F.lit(2**63 - 1)
    ranked = cut.withColumn("rank", F.coalesce(F.col("doc_id").cast("bigint"), last))
    least = ranked.groupBy("digest").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank")).where("n > 1").drop("n")
    least = common.stored(least, "unit-repeats")  # read again, so that a digest of very many units can be split in the join
    again = ranked.join(least, "digest")
    if keep:
        again = common.stored(again, "units-repeated")
    same = again.where("rank = first_rank").groupBy("digest").agg(F.min(F.struct("th", "start")).alias("first"))
    later = again.where("rank > first_rank").select("doc_id", "th", "start", "end")
    inside = again.where("rank = first_rank").join(same, "digest").where("struct(th, start) > first").select("doc_id", "th", "start", "end")
    return later.union(inside)


def _kept(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, gone in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if t is None:
            out.append(None)
            continue
        at, parts = 0, []
        for s in gone:
            parts.append(t[at:s["start"]])
            at = s["end"]
        out.append("".join([*parts, t[at:]]))
    return pa.array(out, pa.string())


def _merged(spans: pa.Array) -> pa.Array:
    """Sorted spans without overlaps; spans that touch become one."""
    out = []
    for own in spans.to_pylist():
        joined: list[dict] = []
        for s in own or ():
            if joined and s["start"] <= joined[-1]["end"]:
                joined[-1]["end"] = max(joined[-1]["end"], s["end"])
            else:
                joined.append(s)
        out.append(None if own is None else joined)
    return pa.array(out, spans.type)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, kind: str = "all") -> tuple[DataFrame, str, str]:
    """All rows and columns of `docs` with the removed spans (array, null if none) and the text that is left.

    Returns the frame and the two names. Offsets count characters of the original text. A null text stays null.
    """
    found = repeats(common.stored(units(docs, doc_id, text, least, kind), "units"), keep=kind == "all")
    id_, th, spans = (common.free_name(docs, x) for x in ("removed_id", "removed_th", "removed_spans"))
    by_doc = found.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans))  # no longer than the document has units
    if kind == "all":  # the others never overlap
        by_doc = by_doc.withColumn(spans, F.arrow_udf(_merged, dict(by_doc.dtypes)[spans])(F.col(spans)))
    out = docs.join(by_doc, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(th)), "left").drop(id_, th)
    left = common.free_name(out, "kept_text")
    kept = F.arrow_udf(_kept, "string")(F.when(F.col(spans).isNotNull(), F.col(text)), spans)
    return out.withColumn(left, F.coalesce(kept, F.col(text))), spans, left


def report(docs: DataFrame, kind: str = "all") -> DataFrame:
    """Per row: what was removed, where, and a digest of what is left."""
    out, spans, left = deduplicated(docs.select("doc_id", "text"), kind=kind)
    gone = F.coalesce(F.col(spans), F.array().cast(dict(out.dtypes)[spans]))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.size(gone).cast("bigint").alias("n_removed"),
                      F.aggregate(gone, F.lit(0).cast("bigint"), lambda s, r: s + r["end"] - r["start"]).alias("n_removed_chars"),
                      F.array_join(F.transform(gone, lambda r: F.concat(r["start"], F.lit("-"), r["end"])), ",").alias("spans"),
                      F.sha2(F.coalesce(left, F.lit("")), 256).alias("kept_sha256"))


SENTENCES_SQL = r"""
WITH piece AS (SELECT doc_id, p.i, p.x FROM (SELECT doc_id, regexp_extract_all(text, '[^\n.?]+[.?!]*|[\n.?]') AS xs FROM documents WHERE text IS NOT NULL), unnest(xs) WITH ORDINALITY AS p(x, i)),
placed AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM piece),
unit AS (SELECT doc_id, i, e - length(x) AS s, e, x, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS norm FROM placed WHERE x <> chr(10)),
big AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, s) AS rn FROM unit WHERE len(string_split(norm, ' ')) >= 8),
kept AS (SELECT p.doc_id, string_agg(p.x, '' ORDER BY p.i) AS t FROM placed p LEFT JOIN big b ON p.doc_id = b.doc_id AND p.i = b.i WHERE coalesce(b.rn, 1) = 1 GROUP BY p.doc_id),
gone AS (SELECT doc_id, count(*) AS n, sum(e - s) AS c, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY s) AS spans FROM big WHERE rn > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_removed_chars,
       coalesce(spans, '') AS spans, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LINES_SQL = r"""
WITH piece AS (SELECT doc_id, p.i, p.x FROM (SELECT doc_id, regexp_extract_all(text, '[^\n]+|\n') AS xs FROM documents WHERE text IS NOT NULL), unnest(xs) WITH ORDINALITY AS p(x, i)),
placed AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM piece),
unit AS (SELECT doc_id, i, e - length(x) AS s, e, x, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS norm FROM placed WHERE x <> chr(10)),
big AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, s) AS rn FROM unit WHERE norm <> ''),
kept AS (SELECT p.doc_id, string_agg(p.x, '' ORDER BY p.i) AS t FROM placed p LEFT JOIN big b ON p.doc_id = b.doc_id AND p.i = b.i WHERE coalesce(b.rn, 1) = 1 GROUP BY p.doc_id),
gone AS (SELECT doc_id, count(*) AS n, sum(e - s) AS c, string_agg(CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY s) AS spans FROM big WHERE rn > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_removed_chars,
       coalesce(spans, '') AS spans, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
