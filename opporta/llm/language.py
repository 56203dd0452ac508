"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the element-wise product of its letters' vectors,
rotated by two, one and no places; a text's vector is the sum over its trigrams, a language's prototype the sum over its
texts. A text gets the language whose prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm.common import bound_batches, free_name, worker_state

DIMENSIONS = 1024
SEED = 20_240
UNKNOWN = "und"
CHARS_AT_ONCE = 400_000  # characters whose trigrams a worker holds at a time (more only for one longer text)
KEPT_VECTORS = 12_000  # trigram vectors a worker keeps between batches; others are made anew
PROFILE = "lang string, dim int, value double"
_RESULT_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
_letters = np.zeros(0x110000, dtype=bool)


def _letter_table() -> np.ndarray:
    if not _letters.any():
        _letters[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _letters


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random vector of a letter, the same in every run; 0 stands for a word's edge."""
    return (np.random.Generator(np.random.Philox(key=SEED + code)).integers(0, 2, dimensions) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and packed code of every trigram that has a letter in its middle, in lower case.

    All that is no letter is one edge (0) between words, so trigrams never join two texts.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [*[len(t) + 1 for t in lowered], 1])[:len(codes)]
    codes = np.where(_letter_table()[codes], codes, 0).astype(np.int64)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, owner = codes[keep], owner[keep]
    middle = np.flatnonzero(codes[1:-1]) + 1
    return owner[middle], codes[middle - 1] << 42 | codes[middle] << 21 | codes[middle + 1]


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of packed trigrams, one row each."""
    def letters(codes: np.ndarray, turn: int) -> np.ndarray:
        which, row = np.unique(codes, return_inverse=True)
        made = worker_state("letters", dimensions, dict).setdefault("letters", {})
        for c in which.tolist():
            if c not in made:
                made[c] = letter_vector(c, dimensions)
        return np.roll(np.stack([made[c] for c in which.tolist()]), turn, axis=1)[row]
    if not len(grams):
        return np.zeros((0, dimensions), dtype=np.float32)
    first, middle, last = grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF
    return (letters(first, 2) * letters(middle, 1) * letters(last, 0)).astype(np.float32)


def _kept_vectors(grams: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """A table of vectors and the row of each of the (distinct) grams in it."""
    if len(grams) > KEPT_VECTORS:
        return gram_vectors(grams, dimensions), np.arange(len(grams))
    index, table, used = worker_state("letters", dimensions, dict).get("table") or ({}, np.zeros((KEPT_VECTORS, dimensions), dtype=np.float32), 0)
    listed = grams.tolist()
    new = [g for g in listed if g not in index]
    if used + len(new) > KEPT_VECTORS:
        index, used, new = {}, 0, listed
    if new:
        table[used:used + len(new)] = gram_vectors(np.array(new, dtype=np.int64), dimensions)
        index.update(zip(new, range(used, used + len(new)), strict=True))
        used += len(new)
    worker_state("letters", dimensions, dict)["table"] = index, table, used
    return table, np.array([index[g] for g in listed], dtype=np.int64)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes of the languages of labelled rows, as `PROFILE` rows.

    Rows whose text or language is null teach nothing. Each task sums its own rows; tasks' sums are added by language
    and dimension, so what moves is languages x dimensions x tasks, whatever the number of rows.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                owner, grams = trigrams(texts[a:b])
                if not len(grams):
                    continue
                code, found = pd.factorize(grams)
                table, row = _kept_vectors(found, dimensions)
                names = sorted(set(langs[a:b]))
                place = np.array([names.index(x) for x in langs[a:b]])
                counts = np.bincount(place[owner] * len(found) + code, minlength=len(names) * len(found)).reshape(len(names), -1)
                for name, count in zip(names, counts, strict=True):
                    some = np.flatnonzero(count)
                    if len(some):
                        total[name] = total.get(name, 0) + _weighted(count[some], table, row[some])
        for name, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(np.asarray(vector, dtype=np.float64))],
                                             names=["lang", "dim", "value"])
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    return rows.mapInArrow(sums, PROFILE).groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def _weighted(count: np.ndarray, table: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of vectors with whole-number weights: exact, so that the order of rows does not count."""
    out = np.zeros(table.shape[1])
    for a in range(0, len(row), 2048):
        out += count[a:a + 2048].astype(np.float64) @ table[row[a:a + 2048]].astype(np.float64)
    return out


def predict(docs: DataFrame, prototypes: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> tuple[DataFrame, str]:
    """Add a struct column (`lang_pred`, `score` = cosine, 0 where it is negative) to every row; frame and name.

    Only the text is an input. A text that is null or has no letter, and any text where no language was learned, gets
    `und` and score 0; equal cosines go to the first language by code point. All columns stay. The prototypes, languages
    x dimensions numbers, are broadcast; they do not grow with the documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    learned: dict[str, np.ndarray] = {}
    for r in prototypes.toLocalIterator():
        learned.setdefault(r.lang, np.zeros(dimensions))[r.dim] = r.value
    names = sorted(n for n in learned if learned[n].any())
    matrix = np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else np.zeros((0, dimensions))
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, names, matrix))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, known, profile = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            best, cosine = np.full(len(texts), -1), np.zeros(len(texts))
            for a, b in _slices(texts) if known else ():
                owner, grams = trigrams(texts[a:b])
                code, found = pd.factorize(grams)
                table, row = _kept_vectors(found, dimensions)
                ends = np.searchsorted(owner, np.arange(b - a + 1))
                for i in range(b - a):
                    if ends[i] == ends[i + 1]:
                        continue
                    count = np.bincount(code[ends[i]:ends[i + 1]])
                    some = np.flatnonzero(count)
                    vector = _weighted(count[some], table, row[some]) if len(some) > 2048 else (count[some].astype(np.float32) @ table[row[some]]).astype(np.float64)
                    match = profile @ vector
                    best[a + i] = match.argmax()
                    cosine[a + i] = max(0.0, min(1.0, match[best[a + i]] / max(np.linalg.norm(vector), 1e-300)))
            yield pa.StructArray.from_arrays([pa.array([known[k] if k >= 0 else UNKNOWN for k in best], pa.string()), pa.array(cosine)], names=["lang_pred", "score"])
    name = free_name(docs, "language")
    scored = F.arrow_udf(score, "struct<lang_pred: string, score: double>").asNondeterministic()
    return docs.withColumn(name, scored(F.col(text))), name


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def report(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Predicted language of every row, learned from the rows outside the held-out fold; a null id is held out."""
    part = F.coalesce(fold("doc_id", folds), F.lit(held))
    prototypes = learn(docs.where(part != held))
    out, name = predict(docs, prototypes)
    return out.select("doc_id", (part == held).alias("held_out"), f"{name}.lang_pred", f"{name}.score")


def known(docs: DataFrame) -> DataFrame:
    """Rows whose text has a recognised language, their columns unchanged; learned from the rows' own labels."""
    out, name = predict(docs, learn(docs))
    return out.where(F.col(f"{name}.lang_pred") != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])
