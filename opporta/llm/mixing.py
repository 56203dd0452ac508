"""Mixing sources to target weights.

The words of a source form one stream that is cut into blocks of fixed length. Each output shard draws how many blocks
it takes from each source; the draws are multinomial over the shards with the source's total given, so targets are met
to within a block. Slots of a source are numbered through and mapped by a pseudorandom permutation of its block
numbers, a new one for each pass, so no block comes twice in a pass. Blocks are joined with the slots by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common

BLOCK_WORDS = 64
SHARD_SLOTS = 4_096  # blocks an output shard holds on average
MOST_PASSES = 3  # a source's target stops at so many times its size
WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
SEED = 11
SPACE = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Words to take of each source: all words shared by weight, none above `most` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    fixed: dict[int, float] = {}
    while True:
        rest, shares = sum(sizes) - sum(fixed.values()), sum(w for i, w in enumerate(weight) if i not in fixed)
        share = {i: rest * w / shares for i, w in enumerate(weight) if i not in fixed}
        over = {i: float(most * sizes[i]) for i, x in share.items() if x > most * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= over


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..count-1 for each key: a four-round Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, v = half[todo], mask[todo], value[todo]
        left, right = v >> h, v & m
        for turn in range(4):
            mixed = (right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mixed >> np.uint64(31)) & m
        value[todo] = left << h | right
        todo = todo[value[todo] >= count[todo].astype(np.uint64)]
    return value.astype(np.int64)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: list[str] | None = None) -> DataFrame:
    """`row, doc_id, source, size, part, at`: words of every row, ranged by source and a hash, and its place in its part.

    `row` numbers the rows of `docs` (or is a struct of its columns `row`), `at` counts the words of the same source before it in the same part.
    """
    mix = F.xxhash64(doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), mix.alias("mix"),
                       F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("bigint").alias("size"),
                       (F.struct(*row) if row else F.monotonically_increasing_id()).alias("row"))
    rows = common.stored(rows, "mix-sizes")
    order = ["source", "mix", "doc_id"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, last, before = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            names, sizes, at = batch["source"].to_pylist(), batch["size"].to_pylist(), []
            for name, size in zip(names, sizes, strict=True):
                if (name,) != last:
                    last, before = (name,), 0
                at.append(before)
                before += size
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["source"], batch["size"], pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())],
                                             names=["row", "doc_id", "source", "size", "part", "at"])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)
    places = common.stored(ranged.mapInArrow(placed, f"row {kind['row']}, doc_id {kind['doc_id']}, source string, size bigint, part int, at bigint"), "mix-places")
    common.forget(rows)
    return places


def plan(places: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """Slots `shard, slot, source_no, block, pass`; pieces `source_no, block, row, first, after`; a table of the sources.

    The driver sees one number for each source and for each pair of a part and a source in it.
    """
    spark = places.sparkSession
    parts = places.groupBy("part", "source").agg(F.sum("size").alias("size")).toPandas()
    parts["source"] = [s if isinstance(s, str) else None for s in parts["source"]]
    names = sorted({s for s in parts["source"] if s is not None}) + [None] * bool(parts["source"].isna().any())
    number = {s: i for i, s in enumerate(names)}
    parts["source_no"] = [number[s] for s in parts["source"]]
    parts = parts.sort_values(["source_no", "part"])
    parts["base"] = parts.groupby("source_no")["size"].cumsum() - parts["size"]
    size = [int(parts.loc[parts["source_no"] == i, "size"].sum()) for i in range(len(names))]
    table = pd.DataFrame({"source": names, "source_no": range(len(names)), "source_size": size, "target": targets(size)})
    blocks = [-(-s // block) for s in size]
    slots = []
    for s, t, n in zip(size, table["target"], blocks, strict=True):
        whole = int(t // s) if s else 0
        slots.append(min(MOST_PASSES * n, whole * n + round((t - whole * s) / block)))
    shards = max(1, -(-sum(slots) // shard_slots))
    drawn = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(zip(blocks, slots, strict=True)) if k], "source_no int, blocks bigint, slots bigint")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                count = np.random.Generator(np.random.Philox(key=[seed, r.source_no])).multinomial(r.slots, np.full(shards, 1 / shards))
                yield pd.DataFrame({"source_no": r.source_no, "blocks": r.blocks, "shard": np.arange(shards), "first": np.cumsum(count) - count, "count": count})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turn = batch["slot"] // batch["blocks"]
            key = (batch["source_no"].astype("int64") * 1_000_003 + turn + seed * 7_919).to_numpy().astype(np.uint64)
            batch["block"] = permuted((batch["slot"] % batch["blocks"]).to_numpy(), batch["blocks"].to_numpy(), key)
            batch["pass"] = turn
            yield batch[["shard", "slot", "source_no", "block", "pass"]]
    counts = drawn.mapInPandas(draw, "source_no int, blocks bigint, shard bigint, first bigint, count bigint").where("count > 0").repartition("source_no", "shard")
    numbered = counts.select("source_no", "blocks", "shard", F.explode(F.sequence("first", F.expr("first + count - 1"))).alias("slot"))
    chosen = numbered.mapInPandas(mapped, "shard bigint, slot bigint, source_no int, block bigint, pass bigint")
    base = spark.createDataFrame(list(zip(parts["part"].tolist(), parts["source"].tolist(), parts["source_no"].tolist(), parts["base"].tolist(), strict=True)),
                                 "part int, source string, source_no int, base bigint")
    found = places.where("size > 0").alias("p").join(base.alias("b"), F.expr("p.part = b.part AND p.source <=> b.source")).select(
        "source_no", "row", "size", (F.col("base") + F.col("at")).alias("start"))
    cut = found.select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    pieces = cut.select("source_no", "block", "row", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("first"),
                        F.least("size", (F.col("block") + 1) * block - F.col("start")).alias("after"))
    return chosen, pieces, table


def mixed(chosen: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix: for each slot of each shard the rows and words `[first, after)` of its block."""
    return chosen.hint("merge").join(pieces, ["source_no", "block"])  # Spark takes exploded slots for few rows


def report(docs: DataFrame) -> DataFrame:
    """Words of every row and how many the mix takes. Null texts have no words; a null source is the last source."""
    places = sized(docs)
    chosen, pieces, table = plan(places)
    taken = mixed(chosen, pieces).groupBy("row").agg(F.sum(F.col("after") - F.col("first")).alias("taken"))
    known = docs.sparkSession.createDataFrame(list(zip(table["source"].tolist(), table["source_size"].tolist(), table["target"].tolist(), strict=True)),
                                              "source_name string, source_size bigint, target double")
    return places.join(known, places["source"].eqNullSafe(known["source_name"])).join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _cut_text(text: pa.Array, size: pa.Array, runs: pa.Array) -> pa.Array:
    """Runs of words of each text with the white space inside them, joined by line ends; a whole text stays as it is."""
    out = []
    for t, n, taken in zip(text.to_pylist(), size.to_pylist(), runs.to_pylist(), strict=True):
        spans: list[list[int]] = []
        for r in sorted(taken, key=lambda r: r["first"]):
            if spans and spans[-1][1] == r["first"]:
                spans[-1][1] = r["after"]
            else:
                spans.append([r["first"], r["after"]])
        if spans == [[0, n]]:
            out.append(t)
            continue
        words = [m.span() for m in re.finditer(SPACE, t)]
        out.append("\n".join(t[words[a][0]:words[b - 1][1]] for a, b in spans))
    return pa.array(out, pa.string())


def sample(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The mixed documents, with the columns of `docs`: a row for each pass over a document that takes any of it.

    Its text is what the pass takes, the whole text where it takes all blocks, and `n_chars`, if there is such a column,
    its length. Documents without words are not taken.
    """
    common.bound_batches(docs.sparkSession)
    kept, row = common.numbered(docs)
    places = sized(kept, text=text, row=row)
    chosen, pieces, _ = plan(places)
    taken = mixed(chosen, pieces).groupBy("row", "pass").agg(F.collect_list(F.struct("first", "after")).alias("runs"))
    taken = taken.join(places.select("row", "size"), "row").select(
        *[F.col(f"row.{x}").alias(x) for x in row], F.struct("size", "runs").alias(common.free_name(kept, "taken")))
    name = taken.columns[-1]
    out = kept.join(taken, row).withColumn(text, F.arrow_udf(_cut_text, "string")(F.col(text), F.col(f"{name}.size"), F.col(f"{name}.runs")))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(dict(docs.dtypes)[n_chars]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
