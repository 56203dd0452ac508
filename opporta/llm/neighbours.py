"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking.

A tree splits a sample by random hyperplanes at the median until few are left; every vector of the table goes to one
leaf of each tree. A query visits the leaves of all trees in the order of a shared queue, nearest hyperplanes first, and
all vectors in the visited leaves are compared with it exactly.

How many leaves a query visits is measured, not set: 64 queries are searched exactly, and the forest tells at which leaf of the
queue each of their neighbours is found. The number that finds 95 % of them, 64 at least, holds for all queries. So the share of the table
that is compared is what the vectors need: little where near vectors stand apart from the rest, and falling as the table grows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opporta.llm import common

TREES = 16
LEAF_ROWS = 100  # vectors a leaf holds on average where the sample allows it
LEAF_SAMPLE = 20  # sampled vectors a leaf has at least: the share of the table that a leaf holds stays at large sizes
SAMPLE = 20_000  # vectors, lowest hash of the id first, that the trees are grown on; every vector is indexed
LEAST_VISITS = 4 * TREES  # leaves that every query visits
RECALL, CALIBRATED = 0.95, 64  # share of true neighbours that the visited leaves hold, queries that it is measured on
QUERY_BLOCK = 2_000  # queries sent to the tasks at a time
PAIRS_AT_ONCE = 200_000
ALL = -1  # stands for every leaf
SEED = 5


class Forest:
    """All trees in shared arrays; a leaf is its own child. `start` has the trees' roots."""

    def __init__(self, sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = SEED):
        draw = np.random.Generator(np.random.Philox(key=seed))
        self.start, normal, offset, low, high = [], [], [], [], []

        def node() -> int:
            normal.append(np.zeros(sample.shape[1], dtype=np.float32))
            offset.append(0.0)
            low.append(len(low))
            high.append(len(high))
            return len(low) - 1
        for _ in range(trees):
            self.start.append(node())
            todo = [(self.start[-1], np.arange(len(sample)))]
            while todo:
                at, own = todo.pop()
                if len(own) < 2 * leaf:
                    continue
                a, b = draw.choice(own, 2, replace=False)
                plane = sample[a] - sample[b]
                length = np.linalg.norm(plane)
                plane = plane / length if length > 0 else draw.standard_normal(sample.shape[1]) / np.sqrt(sample.shape[1])
                side = sample[own] @ plane.astype(np.float32)
                cut = float(np.median(side))
                right = side > cut
                if not right.any():
                    continue
                normal[at], offset[at], low[at], high[at] = plane.astype(np.float32), cut, node(), node()
                todo += [(low[at], own[~right]), (high[at], own[right])]
        self.normal, self.offset, self.low, self.high = np.stack(normal), np.array(offset), np.array(low), np.array(high)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, one column for each tree."""
        out = np.empty((len(vectors), len(self.start)), dtype=np.int32)
        for t, root in enumerate(self.start):
            at, todo = np.full(len(vectors), root), np.arange(len(vectors))
            while len(todo):
                todo = todo[self.low[at[todo]] != at[todo]]
                now = at[todo]
                side = np.einsum("ij,ij->i", vectors[todo], self.normal[now]) > self.offset[now]
                at[todo] = np.where(side, self.high[now], self.low[now])
            out[:, t] = at
        return out

    def visited(self, query: np.ndarray, visits: int | None = None) -> list[int]:
        """The leaves of a query, all or the first ones: always the most promising open node of any tree next."""
        margin = self.normal @ query - self.offset
        queue = [(-np.inf, root) for root in self.start]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and (visits is None or len(found) < visits):
            bound, at = heapq.heappop(queue)
            if self.low[at] == at:
                found.append(at)
                continue
            heapq.heappush(queue, (max(bound, -margin[at]), int(self.high[at])))
            heapq.heappush(queue, (max(bound, margin[at]), int(self.low[at])))
        return found


def _nearest(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every query: smallest score, then smallest id (null last), then row."""
    order = np.lexsort((row, ids, no_id, score, query))
    grouped = query[order]
    begins = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return order[place < k]


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is not null or zero and has only finite numbers, of the most frequent length."""
    v = F.col(embedding)
    fine = vectors.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    sizes = fine.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size(v) == (sizes.d if sizes else 0))


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = TREES, sample: int = SAMPLE,
           leaf_rows: int = LEAF_ROWS, visits: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """`query_id, rank, vec_id, score`: the k nearest found (Euclidean) for every row that meets `is_query`.

    A row is no candidate of itself; other rows with its id are. Unusable vectors (see `usable`) take no part. Ids that
    are null are candidates, last among ties. Queries are compared in blocks of `query_block`, each a scan of the index;
    a task keeps k candidates of each query, so no vector is shuffled. `visits` sets the leaves visited; measured if None.
    """
    spark = vectors.sparkSession
    fine = usable(vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("asks")), "v")
    total = fine.count()
    seen = fine.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], shape)
    grown = Forest(np.stack(seen.to_numpy()).astype(np.float32), max(LEAF_SAMPLE, -(-leaf_rows * len(seen) // total) // 2), trees)
    forest = spark.sparkContext.broadcast(grown)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(leaves=list(forest.value.leaves(np.stack(batch["v"].to_numpy()).astype(np.float32))))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "no_id": batch["no_id"], "v": batch["v"], "leaves": [forest.value.visited(np.asarray(v, dtype=np.float32), visits) for v in batch["v"]]})
    masked = fine.select(F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), F.col("id").isNull().alias("no_id"), "v", "asks")  # pandas makes numbers with nulls floats
    index = common.stored(masked.withColumn("row", F.monotonically_increasing_id()).mapInPandas(indexed, "id bigint, no_id boolean, v array<double>, asks boolean, row bigint, leaves array<int>"), "forest")
    if visits is None:
        visits = max(LEAST_VISITS, _visits(index, grown, k))
    queries = common.stored(index.where("asks").select("row", "id", "no_id", "v").mapInPandas(asked, "row bigint, id bigint, no_id boolean, v array<double>, leaves array<int>"), "forest-queries")
    blocks = max(1, -(-queries.count() // query_block))
    found = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toPandas().sort_values("row")
        best = _candidates(index, block, k) if len(block) else None
        found = best if found is None else found if best is None else found.union(best)
    if found is None:
        return spark.createDataFrame([], shape)
    w = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visits(index: DataFrame, forest: Forest, k: int) -> int:
    """Leaves that hold the wanted share of the true neighbours of some queries, found by comparing these with all rows."""
    some = index.where("asks").orderBy(F.xxhash64("row")).limit(CALIBRATED).select("row", "id", "no_id", "v").toPandas()
    if not len(some):
        return 1
    best = _candidates(index, some.assign(leaves=[[ALL]] * len(some)), k)
    near = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    true = best.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_row", "row")
    found = true.join(index.select("row", "leaves"), "row").collect()  # k rows for each of the calibrated queries
    order = {r.row: {leaf: p for p, leaf in enumerate(forest.visited(np.asarray(r.v, dtype=np.float32)))} for r in some.itertuples()}
    at = sorted(min(order[r.query_row][leaf] for leaf in r.leaves) for r in found)
    return at[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)] + 1 if at else 1


def _candidates(index: DataFrame, block: pd.DataFrame, k: int) -> DataFrame:
    """The k best of every query of one block in every task, by exact distances to all vectors in the visited leaves (`ALL`: in any)."""
    leaf = np.concatenate([np.asarray(x, dtype=np.int64) for x in block["leaves"]])
    asks = np.repeat(np.arange(len(block)), block["leaves"].map(len))
    order, everything = np.argsort(leaf, kind="stable"), bool((leaf == ALL).all())
    sent = index.sparkSession.sparkContext.broadcast((np.stack(block["v"].to_numpy()), block["row"].to_numpy(), block["id"].to_numpy(dtype=np.int64), block["no_id"].to_numpy(dtype=bool), leaf[order], asks[order]))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, rows, names, no_name, by_leaf, who = sent.value
        best = {"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "score": np.zeros(0), "id": np.zeros(0, np.int64), "no_id": np.zeros(0, bool)}
        for batch in batches:
            if not len(batch):
                continue
            v, row, own = np.stack(batch["v"].to_numpy()), batch["row"].to_numpy(), np.stack(batch["leaves"].to_numpy())
            ids, no_id = batch["id"].to_numpy(dtype=np.int64), batch["no_id"].to_numpy(dtype=bool)
            own = np.full((len(own), 1), ALL) if everything else own
            begin, end = np.searchsorted(by_leaf, own, "left"), np.searchsorted(by_leaf, own, "right")
            many = (end - begin).sum(axis=1)
            for a, z in _runs(many, PAIRS_AT_ONCE):
                n = (end - begin)[a:z].ravel()
                at = np.repeat(begin[a:z].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pair = np.unique(who[at] * (z - a) + np.repeat(np.repeat(np.arange(z - a), own.shape[1]), n))
                q, r = pair // (z - a), pair % (z - a) + a
                keep = rows[q] != row[r]
                q, r = q[keep], r[keep]
                score = np.sqrt(((vectors[q] - v[r]) ** 2).sum(axis=1))
                best = {n_: np.concatenate([best[n_], x]) for n_, x in (("query", q), ("row", row[r]), ("score", score), ("id", ids[r]), ("no_id", no_id[r]))}
                top = _nearest(best["query"], best["row"], best["score"], best["id"], best["no_id"], k)
                best = {n_: x[top] for n_, x in best.items()}
        q = best["query"]
        yield pd.DataFrame({"query_row": rows[q], "query_id": names[q], "no_query": no_name[q], "row": best["row"], "score": best["score"], "vec_id": best["id"], "no_id": best["no_id"]})
    found = index.select("id", "no_id", "v", "row", "leaves").mapInPandas(compared, "query_row bigint, query_id bigint, no_query boolean, row bigint, score double, vec_id bigint, no_id boolean")
    return found.select("query_row", F.when(~F.col("no_query"), F.col("query_id")).alias("query_id"), "row", "score", F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"))


def _runs(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` pairs together (more only for one row)."""
    start, held = 0, 0
    for i, n in enumerate(many.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(many):
        yield start, len(many)


def report(vectors: DataFrame, every: int = 100) -> DataFrame:
    return search(vectors, F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
