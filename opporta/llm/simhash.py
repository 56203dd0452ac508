"""SimHash near-duplicates: exact pairs within a Hamming radius through vantage-point trees.

Hamming distances of unrelated fingerprints lie close together (32 +- 4 of 64 bits), so a vantage-point tree over whole
fingerprints can prune little at radius 4. Fingerprints are therefore cut into three blocks of bits: two that differ in
at most 4 bits differ in at most 1 in some block. One tree for each block partitions the fingerprints by their distance
within the block, where the triangle bound at radius 1 prunes most branches. A leaf is a shard: it keeps the
fingerprints that end there and is asked by every fingerprint whose ball crosses its boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta import runtime
from opporta.llm import common

SHINGLE = 4
RADIUS = 4
BLOCKS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)  # 21, 21 and 22 bits
SAMPLE = 50_000  # fingerprints, lowest hash first, that trees are grown on; all fingerprints are indexed
LEAF_ROWS = 500  # aimed at in a shard
LEAF_SAMPLE = 8  # sampled fingerprints a leaf has at least
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included."""
    raw = text.encode()
    words = [w for w in raw.translate(_LOWER).split(b" ") if w]
    if not words:
        return 0
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        digest = xxhash.xxh64_intdigest
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        hashes = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, starts[size:])], dtype=np.uint64)  # noqa: B905
    return folded(hashes)


def folded(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of some hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[a:a + 100_000, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Add a bigint fingerprint to every row; null and wordless texts have 0. Frame and column name."""
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.int64())
    common.bound_batches(docs.sparkSession)
    name = common.free_name(docs, "fingerprint_bits")
    return docs.withColumn(name, F.arrow_udf(made, "bigint").asNondeterministic()(F.col(text))), name


class Tree:
    """Vantage-point tree over one block of bits: vantage, radius and children by node; a leaf's child is itself."""

    def __init__(self, sample: np.ndarray, mask: int, leaf: int):
        self.mask, rows = np.uint64(mask), [sample & np.uint64(mask)]
        self.point, self.cut, self.near, self.far, self.share = [0], [0], [0], [0], [1.0]
        todo = [(0, rows[0])]
        while todo:
            node, own = todo.pop()
            split = self._split(own) if len(own) >= 2 * leaf else None
            if split is None:
                continue
            vantage, cut, inside = split
            self.point[node], self.cut[node] = int(vantage), int(cut)
            for side, part in (("near", own[inside]), ("far", own[~inside])):
                child = len(self.point)
                getattr(self, side)[node] = child
                for values, v in ((self.point, 0), (self.cut, 0), (self.near, child), (self.far, child), (self.share, len(part) / len(sample))):
                    values.append(v)
                todo.append((child, part))

    @staticmethod
    def _split(own: np.ndarray):
        """Of a few candidate points, the vantage whose median distance leaves the fewest points near the boundary."""
        best = None
        for vantage in own[:: max(1, len(own) // 5)][:5]:
            d = np.bitwise_count(own ^ vantage).astype(np.int64)
            cut = int(np.median(d))
            for c in (cut - 1, cut):
                inside = d <= c
                if not inside.any() or inside.all():
                    continue
                cost = len(d) + int(((d > c - 1) & (d <= c + 1)).sum()) + abs(2 * int(inside.sum()) - len(d))
                if best is None or cost < best[0]:
                    best = cost, vantage, c, inside
        return best[1:] if best else None

    def freeze(self) -> Tree:
        for k in ("cut", "near", "far"):
            setattr(self, k, np.array(getattr(self, k), dtype=np.int64))
        self.point, self.share = np.array(self.point, dtype=np.uint64), np.array(self.share)
        return self

    def leaves(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf): every leaf that may hold a value within `reach` of the row's; reach 0: its own leaf."""
        row, node, done = np.arange(len(values)), np.zeros(len(values), dtype=np.int64), []
        own = values & self.mask
        while len(row):
            leaf = self.near[node] == node
            done.append((row[leaf], node[leaf]))
            row, node = row[~leaf], node[~leaf]
            d = np.bitwise_count(own[row] ^ self.point[node]).astype(np.int64)
            near, far = d - reach <= self.cut[node], d + reach > self.cut[node]
            row, node = np.concatenate([row[near], row[far]]), np.concatenate([self.near[node][near], self.far[node][far]])
        return np.concatenate([r for r, _ in done] or [row]), np.concatenate([n for _, n in done] or [node])


def _close(asking: np.ndarray, kept: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (asking, kept) at most `radius` bits apart, some asking rows at a time."""
    step = max(1, 1_000_000 // max(1, len(kept)))
    for a in range(0, len(asking), step):
        q, k = np.nonzero(np.bitwise_count(asking[a:a + step, None] ^ kept[None, :]) <= radius)
        yield q + a, k


def shard_links(asking: np.ndarray, kept: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what the close pairs of one shard join: no more than one for each fingerprint.

    A cluster of n fingerprints gives n - 1 links rather than all its pairs.
    """
    label = np.arange(len(kept))  # of kept fingerprints that are joined, the same label
    firsts: list[tuple[np.ndarray, np.ndarray]] = []
    for q, k in _close(asking, kept, radius):
        if not len(q):
            continue
        cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        firsts.append((q[cuts], k[cuts]))
        mixed = np.minimum.reduceat(label[k], cuts) != np.maximum.reduceat(label[k], cuts)
        for a, b in zip(cuts[mixed].tolist(), np.r_[cuts[1:], len(q)][mixed].tolist(), strict=True):
            joined = np.unique(label[k[a:b]])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    roots = kept[label]
    links = {(int(x), int(r)) for x, r in zip(kept.view(np.int64), roots.view(np.int64), strict=True) if x != r}
    for q, k in firsts:
        links |= set(zip(asking[q].view(np.int64).tolist(), kept[k].view(np.int64).tolist(), strict=True))
    return [x for x in links if x[0] != x[1]]


def links(prints: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links `a, b` between distinct fingerprints of `prints(fp)` that join exactly what all close pairs join.

    Trees are grown on a bounded sample and broadcast. A shard that is expected to be asked by more than eight times the
    usual number is dealt to several tasks: each gets all it keeps and a part of those that ask.
    """
    spark = prints.sparkSession
    if radius >= 2 * len(BLOCKS):
        raise ValueError("the blocks find pairs up to radius 5")
    reach = radius // len(BLOCKS)
    total = prints.count()
    seen = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    least = max(LEAF_SAMPLE, -(-leaf_rows * len(seen) // max(total, 1)))
    trees = [Tree(seen, mask, least).freeze() for mask in BLOCKS]
    parts = []
    for tree in trees:
        asked = np.bincount(tree.leaves(seen, reach)[1], minlength=len(tree.cut)) * (total / max(len(seen), 1))
        parts.append(np.maximum(1, np.ceil(asked / (8 * leaf_rows))).astype(np.int64))
    sent = spark.sparkContext.broadcast((trees, parts))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, split = sent.value
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for t, (tree, pieces) in enumerate(zip(grown, split, strict=True)):
                row, leaf = tree.leaves(fp, reach)
                mix = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                piece = mix % pieces[leaf]
                home = np.zeros(len(fp), dtype=np.int64)
                at, own = tree.leaves(fp, 0)
                home[at] = own
                kept, many = np.arange(len(fp)), pieces[home]
                kept_piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                kept, kept_leaf = np.repeat(kept, many), np.repeat(home, many)
                for r, lf, p, keeps in ((row, leaf, piece, False), (kept, kept_leaf, kept_piece, True)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), t, dtype=np.int32)), pa.array(lf), pa.array(p), pa.array(np.full(len(r), keeps)),
                                                      pa.array(fp[r].view(np.int64))], names=["tree", "leaf", "piece", "kept", "fp"])

    def joined(table: pa.Table) -> pa.Table:
        kept, fp = np.asarray(table["kept"]), np.asarray(table["fp"]).view(np.uint64)
        found = shard_links(np.sort(fp[~kept]), np.sort(fp[kept]), radius)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})
    shards = prints.select("fp").mapInArrow(dealt, "tree int, leaf bigint, piece bigint, kept boolean, fp bigint")
    return shards.groupBy("tree", "leaf", "piece").applyInArrow(joined, "a bigint, b bigint").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(marked: DataFrame, fp: str = "fp", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows `fp, component, root` for each distinct fingerprint of `marked`, which has a row per document.

    Copies share a fingerprint, so only distinct fingerprints are compared. `component` is the smallest id of all
    documents reachable by links, null if none of them has an id; `root` names the component in any case.
    """
    least = runtime.cut_lineage(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("id")))
    root = common.components(links(least.select("fp"), radius))
    member = runtime.cut_lineage(least.join(root, least["fp"] == root["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    lowest = member.groupBy("root").agg(F.min("id").alias("component"))
    return runtime.cut_lineage(member.join(lowest, "root").select("fp", "component", "root"))


def report(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every row; null and wordless texts have fingerprint 0 and link like others."""
    made, fp = with_fingerprint(docs.select("doc_id", "text"))
    marked = common.stored(made.select("doc_id", F.col(fp).alias("fp")), "simhash")
    return marked.join(groups(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component stays, its columns unchanged: a row with the component's smallest id."""
    made, fp = with_fingerprint(docs)
    row = common.free_name(made, "row_of")
    marked = common.stored(made.withColumn(row, F.monotonically_increasing_id()), "simhash")
    small = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = small.join(groups(small), "fp").where("doc_id <=> component").groupBy("root").agg(F.min("row").alias(row))
    return marked.join(first.select(row), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
