"""Near copies by word shingles: groups of texts whose sets of five-word shingles are alike to 0.8 or more (Jaccard).

Texts with one shingle set are one node, so exact copies cost nothing. Candidates come first from the 64-bit SimHash of a set's
shingles: all fingerprints at most 4 bits apart, through the vantage-point trees of `simhash`. Two texts at 0.8 differ by 9 or 10
bits and often by more, beyond what such trees can prune, so for the rest candidates come from min-hashes: 24 bands of 4. A pair at
0.8 shares a band with probability 1 - (1 - 0.8^4)^24 = 0.999997. Every link of either kind is confirmed on the whole shingle sets
(32-bit hashes); what fingerprints have joined is not compared again in the buckets of the bands.
In a bucket whose nodes are not yet all joined, pairs are compared by odd sketches first: bit h mod m of a set's sketch is the parity
of its hashes h there, so two sketches differ in no more bits than the sets have unshared hashes, and a pair that differs in more
than the similarity allows is surely below it. Of the rest only pairs whose signatures (8 bits of each of the 96 min-hashes) agree
in at least 56 places are confirmed: at 0.8 fewer agree with probability 1e-6, at 0.5 as many with 0.06. A bucket is cut by the sizes
of the sets, for sets that are alike to 0.8 differ in size by a quarter at most, and what is still large is compared in pieces,
two at a time, so no task holds a bucket. Comparing is quadratic in a bucket of texts that are not alike; what leaves it is not.

Defined results: null and wordless texts have the empty set and are one group; a text of fewer than five words is one shingle;
equal texts, repeated rows and equal ids are in one group if their sets are alike, of which one row stays (the smallest id, null
ids last, then the first row); an empty table stays empty; all columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common, simhash

SHINGLE, LIKE = 5, 0.8
BANDS, ROWS = 24, 4
STAR_ROUNDS = 2
AGREE = 56  # of the min-hashes of a pair that is confirmed
PIECE = 4_000  # nodes of a bucket in one task
SKETCH = 2**9, 2**15  # least and most bits of an odd sketch, else four to eight for each hash of the set
_DRAWN = np.random.Generator(np.random.Philox(key=11)).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, a wordless one has none."""
    words = [w for w in text.encode().translate(simhash._LOWER).split(b" ") if w]
    joined, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    if len(words) < size:
        starts = [0, len(joined) + 1] if words else []
        size = 1
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip(starts, starts[size:])], dtype=np.uint64))  # noqa: B905


def bands(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One hash for each band of min-hashes, and 8 bits of each min-hash."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for a in range(0, len(own), 2_000):
        mixed = (own[a:a + 2_000, None] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint64(1))
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=0))
    grid = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(grid)], dtype=np.uint64).view(np.int64), least.astype(np.uint8).tobytes()


def _low(own: np.ndarray) -> np.ndarray:
    """Distinct 32-bit halves of a set: half the bytes to move, and chance matches far below one in a thousand shingles."""
    return np.unique(own.astype(np.uint32)).view(np.int32)


def with_node(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Add `node, n, fp, bands, sig` as a struct to every row; texts with equal shingle sets have one node, `n` is the size of the set, `fp` its SimHash."""
    kind = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def made(texts: pa.Array) -> pa.Array:
        common.worker_state("near copies", 0, bool)  # what other operators left in the worker goes
        out = []
        for t in texts:
            own = shingles(t.as_py() or "")
            hashes, sig = bands(own) if len(own) else ([], b"")
            out.append({"node": _node(own), "n": len(_low(own)), "fp": simhash.folded(own), "bands": hashes, "sig": sig})
        return pa.array(out, kind)
    common.bound_batches(docs.sparkSession)
    name = common.free_name(docs, "shingle_set")
    return docs.withColumn(name, F.arrow_udf(made, "node bigint, n int, fp bigint, bands array<bigint>, sig binary").asNondeterministic()(F.col(text))), name


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - 2**63


def _sets(texts: DataFrame) -> DataFrame:
    """`node, shingles` of `texts(text)`, which have different sets."""
    def made(column: pa.Array) -> pa.Array:
        every = [shingles(t.as_py() or "") for t in column]
        return pa.array([{"node": _node(own), "shingles": _low(own)} for own in every], pa.struct([("node", pa.int64()), ("shingles", pa.list_(pa.int32()))]))
    return texts.select(F.arrow_udf(made, "node bigint, shingles array<int>").asNondeterministic()("text").alias("s")).select("s.*")


def printed(heads: DataFrame) -> DataFrame:
    """Pairs `a, b` of the nodes `heads(node, n, fp)` that join what all fingerprints at most `simhash.RADIUS` bits apart join.

    Nodes of one fingerprint meet one of them, and that one the others over the links of the trees, so a large group costs its
    size. Pairs whose sizes do not allow the similarity are left out.
    """
    chosen = common.stored(heads.where("n > 0").groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("r")).select("fp", "r.*"), "near-prints")
    x, y = chosen.toDF("fp", "x", "nx"), chosen.toDF("fy", "y", "ny")
    linked = x.join(simhash.links(chosen.select("fp")), F.col("fp") == F.col("a")).join(y, F.col("b") == F.col("fy")).select("x", "nx", "y", "ny")
    same = heads.where("n > 0").select("fp", F.col("node").alias("y"), F.col("n").alias("ny")).join(x, "fp").where("x <> y").select("x", "nx", "y", "ny")
    near = linked.union(same).where(F.least("nx", "ny") >= LIKE * F.greatest("nx", "ny"))
    out = common.stored(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-printed")
    common.forget(chosen)
    return out


def _estimated(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs `x, y` whose sizes allow and whose signatures suggest the similarity; `agree` is the number of equal min-hashes."""
    def agree(xs: pa.Array, ys: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for v in (xs, ys))
        return pa.array((x == y).sum(axis=1), pa.int32())
    short = heads.select("node", "n", "sig")
    both = pairs.join(short.toDF("x", "nx", "sx"), "x").join(short.toDF("y", "ny", "sy"), "y").where(F.least("nx", "ny") >= LIKE * F.greatest("nx", "ny"))
    return both.select("x", "y", F.arrow_udf(agree, "int")("sx", "sy").alias("agree")).where(F.col("agree") >= AGREE)


def confirmed(pairs: DataFrame, sets: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs `a, b` whose shingle sets in `sets(node, shingles)` have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_state("near copies", 0, bool)
        for batch in batches:
            keep = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common_ >= like * (len(x) + len(y) - common_) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.select("a", "b", "sa", "sb").mapInArrow(alike, "a bigint, b bigint")


def sketch(own: np.ndarray) -> bytes:
    """Parities of a set's hashes by their last bits."""
    bits = min(max(SKETCH[0], 1 << (4 * len(own) - 1).bit_length()), SKETCH[1])
    return np.packbits(np.bincount(own.view(np.uint32) % bits, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _sketches(sets: DataFrame) -> DataFrame:
    """`node, sketch` of `sets(node, shingles)`."""
    def made(column: pa.Array) -> pa.Array:
        return pa.array([sketch(np.asarray(own.values)) for own in column], pa.binary())
    return sets.select("node", F.arrow_udf(made, "binary")("shingles").alias("sketch"))


def _narrowed(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, as words: halves of wider ones are laid on each other, which is the narrower sketch."""
    width, out = min(map(len, sketches)), []
    for one in sketches:
        bits = np.frombuffer(one, dtype=np.uint64)
        while bits.nbytes > width:
            bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
        out.append(bits)
    return np.stack(out)


def _agreeing(table: pa.Table, best: bool) -> pa.Table:
    """Pairs of nodes with different roots, of two pieces of a bucket (or within one), whose sketches and signatures allow the similarity.

    All of them, or for two roots only the pair whose signatures agree best.
    """
    node, root, n, piece, home = (np.asarray(table[c]) for c in ("node", "root", "n", "piece", "home"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint8).reshape(len(node), -1)
    odd = _narrowed(table["sketch"].to_pylist())
    left = np.flatnonzero(piece == piece.min())
    right = np.flatnonzero(piece == piece.max())
    none = np.zeros(0, dtype=np.int64)
    a, b, agree = [none], [none], [none]
    for x in left:
        fit = (root[right] != root[x]) & (home[right] | home[x]) & (np.minimum(n[right], n[x]) >= LIKE * np.maximum(n[right], n[x]))
        if left is right or piece[x] == piece.max():
            fit &= right > x
        other = right[fit]
        apart = np.bitwise_count(odd[other] ^ odd[x]).sum(axis=1, dtype=np.int64)
        other = other[apart <= (n[other] + n[x]) * ((1 - LIKE) / (1 + LIKE)) + 1e-6]
        same = (sig[other] == sig[x]).sum(axis=1)
        other, same = other[same >= AGREE], same[same >= AGREE]
        a.append(np.full(len(other), x))
        b.append(other)
        agree.append(same)
    x, y = np.concatenate(a), np.concatenate(b)
    if best and len(x):
        low, high, same = np.minimum(root[x], root[y]), np.maximum(root[x], root[y]), np.concatenate(agree)
        order = np.lexsort((-same, high, low))
        low, high = low[order], high[order]
        chosen = order[np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]]
        x, y = x[chosen], y[chosen]
    return pa.table({"x": node[x], "y": node[y]})


def _likely(placed: DataFrame, heads: DataFrame, sketches: DataFrame, best: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs `x, y` of `placed(band, hash, node, root)` in a common bucket, with different roots, that may be alike; or the `best` of each two roots there.

    Second is the stored step that they are computed from.
    """
    step = F.floor(F.log("n") / float(np.log(1 / LIKE))).cast("int")
    sized = placed.join(heads.select("node", "n"), "node").withColumn("class", F.explode(F.array(step, step + 1))).withColumn("home", F.col("class") == step)
    keys = ["band", "hash", "class"]
    mixed = sized.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select(*keys, "many")
    rows = step = common.stored(sized.join(mixed, keys), "near-mixed")
    rows = rows.join(heads.select("node", "sig"), "node").join(sketches, "node")
    rows = rows.withColumn("pieces", F.ceil(F.col("many") / PIECE).cast("int")).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(7)), F.col("pieces")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.withColumn("first", F.least("piece", "other")).withColumn("second", F.greatest("piece", "other"))
    pairs = rows.select(*keys, "first", "second", "node", "root", "n", "piece", "home", "sig", "sketch").groupBy(*keys, "first", "second")
    return pairs.applyInArrow(lambda table: _agreeing(table, best), "x bigint, y bigint"), step


def shared_buckets(heads: DataFrame) -> DataFrame:
    """`node, band, hash` of all buckets with more than one node."""
    bucket = heads.select("node", F.posexplode("bands").alias("band", "hash"))
    shared = bucket.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return common.stored(bucket.join(shared, ["band", "hash"]), "near-buckets")


def links(heads: DataFrame, bucket: DataFrame, sets: DataFrame, rounds: int = STAR_ROUNDS, near: DataFrame | None = None) -> DataFrame:
    """Links `a, b` that join what all candidate pairs of at least 0.8 join.

    For distinct nodes `heads(node, n, bands, sig)`, their shared buckets, the pairs `near(a, b)` of their fingerprints and the
    `sets(node, shingles)` of nodes in any of them. The pairs of fingerprints are confirmed first. In a round each node is compared with one node of its buckets, the one that looks most alike among those drawn as centres, so
    that a large group of near copies costs its size. Then the pairs of a bucket that are not yet in one group are compared
    by their sketches and signatures: first the likeliest of each two groups is confirmed, then all that are still likely.
    """
    found, sketches = None if near is None else common.stored(confirmed(near, sets), "near-links"), None
    for r in range(rounds + 2):
        steps = [] if found is None else [found]  # all that this round's links make needless
        placed = bucket.withColumn("root", F.col("node"))
        if found is not None:
            root = common.components(found)
            placed = bucket.join(root.withColumnRenamed("root", "joined"), "node", "left").select("node", "band", "hash", F.coalesce("joined", "node").alias("root"))
        if r < rounds:
            centre = placed.groupBy("band", "hash").agg(F.min(F.struct(F.xxhash64(F.lit(r), "node"), F.col("node"), F.col("root"))).alias("c"))
            drawn = placed.join(centre, ["band", "hash"]).where("root <> c.root").select(F.col("node").alias("x"), F.col("c.node").alias("y")).distinct()
            pairs = _estimated(drawn, heads).groupBy("x").agg(F.max(F.struct("agree", "y")).alias("best")).select("x", F.col("best.y").alias("y"))
        else:
            placed = common.stored(placed, "near-placed")
            sketches = common.stored(_sketches(sets), "near-sketches") if sketches is None else sketches
            pairs, mixed = _likely(placed, heads, sketches, best=r == rounds)
            steps += [placed, mixed]
        pairs = common.stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-pairs")
        fresh = confirmed(pairs, sets)
        found = common.stored(fresh if found is None else found.union(fresh), "near-links")
        common.forget(pairs, *steps)
    common.forget(sketches)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies stays, its columns unchanged: a row with the group's smallest id."""
    numbered, row = common.numbered(docs)
    texts = numbered.select("doc_id", "text", F.col(row[0]).alias("file"), F.col(row[1]).alias("at"))
    made, name = with_node(texts)
    small = common.stored(made.select("doc_id", "file", "at", f"{name}.*"), "near-nodes")
    one = small.groupBy("node").agg(F.min(F.struct("file", "at", "n", "fp", "bands", "sig")).alias("r")).select("node", "r.*")
    heads = common.stored(one, "near-heads")
    near, bucket = printed(heads), shared_buckets(heads)
    paired = near.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = common.stored(common.masks(heads.join(bucket.select("node").union(paired).distinct(), "node", "left_semi"), ["file", "at"]), "near-wanted")
    sets = common.stored(_sets(common.masked(numbered, row, wanted)), "near-sets")
    found = links(heads, bucket, sets, near=near)
    root = common.components(found)
    common.forget(found, sets, wanted, bucket, near, heads)
    member = small.select("doc_id", "file", "at", "node").join(root, "node", "left").select("doc_id", "file", "at", F.coalesce("root", "node").alias("root"))
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "at")).alias("m")).select("m.file", "m.at")
    kept = common.stored(common.masks(first, ["file", "at"]), "near-kept")
    common.forget(small)
    return common.masked(numbered, row, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
