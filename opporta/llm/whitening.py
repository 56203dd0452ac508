"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors, refinement by matrix products.

Every entry c becomes the whole number x = floor(64 c) + 1000000. With n distinct vectors and sums S, the numbers n x - S are whole
too, so the covariance is summed without rounding: each task multiplies its centred rows in 20-bit limbs, whose float64
products stay below 2 ** 53, and sends one total for each pair of dimensions. The matrix (dimensions squared, whatever the
number of rows) goes to the driver. Its float32 eigenvectors are corrected there in extended precision by the iteration of
Ogita and Aishima, which uses matrix products alone and squares the error in each round. Eigenvalues too close for it form
clusters; the matrix is shifted by the cluster's mean, projected on the cluster and solved by itself in the same way.

Defined results: vectors that are null, empty, hold a null or a non-finite entry, or an entry beyond 2 ** 55 (x would not fit a
long) take no part, nor do vectors of another length than the most frequent one (of equally frequent ones the longest).
Repeated rows each get their result and count once in the fit; a null id stays null. Components whose eigenvalue is zero to
double precision (fewer distinct vectors than dimensions, one vector) have no whitened value and no rows; an empty table has
none. A deviation beyond a long is null. Columns beside the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opporta.llm import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(2**55)  # of an entry: 64 times as much still fits a long
LIMB, ROWS = 20, 4_096  # bits of a limb, rows of one product: 4,096 * 2 ** 40 < 2 ** 53
SENT = 40  # bits of a total that are summed as one long
ROUNDS = 8
_EPS = np.finfo(np.longdouble).eps


@dataclass
class Whitening:
    """`sums` of z = x - 1000000 over n distinct vectors; unit `vectors` (one column each) and eigenvalues, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: np.longdouble
    identity_error: float = 0.0

    def projection(self) -> np.ndarray:
        return (self.vectors / np.sqrt(self.values)).astype(np.float64)


def quantised(frame: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Usable rows as `vec_id, z`, z = floor(64 c), all of the most frequent length."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) <= LARGEST))
    rows = frame.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))).select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.transform(v, lambda e: F.floor(e.cast("double") * SCALE)).alias("z"))
    usual = rows.groupBy(F.size("z").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("z") == (usual.d if usual else 0))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def centred(z: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n z - sums, exactly: long, or Python integers where a long is too short."""
    if n * int(np.abs(z).max(initial=0)) + max(map(abs, sums), default=0) >= 2**62:
        return z.astype(object) * n - np.array(sums, dtype=object)
    return z * n - np.array(sums, dtype=np.int64)


def squares(w: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, null beyond a long."""
    if w.shape[1] * int(np.abs(w).max(initial=0)) ** 2 < 2**63:
        return (w * w).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (w.astype(object) ** 2).sum(axis=1)]


def exact_gram(w: np.ndarray) -> np.ndarray:
    """w' w as Python integers, by float64 products of limbs that are exact."""
    bits = int(np.abs(w).max(initial=0)).bit_length() + 1
    limbs, rest = [], w
    for _ in range(-(-bits // LIMB) - 1):
        limbs.append((rest & (1 << LIMB) - 1).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))  # the highest one has the sign
    total = np.zeros((w.shape[1],) * 2, dtype=object)
    for a, x in enumerate(limbs):
        for b, y in enumerate(limbs):
            own = sum((x[r:r + ROWS].T @ y[r:r + ROWS]).astype(np.int64).astype(object) for r in range(0, len(w), ROWS))
            total += own * (1 << LIMB * (a + b))
    return total


def _totals(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Exact sum of `part(z)`, a matrix of integers, over all batches of `rows(z)`; None without rows.

    A task sends one row for each entry and 40 bits of it, so their number does not grow with its input.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is None:
            return
        at = np.indices(total.shape).reshape(2, -1)
        rest, k = total.reshape(-1).astype(object), 0
        while True:
            last = all(-(1 << SENT) < v < 1 << SENT for v in rest)
            own = rest if last else rest & (1 << SENT) - 1
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(np.full(len(rest), k), pa.int32()),
                                              pa.array(own.tolist(), pa.int64())], names=["i", "j", "k", "v"])
            if last:
                return
            rest, k = rest >> SENT, k + 1
    common.bound_batches(rows.sparkSession)
    found = rows.select("z").mapInArrow(summed, "i int, j int, k int, v bigint").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    if not found:
        return None
    out = np.zeros((max(r.i for r in found) + 1, max(r.j for r in found) + 1), dtype=object)
    for r in found:
        out[r.i, r.j] += r.v << SENT * r.k
    return out


def _extended(top: int, bottom: int) -> np.longdouble:
    """top / bottom in extended precision."""
    exact = Fraction(top, bottom)
    high = float(exact)
    return np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One round of Ogita and Aishima: better vectors, eigenvalues, the distance that counts as close, size of the step."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    size = np.sqrt((a * a).sum())
    off = s - np.diag(values)
    close = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())) + 4 * np.sqrt(_EPS) * size  # nearer ones would only take up noise
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > close
    step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ step, values, float(close), float(np.abs(step).max())


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors of a symmetric matrix in extended precision."""
    size = np.abs(a).max(initial=0)
    if len(a) < 2 or size == 0:
        return np.diag(a).copy(), np.eye(len(a), dtype=a.dtype)
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    before = np.inf
    for _ in range(ROUNDS):
        x, values, close, step = _refined(a, x)
        if step <= 4 * _EPS or step >= before:
            break
        before = step
    order = np.argsort(-values)
    x, values = x[:, order], values[order]
    for own in np.split(np.arange(len(a)), np.flatnonzero(-np.diff(values) > close) + 1):
        part, middle = x[:, own], values[own].mean()
        inner = part.T @ (a @ part - middle * part)
        if len(own) > 1 and 8 * len(a) * _EPS < np.abs(inner).max() < 0.5:  # smaller: the values are equal, any basis will do
            more, turned = eigen(inner)
            x[:, own], values[own] = part @ turned, middle + more
    order = np.argsort(-values)
    x, values = x[:, order], values[order]
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values * size, x * sign


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors in `vectors(z)`; None if there are none."""
    distinct = common.stored(vectors.select("z").distinct(), "whitening-fit")
    first = _totals(distinct, lambda z: np.concatenate([[len(z)], z.astype(object).sum(axis=0)])[None, :])
    if first is None:
        return None
    n, sums = int(first[0, 0]), [int(s) for s in first[0, 1:]]
    products = _totals(distinct, lambda z: exact_gram(centred(z, n, sums)))
    covariance = np.array([[_extended(v, n**3) for v in row] for row in products], dtype=np.longdouble)
    values, vectors_ = eigen(covariance)
    keep = (values[:components] > len(values) * np.finfo(np.float64).eps * values[0]).sum()
    model = Whitening(n, sums, values[:keep], vectors_[:, :keep], np.trace(covariance))
    model.identity_error = _identity_error(distinct, model)
    return model


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    n, sums, by = model.n, model.sums, model.projection()
    k = by.shape[1]
    if not k:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            y = (centred(_matrix(batch.column(0)), n, sums).astype(np.float64) / n) @ by
            total += np.vstack([y.sum(axis=0), y.T @ y])
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "v"])
    total = np.zeros((k + 1, k))
    for r in distinct.select("z").mapInArrow(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v
    mean = total[0] / n
    return float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row of `rows(vec_id, z)` and component of the model."""
    n, sums, by = model.n, model.sums, model.projection()
    explained, error = (model.values / model.trace).astype(np.float64), model.identity_error
    kind = dict(rows.dtypes)["vec_id"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not by.shape[1]:
                continue
            w = centred(_matrix(batch["z"]), n, sums)
            y, many = (w.astype(np.float64) / n) @ by, by.shape[1]
            row = np.repeat(np.arange(len(w)), many)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(row)), pa.array(np.tile(np.arange(1, many + 1), len(w)), pa.int32()), pa.array(np.full(len(row), n), pa.int64()),
                pa.array(squares(w), pa.int64()).take(pa.array(row)), pa.array(y.reshape(-1)), pa.array(np.tile(explained, len(w))), pa.array(np.full(len(row), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(made, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def report(embeddings: DataFrame) -> DataFrame:
    """All usable rows of `embeddings`, whitened by their own covariance."""
    rows = quantised(embeddings)
    model = fit(rows)
    return whitened(rows, model or Whitening(1, [], np.zeros(0), np.zeros((0, 0)), np.longdouble(1)))
