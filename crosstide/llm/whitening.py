"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors become integers x = floor(scale * c). The fit list is each distinct x once:

1. One pass sums its components exactly, which gives the mean.
2. One pass adds up the scatter of the centred vectors: a task multiplies its rows, Spark sums the entries of the tasks'
   triangles. What reaches the driver depends on the dimension alone, never on the number of rows.
3. On the driver, the scatter's pivoted Cholesky factor L (its rows permuted); plane rotations from the right make
   L's columns orthogonal, whole rounds of disjoint pairs at a time. The squared column norms are the
   scatter's eigenvalues, the normalised columns its eigenvectors.
4. One pass measures the covariance of the whitened fit list.

Centring is exact: the integer part of the mean is subtracted in integers, its fraction afterwards.

Defined cases: vectors that are null or hold null or non-finite entries take no part. The fit takes the length
that most distinct vectors have (the smaller one of a tie); vectors of other lengths take no part either. Directions
without variance are no components, so constant data, a single distinct vector or an empty table give no rows.
Rows that repeat are returned as often as they stand there; a null vec_id stays. Long vectors are worked on a
bounded number of cells at a time. A deviation that no long can hold is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosstide.llm.vectors import exact, lists, longs, matrices, of_list, finite, floors
from crosstide.session import stage

SCALE = 256
COMPONENTS = 4
EPS = np.finfo(float).eps
SWEEPS = 60


# -- dense factors -------------------------------------------------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with L lower trapezoidal, one column per step, and a[order][:, order] = L L'."""
    d = len(a)
    a, order, left = a.astype(float), np.arange(d), np.diag(a).astype(float).copy()
    low = np.zeros((d, d))
    floor = d * EPS * left.max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > floor:
            return order, low[:, :k]
        if p != k:
            swap, back = [k, p], [p, k]
            a[swap], order[swap], left[swap], low[swap] = a[back], order[back], left[back], low[back]
            a[:, swap] = a[:, back]
        low[k, k] = np.sqrt(left[k])
        low[k + 1:, k] = (a[k + 1:, k] - low[k + 1:, :k] @ low[k, :k]) / low[k, k]
        left[k + 1:] -= low[k + 1:, k] ** 2
    return order, low


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], reversed(seats[half:]), strict=True) if max(p, q) < n]
        yield np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def orthogonal_columns(g: np.ndarray) -> np.ndarray:
    """The columns of ``g`` rotated in planes until every two of them are orthogonal to working precision."""
    g = g.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(a) * np.sqrt(b)
            off = np.divide(np.abs(c), scale, out=np.zeros_like(c), where=scale > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > EPS
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if worst <= len(g) * EPS:
            break
    return g


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues in falling order and their unit eigenvectors as columns."""
    order, low = pivoted_cholesky(scatter)
    turned = orthogonal_columns(low)
    norms = np.sqrt((turned * turned).sum(0))
    fall = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(turned)
    vectors[order] = turned[:, fall] / norms[fall]
    return norms[fall] ** 2, vectors


# -- passes over the table -----------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """``sums`` are exact; ``components`` are columns; ``trace`` and ``values`` belong to the covariance."""
    scale: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], dtype=object)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        largest = max([float(np.abs(x.astype(float)).max(initial=0.0)), *[abs(float(w)) for w in whole]])
        x = exact(x, 2 * largest)
        return (x - whole.astype(x.dtype)).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - sum) squared, exact."""
        sums = np.array(self.sums, dtype=object)
        largest = self.n * float(np.abs(x.astype(float)).max(initial=0.0)) + max(abs(float(s)) for s in self.sums)
        x = exact(x, self.dims * largest * largest)
        apart = x * self.n - sums.astype(x.dtype)
        return (apart * apart).sum(1)


def _distinct(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, offsets, entries = finite(batch.column(0))
            rows = np.flatnonzero(usable)
            keep = pa.array(rows)
            scaled = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(floors(np.nan_to_num(entries), scale)))
            yield pa.RecordBatch.from_arrays([scaled.take(keep)], ["x"])
    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # high and low halves, so that no sum of longs overflows within a task
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = of_list(batch.column(0))
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)],
                                         ["dim", "n", "high", "low"])


def _scatter(of: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """The upper triangle of the summed products of ``of(x)``'s columns; row -1 has the columns' sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                z = of(of_list(batch.column(0)))
                total, sums = total + z.T @ z, sums + z.sum(0)
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(total), -1), i)), pa.array(np.append(np.arange(len(total)), j)),
                                              pa.array(np.append(sums, total[i, j]))], ["i", "j", "value"])
    return run


def _summed(fit_list: DataFrame, of: Callable[[np.ndarray], np.ndarray], d: int) -> tuple[np.ndarray, np.ndarray]:
    sums, total = np.zeros(d), np.zeros((d, d))
    for r in fit_list.mapInArrow(_scatter(of), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if r.i < 0:
            sums[r.j] = r.value
        else:
            total[r.i, r.j] = total[r.j, r.i] = r.value
    return sums, total


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The whitening of the distinct integer vectors of ``df``; its tables on the driver have dimension squared entries."""
    fit_list = stage(df.select(vector).mapInArrow(_distinct(scale), "x array<bigint>").distinct())
    commonest = fit_list.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if commonest is None or commonest.d == 0:
        return Whitening(scale, 0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    fit_list = fit_list.filter(F.size("x") == commonest.d)
    wide = "decimal(38,0)"
    parts = fit_list.mapInArrow(_sums, "dim long, n long, high long, low long").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")).orderBy("dim").collect()
    model = Whitening(scale, parts[0].n, tuple((int(p.high) << 32) + int(p.low) for p in parts), np.zeros(0), np.zeros((0, 0)), 0.0)
    scatter = _summed(fit_list, model.centred, model.dims)[1]
    values, vectors = eigen(scatter)
    k = min(components, len(values))
    model = Whitening(scale, model.n, model.sums, values[:k] / model.n, vectors[:, :k], float(np.trace(scatter)) / model.n)
    sums, products = _summed(fit_list, model.whitened, k)
    error = np.abs(products / model.n - np.outer(sums, sums) / model.n ** 2 - np.eye(k)).max(initial=0.0)
    return Whitening(scale, model.n, model.sums, model.values, model.components, model.trace, float(error))


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, whitened, deviation) of every row with a usable vector; no shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1), model.dims, model.scale) if model.n else ():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(model.whitened(x)), longs(model.deviations(x))],
                                                 [key, "whitened", "deviation"])
    return df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, whitened array<double>, deviation bigint")


def report(df: DataFrame) -> DataFrame:
    """The contract's rows: one per vector and component."""
    model = fit(df)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if model.trace > 0 else F.array().cast("array<double>")
    each = whiten(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
