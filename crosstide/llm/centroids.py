"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Each round the driver builds a vantage-point tree over the centroids (k of them, a parameter) and sends it to the
tasks. A vector finds its nearest centroid by best-first branch and bound: of its open nodes it visits the
one with the smallest lower bound, and stops when that bound lies beyond its best distance. A node at exactly the best
distance is still visited, as it may hold an equally near centroid with a smaller number. A batch of vectors
takes these steps together: the vectors that are at the same node are one matrix operation.

Bounds use doubles and are lowered by more than their rounding; distances at vantage points and leaves, ties, sums
and floored means are exact integers. A task sums its vectors per cluster, so a round sends k * d sums per task and shuffles no
vector. Vectors are staged once as integers.

Defined cases: vectors that are null, hold null or non-finite entries or have another length than ``dims`` take no
part. With fewer vectors than k there are as many centroids; an empty table gives no rows. Equal ids
share a hash: their vectors are taken in the order of their components; null ids come last. Equal centroids leave the higher
number empty, and it stays where it is. A distance or inertia that no long can hold is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosstide.llm.vectors import exact, lists, longs, matrices, of_list
from crosstide.session import stage

K, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
LEAF = 2
SLACK = 1e-9        # of the lengths in a bound; their rounding is below 1e-14
ROWS = 1 << 14


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``point``."""
    apart = x - point
    return (apart * apart).sum(1)


def lengths(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float))


@dataclass(frozen=True)
class Node:
    """A vantage point (a centroid's number) with two child nodes, or a leaf's numbers. Children come with the nearest
    and farthest distance of their centroids from the vantage point."""
    numbers: tuple[int, ...]
    children: tuple[tuple[int, float, float], ...] = ()


class VantageTree:
    """A vantage-point tree over the rows of ``points``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[Node] = []
        if len(points):
            self._build(list(range(len(points))))

    def _build(self, numbers: list[int]) -> int:
        at = len(self.nodes)
        if len(numbers) <= LEAF:
            self.nodes.append(Node(tuple(numbers)))
            return at
        # the point that lies farthest from the first one sees the others at well spread distances
        vantage = numbers[int(np.argmax(lengths(squared(self.points[numbers], self.points[numbers[0]]))))]
        rest = np.array([i for i in numbers if i != vantage])
        away = lengths(squared(self.points[rest], self.points[vantage]))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        self.nodes.append(Node((vantage,)))
        children = []
        for part in (order[:half], order[half:]):
            if len(part):
                children.append((self._build(rest[part].tolist()), float(away[part].min()), float(away[part].max())))
        self.nodes[at] = Node((vantage,), tuple(children))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, the smaller number of equally near ones; and how many
        distances that took."""
        n, count = len(x), 0
        largest = float(np.abs(x.astype(float)).max(initial=0.0)) + float(np.abs(self.points.astype(float)).max(initial=0.0))
        fits = x.shape[1] * largest * largest
        x, points = exact(x, fits), exact(self.points, fits)
        best = np.full(n, -1, x.dtype)
        number = np.full(n, -1)
        reach = np.full(n, np.inf)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        active = np.arange(n)
        while len(active):
            pick = bound[active].argmin(1)
            low = bound[active, pick]
            on = (low <= reach[active]) & (low < np.inf)        # inclusive
            active, pick = active[on], pick[on]
            for at in np.unique(pick):
                node, rows = self.nodes[at], active[pick == at]
                parent = bound[rows, at]
                bound[rows, at] = np.inf
                for c in node.numbers:
                    d2 = squared(x[rows], points[c])
                    count += len(rows)
                    held, old = best[rows], number[rows]
                    wins = (old < 0) | (d2 < held) | ((d2 == held) & (c < old))
                    best[rows[wins]], number[rows[wins]] = d2[wins], c
                away = lengths(d2)
                reach[rows] = lengths(best[rows])
                for child, near, far in node.children:
                    apart = np.maximum(near - away, away - far) - SLACK * (away + far)
                    bound[rows, child] = np.maximum(parent, apart)
        return number, best, count


@dataclass(frozen=True)
class Clustering:
    points: tuple[tuple[int, ...], ...]

    def tree(self) -> VantageTree:
        matrix = np.array(self.points, dtype=object).reshape(len(self.points), -1 if self.points else 0)
        small = all(-2 ** 62 < v < 2 ** 62 for p in self.points for v in p)
        return VantageTree(matrix.astype(np.int64) if small else matrix)


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[slice, np.ndarray]]:
    x = of_list(batch.column(at))
    for first in range(0, len(x), ROWS):
        yield slice(first, first + ROWS), x[first:first + ROWS]


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(key, x) of the usable vectors, staged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column(1), dims, scale):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists(x)], [key, "x"])
    kind = df.schema[key].dataType.simpleString()
    return stage(df.select(key, vector).mapInArrow(run, f"`{key}` {kind}, x array<bigint>"))


def start(x: DataFrame, key: str = "vec_id", k: int = K, seed: str = SEED) -> Clustering:
    """The k vectors whose ids have the smallest hashes."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = x.orderBy(drawn.asc_nulls_last(), F.col(key), F.col("x")).limit(k).select("x").collect()
    return Clustering(tuple(tuple(r.x) for r in rows))


def _totals(model: Clustering) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.tree()
        k, d = len(model.points), len(model.points[0])
        # high and low halves, so that no sum of longs overflows within a task
        high, low, count = np.zeros((k, d), np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _slices(batch, 0):
                number = tree.nearest(x)[0]
                for c in np.unique(number):
                    own = x[number == c]
                    high[c] += (own >> 32).sum(0)
                    low[c] += (own & 0xFFFFFFFF).sum(0)
                    count[c] += len(own)
        held = np.flatnonzero(count)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, d)), pa.array(np.tile(np.arange(d), len(held))), pa.array(np.repeat(count[held], d)),
                                              pa.array(high[held].ravel()), pa.array(low[held].ravel())], ["cluster", "dim", "n", "high", "low"])
    return run


def moved(x: DataFrame, model: Clustering) -> Clustering:
    """Non-empty centroids at the floored means of their vectors; at most k * d sums reach the driver."""
    wide = "decimal(38,0)"
    parts = x.select("x").mapInArrow(_totals(model), "cluster long, dim long, n long, high long, low long").groupBy("cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    points = [list(p) for p in model.points]
    for r in parts.collect():
        points[r.cluster][r.dim] = ((int(r.high) << 32) + int(r.low)) // r.n
    return Clustering(tuple(map(tuple, points)))


def fit(x: DataFrame, key: str = "vec_id", k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> Clustering:
    """The centroids after ``rounds`` rounds over staged vectors."""
    model = start(x, key, k, seed)
    for _ in range(rounds if model.points else 0):
        model = moved(x, model)
    return model


def assign(x: DataFrame, model: Clustering, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance): the nearest centroid of every vector and its squared distance; no shuffle."""
    kind = x.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.tree()
        for batch in batches:
            for rows, part in _slices(batch, 1):
                number, best, _ = tree.nearest(part)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(number, pa.int32()), longs(best)], [key, "cluster", "distance"])
    return x.select(key, "x").mapInArrow(run, f"`{key}` {kind}, cluster int, distance bigint")


def report(df: DataFrame) -> DataFrame:
    """The contract's rows: one per vector."""
    x = vectors(df)
    model = fit(x)
    placed = stage(assign(x, model))
    digests = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in model.points]
    wide = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    # at most k rows
    sums = {r.cluster: r.own for r in wide.collect()}
    long = lambda v: None if v is None or not -2 ** 63 <= v < 2 ** 63 else int(v)
    inertia = None if any(v is None for v in sums.values()) else long(sum(sums.values()))
    own = F.array(*[F.lit(long(sums.get(c))).cast("long") for c in range(len(digests))]).cast("array<bigint>")
    return placed.select("vec_id", "cluster", "distance", F.get(own, "cluster").alias("cluster_inertia"),
                         F.lit(inertia).cast("long").alias("inertia"),
                         F.get(F.array(*map(F.lit, digests)).cast("array<string>"), "cluster").alias("centroid_sha256"))


def _sql() -> str:
    """The rounds of the contract unrolled; distances from components in long form."""
    def near(at: int) -> str:
        return (f"d{at} as (select v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x)) as distance from long_form v join c{at} c on c.dim = v.dim "
                f"group by all),\na{at} as (select vec_id, cluster, distance from d{at} qualify row_number() over "
                f"(partition by vec_id order by distance, cluster) = 1)")
    parts = [f"""with kept as (select vec_id, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as hugeint)) as x from embeddings
  where embedding is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIMS}),
long_form as (select vec_id, unnest(x) as x, unnest(range(1, {DIMS + 1})) as dim from kept),
first as (select vec_id, row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as cluster from kept
  qualify cluster < {K}),
c0 as (select f.cluster, v.dim, v.x from long_form v join first f using (vec_id))"""]
    for at in range(ROUNDS):
        parts.append(near(at))
        # floor division that is exact for negative sums
        parts.append(f"""m{at + 1} as (select a.cluster, v.dim, sum(v.x) as s, count(*) as n from long_form v join a{at} a using (vec_id) group by all),
c{at + 1} as (select c.cluster, c.dim, case when m.n is null then c.x else (m.s - ((m.s % m.n) + m.n) % m.n) // m.n end as x
  from c{at} c left join m{at + 1} m on m.cluster = c.cluster and m.dim = c.dim)""")
    parts.append(near(ROUNDS))
    names = f"(select cluster, sha256(string_agg(cast(x as varchar), ',' order by dim)) as centroid_sha256 from c{ROUNDS} group by cluster)"
    return ",\n".join(parts) + f"""
select a.vec_id, cast(a.cluster as int) as cluster, cast(a.distance as bigint) as distance,
  cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia, cast(sum(a.distance) over () as bigint) as inertia, centroid_sha256
from a{ROUNDS} a join {names} using (cluster)"""


SQL = _sql()
