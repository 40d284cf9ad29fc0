import hashlib
import math

import numpy as np

from crosstide.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if e is None else float(e) for e in v], "c", 1) for i, v in rows], SCHEMA)


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(e)) for e in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [list(x) for _, x in first[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        points = [[sum(x[j] for (_, x), o in zip(kept, own, strict=True) if o == c) // own.count(c) for j in range(64)] if c in own else p
                  for c, p in enumerate(points)]
    placed = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(d for _, _, d in placed)
    return sorted((-1 if i is None else i, c, d, sum(e for _, o, e in placed if o == c), total,
                   hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, c, d in placed)


def got(spark, rows):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in C.report(table(spark, rows)).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64)) / 8
    rows = [(i, (centres[i % 5] + rng.normal(size=64) / 16).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 63), (1002, [0.0] * 65), (1003, [None] + [0.0] * 63), (1004, [math.nan] + [0.0] * 63),
             (1005, [-math.inf] + [0.0] * 63), (1006, []), (None, [0.1] * 64)]
    assert got(spark, rows) == brute(rows)


def test_ties_copies_and_repeated_ids(spark):
    # few different vectors: equal centroids, equal distances, many copies, ids that repeat
    grid = [[(j % 3 == m) * 0.5 - 0.01 * (m > 1) for j in range(64)] for m in range(4)]
    rows = [(i // 2, grid[i % 4]) for i in range(120)]
    assert got(spark, rows) == brute(rows)


def test_few_or_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert got(spark, rows) == brute(rows)
    for none in ([], [(1, None), (2, [1.0])]):
        out = C.report(table(spark, none))
        assert out.count() == 0
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_and_negative_values(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-10 ** 5, 10 ** 5, 64) * (1.0 if i % 2 else 10.0)).tolist()) for i in range(60)]
    assert got(spark, rows) == brute(rows)
    far = C.report(table(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)])).collect()
    assert sorted(r.distance for r in far) == [0, 0, 0]         # three vectors, three centroids
    wide = C.vectors(table(spark, [(i, [(-1.0) ** i * 1e300] * 64) for i in range(8)]))
    apart = C.assign(wide, C.Clustering(((0,) * 64,))).collect()
    assert all(r.cluster == 0 and r.distance is None for r in apart)


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(9)
    for k, d, spread in ((1, 3, 5), (2, 1, 2), (7, 2, 3), (64, 2, 20), (200, 3, 400), (33, 64, 50)):
        points = rng.integers(-spread, spread, (k, d))
        x = rng.integers(-spread, spread, (700, d))
        x[:k] = points[:700]
        number, best, _ = C.VantageTree(points).nearest(x)
        d2 = ((x[:, None, :] - points[None]) ** 2).sum(2)
        assert (best == d2.min(1)).all() and (number == d2.argmin(1)).all()
    points = rng.integers(-10 ** 6, 10 ** 6, (256, 2))
    x = points[rng.integers(0, 256, 5000)] + rng.integers(-9, 9, (5000, 2))
    number, _, count = C.VantageTree(points).nearest(x)
    assert (number == ((x[:, None, :] - points[None]) ** 2).sum(2).argmin(1)).all()
    assert count < 5000 * 256 / 8
    # integers beyond a long are exact too
    big = np.array([[2 ** 61, 0], [2 ** 61 + 1, 0], [-2 ** 61, 5]], dtype=object)
    number, best, _ = C.VantageTree(big).nearest(np.array([[2 ** 61 + 1, 0], [-2 ** 62, 0]], dtype=np.int64))
    assert number.tolist() == [1, 2] and best[1] == (2 ** 61) ** 2 + 25
