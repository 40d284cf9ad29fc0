import math

import numpy as np

from crosstide.llm import topk as T

SCHEMA = "vec_id long, embedding array<double>, score string, number int, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if e is None else float(e) for e in v], "s", 3, "r") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * float(e)) for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        order = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j is None, j if j is not None else 0) for n, (j, c) in enumerate(whole) if n != at)
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(order[:k])]
    return sorted(out, key=str)


def got(df, **kw):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in T.search(df, **kw).collect()), key=str)


def test_equals_brute_force_across_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(-300, 900)]
    df = table(spark, rows)
    assert got(df) == brute(rows)
    assert got(df, query_block=5, candidate_block=100) == brute(rows)
    assert got(df, k=3, every=7, candidate_block=90, query_block=64) == brute(rows, 3, 7)


def test_sparse_rows_ties_and_odd_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 12) * (rng.random(12) < 0.3)).tolist()) for i in range(300)]
    rows += [(400, None), (500, [None]), (600, [math.nan, 1.0]), (700, [math.inf]), (800, []), (900, [0.0] * 12), (1000, [1.0] * 30),
             (1100, [1.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, rows[100][1]), (None, [5.0] * 12), (None, [5.0] * 12)]
    df = table(spark, rows)
    assert got(df) == brute(rows)
    assert got(df, candidate_block=40, query_block=2) == brute(rows)


def test_copies_of_one_vector(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(2000)]
    assert got(table(spark, rows), candidate_block=256) == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(100, [1.0])], [(100, [1.0]), (200, [2.0]), (3, [-1.0])], [(1, [1.0]), (2, [1.0])]):
        out = T.search(table(spark, rows))
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows) and out.columns == ["query_id", "rank", "vec_id", "score"]


def test_large_values(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50, (rng.normal(size=6) * 3e5).tolist()) for i in range(40)]
    assert got(table(spark, rows)) == brute(rows)
    far = T.search(table(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])])).collect()
    assert [(r.vec_id, r.score) for r in sorted(far, key=lambda r: r["rank"])] == [(1, 2 ** 63 - 1), (2, 1 - 2 ** 63)]


def test_scores_and_selection():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (10, 10), (50, 7), (200, 1)):
        row = rng.integers(-3, 3, n)
        assert T.select(row, k).tolist() == sorted(range(n), key=lambda i: (-row[i], i))[:k]
    assert T.select(np.zeros(0, np.int64), 4).tolist() == []
