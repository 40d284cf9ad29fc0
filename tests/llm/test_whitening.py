import numpy as np
import pytest

from crosstide.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, component int, x string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 1, "x")
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def check(spark, vectors, ids=None, places=1e-9):
    """Holds the report against exact sums and a dense eigensolver."""
    ids = list(range(len(vectors))) if ids is None else ids
    good = [(i, [int(np.floor(256 * e)) for e in v]) for i, v in zip(ids, vectors, strict=True)
            if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in distinct])
    values, vecs = np.linalg.eigh(z.T @ z / n)
    values, vecs = values[::-1][:4], vecs[:, ::-1][:, :4]
    got = W.report(table(spark, vectors, ids)).collect()
    assert len(got) == 4 * len(good) and {r.component for r in got} == {1, 2, 3, 4}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(z.T @ z / n), rel=1e-9)
    for c in range(4):
        want = {i: (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ vecs[:, c]) / np.sqrt(values[c]) for i, x in good}
        sign = max((1, -1), key=lambda s: sum(s * by[i][c + 1].whitened * w for i, w in want.items()))
        assert all(abs(sign * by[i][c + 1].whitened - w) < places * max(1, abs(w)) for i, w in want.items())
    for i, x in good:
        assert by[i][1].deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
    return got


def test_equals_dense_eigensolver(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(2, 0.2, 12)
    bad = [None, [1.0, None, *[0.0] * 10], [float("nan"), *[0.0] * 11], [float("inf"), *[0.0] * 11]]
    check(spark, [*base.tolist(), *bad])


def test_copies_count_once_in_the_fit_and_are_returned_each(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)).tolist()
    near = [[e + 1e-9 if np.floor(256 * (e + 1e-9)) == np.floor(256 * e) else e for e in base[0]]]
    got = check(spark, base + [base[0]] * 200 + near)
    assert got[0].n == 60
    repeated = W.report(table(spark, base + [base[1]], [*range(60), 1])).collect()
    assert sum(r.vec_id == 1 for r in repeated) == 8
    unnamed = W.report(table(spark, base, [None, *range(59)])).collect()
    assert sum(r.vec_id is None for r in unnamed) == 4


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(5)
    check(spark, (rng.normal(size=(80, 5)) * [3, 2, 1, 0.5, 0.25] + [1e6, -1e6, 3e7, 0, 1e8]).tolist(), places=1e-7)


def test_deviations_beyond_a_long_are_null(spark):
    far = [[0.0, 1.0], [1e12, 5.0], [3.0, 1e300], [-1e300, 2.0]]
    got = W.report(table(spark, far)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3} and all(r.deviation is None for r in got)


def test_fewer_components_than_asked(spark):
    line = [[k, 2 * k, -k, 0.0] for k in range(5)]
    got = W.report(table(spark, line)).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    for flat in ([], [[1.0, 2.0]] * 3, [None, [None]], [[], []], [[1.0, 2.0]]):
        out = W.report(table(spark, flat))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_other_lengths_take_no_part(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 5)).tolist()
    got = W.report(table(spark, [*base, [1.0], [], [0.0] * 9])).collect()
    assert {r.vec_id for r in got} == set(range(40))


def test_long_vectors(spark):
    rng = np.random.default_rng(7)
    wide = rng.normal(size=(30, 200)).tolist()
    check(spark, wide, places=1e-7)


def test_factors():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 7), (20, 5), (33, 33)):
        b = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        a = b @ b.T
        order, low = W.pivoted_cholesky(a)
        assert low.shape[1] == rank and np.allclose(low @ low.T, a[np.ix_(order, order)], rtol=1e-9, atol=1e-9 * np.trace(a))
        assert all(low[:k, k].max(initial=0) == 0 for k in range(rank))         # lower trapezoidal
        turned = W.orthogonal_columns(low)
        gram = turned.T @ turned
        scale = np.sqrt(np.diag(gram))
        assert np.abs(gram / np.outer(scale, scale) - np.eye(rank)).max() < 1e-13
        values, vectors = W.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-8, atol=1e-12 * np.trace(a))
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * np.trace(a))
    assert W.eigen(np.zeros((3, 3)))[0].size == 0


def test_rounds_meet_every_pair_once():
    for n in (1, 2, 3, 8, 9):
        seen = [(p, q) for ps, qs in W._rounds(n) for p, q in zip(ps, qs, strict=True)]
        assert sorted(seen) == [(p, q) for p in range(n) for q in range(p + 1, n)]
