import random

from crosstide.plans.registry import present


def test_seven_digits_round_the_exact_value_half_to_even(spark):
    rng = random.Random(1)
    halves = [4.2578125, 27.515625, -27.515625, 0.22265625, 10000000.5, 12345675.0, 1234567500000.0, 9.9999995, 1.0000005, 0.00012345675, 12345.665]
    halves += [int(f"{rng.randrange(10 ** 6, 10 ** 7)}5") * 10.0 ** -rng.randrange(-5, 16) for _ in range(3000)]
    halves += [rng.randrange(1, 2 ** 24) / 2.0 ** rng.randrange(0, 24) for _ in range(3000)]
    plain = [rng.gauss(0, 1) * 10.0 ** rng.randrange(-8, 12) for _ in range(2000)] + [0.0, -0.0, 1e-12, 1.0, 10.0, 99999999.0, 1e15]
    rows = [(i, float(x)) for i, x in enumerate([*halves, *[-x for x in halves], *plain])] + [(-1, None)]
    got = {r.i: r.x for r in present(spark.createDataFrame(rows, "i long, x double"), "i:i x:e").collect()}
    assert got[-1] is None
    assert {i: got[i] for i, x in rows if x is not None} == {i: f"{x if abs(x) >= 1e-9 else 0.0:.6e}" for i, x in rows if x is not None}
