import math
import random

import numpy as np
from pyspark.sql import functions as F

from crosstide.operators.ranking import quantile_table, with_position
from crosstide.session import noted


def test_quantiles_by_counts_are_exact_and_write_no_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, -0.0, 1.0, -2.5, None, rng.gauss(0, 1), rng.gauss(0, 1e-9), -rng.random() * 1e12, 5e-324]),
             rng.gauss(5, 1e-6)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    with noted() as paths:
        got = {r.g: r for r in quantile_table(df, ["g"], ["x", "y"], [0.01, 0.5, 0.977]).collect()}
    assert sum(spark.read.parquet(p).count() for p in paths) < 200
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        for i, c in ((1, "x"), (2, "y")):
            values = [row[i] for row in rows if row[0] == g and row[i] is not None]
            for j, p in enumerate((0.01, 0.5, 0.977)):
                assert math.isclose(r[f"{c}_q{j}"], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-300)


def test_quantiles_of_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(x,) for x in (float("inf"), float("-inf"), 1.0, float("nan"), None)], "x double")
    r = quantile_table(df, [], ["x"], [0.0, 1 / 3, 2 / 3, 1.0]).first()
    assert (r.x_q0, r.x_q1, r.x_q2) == (float("-inf"), 1.0, float("inf")) and math.isnan(r.x_q3)
    assert quantile_table(df.where("false"), [], ["x"], [0.5]).first().x_q0 is None


def test_positions_in_small_groups_write_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("x"), F.col("id").alias("t"))
    with noted() as paths:
        got = with_position(df, ["g"], "x", "t", "place").collect()
    assert not paths
    for g in range(7):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.x, r.t))
        assert [r.place for r in own] == [*range(1, len(own) + 1)]
