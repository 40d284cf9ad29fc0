"""Rows of the panel are not shuffled for tables that hold a row per date or group, and not written to be read once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from crosstide import session
from crosstide.operators import ranking, rollup, xsection

SF = "/root/testdata/sf0.001"


@pytest.fixture
def cells(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"date": np.repeat(["a", "b"], 40), "symbol": np.tile(np.arange(40), 2), "ret_1d": rng.normal(size=80).round(1),
                        "sector": np.tile(["s", "t", "u", None], 20), "x": rng.normal(size=80) + 1e6})
    pdf.loc[pdf.sector == "t", "x"] = 0.1 + 0.2                       # a group without variation
    df = spark.createDataFrame(pdf.astype({"sector": object}).where(pdf.notna(), None))
    return df.withColumn("x", F.when(F.col("symbol") % 7 > 0, F.col("x"))).unionByName(
        spark.createDataFrame([("c", 1, 0.0, "s", 5.0)], "date string, symbol long, ret_1d double, sector string, x double"))


@pytest.mark.parametrize("limit", [0, 10 ** 6])
def test_scores_of_groups_equal_joined_moments(cells, monkeypatch, limit):
    monkeypatch.setattr(ranking, "GROUP_ROWS", limit)
    scopes = {"cs": ["date"], "sec": ["date", "sector"]}
    got = xsection.cross_sectional(cells, ["x"], scopes).toPandas().sort_values(["date", "symbol"]).reset_index(drop=True)
    known = got["x"].where(got.sector.notna())
    for prefix, x, keys in (("cs", got["x"], ["date"]), ("sec", known, ["date", "sector"])):
        by = x.groupby([got[k] for k in keys])
        want = ((x - by.transform("mean")) / by.transform("std").where(by.transform("max") > by.transform("min"))).astype(float)
        np.testing.assert_allclose(got[f"{prefix}_z_x"].astype(float), want, rtol=1e-6, equal_nan=True)


def test_small_sides_are_staged_before_the_join(spark, cells):
    """A join with an aggregate of the same rows would take its size for theirs, and shuffle both."""
    wide = session.stage(cells)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = [xsection.zscores(wide, ["date"], ["x"], "cs"), xsection.standardize_dates(wide, ["x"]),
                rollup.leave_one_out(wide, ["date", "sector"], ["x"], "p"),
                rollup.join_back(wide, wide.groupBy("date").agg(F.avg("x").alias("m")), ["date"])]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for plan in plans:
        assert "HashAggregate" not in plan


@pytest.mark.parametrize("name,most", [("early_stop_split", {"eval_target"}), ("rebalance_nodes", {"mom"}), ("cs_pct_rank", {"mom"}),
                                       ("cs_zscore", {"mom"}), ("group_neutral", {"mom"})])
def test_rows_read_once_are_not_written(spark, name, most):
    session.clear(spark)
    with session.noted() as paths:
        df = __spark_entry__.queries()[name](spark, SF)
        df.count()
    assert not [p for p in paths if most <= set(spark.read.parquet(p).columns)]


def test_ranks_shuffle_the_ranked_columns_only(spark):
    plan = __spark_entry__.queries()["cs_pct_rank"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    head = plan[:plan.index("FlatMapGroupsInArrow") + 4000].splitlines()[0]
    assert "mom#" not in head and "close#" not in head
