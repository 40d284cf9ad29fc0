import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide.operators import rolling, rollup
from crosstide.operators.profile import DAILY, WEEKLY
from crosstide.operators.roller import Roller
from crosstide.sources import tables


def frame_of(spark, n=90, symbols=2, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(symbols):
        for i in range(n):
            x = None if i % 11 == 4 else float(rng.normal())
            x = 2.5 if 40 <= i < 60 and s == 0 else x
            rows.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), x, float(rng.normal()) if i % 13 else None))
    return spark.createDataFrame(rows, "symbol int, date date, x double, y double")


@pytest.mark.parametrize("w", [3, 5, 12, 20, 31])
def test_roller_matches_pandas(spark, w):
    df = frame_of(spark)
    roll = Roller(df)
    out = roll.finish({
        "mean": roll.mean("x", w, 3), "std": roll.std("x", w, 3), "skew": roll.skewness("x", w, 3),
        "kurt": roll.kurtosis("x", w, 4), "max": roll.max("x", w, 3), "min": roll.min("x", w, 3),
        "cov": roll.cov("x", "y", w, 3), "corr": roll.corr("x", "y", w, 3)}).toPandas()
    out = out.sort_values(["symbol", "date"]).reset_index(drop=True)
    for _, g in out.groupby("symbol"):
        r = g["x"].rolling(w, min_periods=3)
        for name, want in {"mean": r.mean(), "std": r.std(), "max": r.max(), "min": r.min(),
                           "cov": g["x"].rolling(w, min_periods=3).cov(g["y"])}.items():
            np.testing.assert_allclose(g[name], want, atol=1e-9, equal_nan=True, err_msg=name)
        moving = r.std() > 1e-9
        np.testing.assert_allclose(g["skew"][moving], r.skew()[moving], atol=1e-7, equal_nan=True)
        if w < 4:
            continue
        enough = moving & (g["x"].rolling(w, min_periods=1).count() >= 4)
        np.testing.assert_allclose(g["kurt"][enough], g["x"].rolling(w, min_periods=4).kurt()[enough], atol=1e-6,
                                   equal_nan=True)
        both = g["x"].where(g["y"].notna()).rolling(w, min_periods=3)
        varied = (both.std() > 1e-9) & g["corr"].notna()
        np.testing.assert_allclose(g["corr"][varied], g["x"].rolling(w, min_periods=3).corr(g["y"])[varied], atol=1e-7)


def test_constant_window_has_zero_deviation_and_no_skew(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1 + i), 0.1) for i in range(12)], "symbol int, date date, x double")
    roll = Roller(df)
    rows = roll.finish({"s": roll.std("x", 7, 3), "k": roll.skewness("x", 7, 3)}).orderBy("date").collect()
    assert rows[-1]["s"] == 0.0 and rows[-1]["k"] is None


def test_moment_literals(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1 + i), v) for i, v in enumerate([1.0, 2.0, 4.0, 8.0])],
                               "symbol int, date date, x double")
    roll = Roller(df)
    last = roll.finish({"g1": roll.skewness("x", 4, 3), "g2": roll.kurtosis("x", 4, 4), "s": roll.std("x", 4, 2)}
                       ).orderBy(F.desc("date")).first()
    np.testing.assert_allclose([last["g1"], last["g2"], last["s"]], [1.1376244, .7576560, 3.0956959], atol=1e-6)


def test_pairwise_covariance_literal(spark):
    data = zip([None, 1.0, 2.0, 4.0], [5.0, 1.0, 3.0, 4.0])
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1 + i), x, y) for i, (x, y) in enumerate(data)],
                               "symbol int, date date, x double, y double")
    roll = Roller(df)
    got = [r["c"] for r in roll.finish({"c": roll.cov("x", "y", 4, 2)}).orderBy("date").collect()]
    assert got[:2] == [None, None]
    np.testing.assert_allclose(got[2:], [1.0, 2.1666667], atol=1e-6)


def test_ema_matches_pandas_across_gaps(spark):
    values = [10.0, 11.0, None, 13.0, 9.0, None, None, 12.0]
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1 + i), v) for i, v in enumerate(values)],
                               "symbol int, date date, close double")
    out = rolling.exponential_trend(df, [5], (12, 26, 9)).orderBy("date").toPandas()
    want = pd.Series(values).ewm(span=5, adjust=False).mean()
    np.testing.assert_allclose(out["ema_5d"], want, equal_nan=True)


def test_missing_returns_in_breadth_and_signed_parts(spark):
    df = spark.createDataFrame([("d", 1, None), ("d", 2, -1.0), ("d", 3, 2.0)], "date string, symbol int, ret_1d double")
    out = rollup.market_daily(df.withColumn("dollar_volume", F.lit(1.0))).first()
    assert out["market_breadth_1d"] == pytest.approx(1 / 3)
    down = [r[0] for r in df.orderBy("symbol").select(rolling.signed_part("ret_1d", -1)).collect()]
    assert down == [0.0, -1.0, 0.0]


def test_missing_rank_falls_in_the_top_bucket(spark):
    df = spark.createDataFrame([("d", 1, None, 1.0, 1.0), ("d", 2, 1.0, 2.0, 2.0)],
                               "date string, symbol int, a double, b double, c double")
    rows = rollup.style_buckets(df, ("a", "b", "c")).orderBy("symbol").collect()
    assert rows[0]["style_mom_bucket"] == 2


def test_padded_price_change(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1 + i), v) for i, v in enumerate([1.0, None, 2.0])],
                               "symbol int, date date, close double")
    df = df.withColumn("p", rolling.padded_price())
    got = [r["c"] for r in df.withColumn("c", rolling.change("p", 1)).orderBy("date").collect()]
    assert got == [None, 0.0, 1.0]


def test_leave_one_out_identity(spark):
    df = spark.createDataFrame([("d", "s", i, float(i * i)) for i in range(5)] + [("d", None, 9, 1.0)],
                               "date string, sector string, symbol int, x double")
    out = rollup.leave_one_out(df, ["date", "sector"], ["x"], "p").toPandas().set_index("symbol")
    known = out.loc[range(5)]
    np.testing.assert_allclose(known["p_mean_x"] * 4 + known["x"], 5 * known["x"].mean())
    assert np.isnan(out.loc[9, "p_mean_x"])


def test_no_feature_looks_ahead(spark):
    sf = "/root/testdata/sf0.001"
    bars = tables.weekly_bars(spark, sf).select("symbol", "date", "open", "high", "low", "close", "volume")
    cut = dt.date(1999, 6, 1)

    def build(df):
        df = rolling.price_momentum(df, WEEKLY)
        roll = Roller(df)
        df = roll.finish(rolling.return_vols(roll, (4, 12)) | rolling.channels(roll, (8,)) | rolling.rsi(roll, (12,)))
        return df.where(F.col("date") < F.lit(cut)).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(build(bars), build(bars.where(F.col("date") < F.lit(cut))))


def test_daily_profile_column_counts(spark):
    """Family sizes of the daily build, from the plans alone."""
    bars = spark.createDataFrame([], "symbol string, date date, open double, high double, low double, close double, volume double")
    prices = rolling.price_momentum(bars, DAILY)
    base = prices.select(*bars.columns, "ret_1d", "dollar_volume", "log_dollar_volume")
    assert len(prices.columns) - len(bars.columns) == 50
    assert len(rolling.volatility(base, DAILY).columns) - len(base.columns) == 69
    assert len(rolling.trend(base, DAILY).columns) - len(base.columns) == 56
    assert len(rolling.liquidity(base, DAILY).columns) - len(base.columns) == 41
    linked = base.withColumn("market_ret_1d", F.lit(0.0))
    assert len(rolling.market_linkage(linked, DAILY.betas).columns) - len(linked.columns) == 8
    assert len(DAILY.cross_inputs) * 6 == 168 and len(DAILY.targets) * 4 == 44 and len(DAILY.core_features) == 61
