"""Data-quality and return diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from crosstide.functions.numeric import pearson
from crosstide.functions.scalars import with_one_row
from crosstide.operators.rolling import lag, rolled
from crosstide.session import stage
from crosstide.sources.tables import inverted, non_positive

CORE = ["date", "symbol", "open", "high", "low", "close", "volume"]


def quality_report(df: DataFrame) -> DataFrame:
    """One row: sizes, range, duplicates, missing per column, impossible bars.

    Rows collapse to one per (symbol, date) first; distinct symbols and duplicates follow from it.
    """
    flags = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}") for c in CORE]
    flags += [F.sum(non_positive("close").cast("long")).alias("non_positive_close_rows"),
              F.sum(non_positive("volume").cast("long")).alias("non_positive_volume_rows"),
              F.sum(inverted().cast("long")).alias("ohlc_inversion_rows")]
    keyed = df.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"), *flags)
    per_symbol = keyed.groupBy("symbol").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("rows") - 1).alias("dup"),
        F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        *[F.sum(n).alias(n) for n in [f"missing_{c}" for c in CORE]
          + ["non_positive_close_rows", "non_positive_volume_rows", "ohlc_inversion_rows"]])
    return per_symbol.agg(
        F.sum("rows").alias("rows"), F.count("symbol").alias("symbols"),
        F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"),
        F.sum("dup").alias("duplicate_symbol_dates"),
        *[F.sum(n).alias(n) for n in [f"missing_{c}" for c in CORE]
          + ["non_positive_close_rows", "non_positive_volume_rows", "ohlc_inversion_rows"]])


def large_moves(df: DataFrame, ret: str = "ret_1d", warn: float = 0.5, error: float = 3.0) -> DataFrame:
    size = F.abs(F.col(ret))
    return df.agg(F.count_if(size > warn).alias("moves_warn"), F.count_if(size > error).alias("moves_error"),
                  F.count(ret).alias("returns"))


def with_diagnostic_returns(df: DataFrame) -> DataFrame:
    simple = F.try_divide(F.col("close"), lag("close", 1)) - 1
    return df.withColumns({"simple_ret": simple, "log_ret": F.log("close") - F.log(lag("close", 1)),
                           "close_lag1": lag("close", 1)})


def return_distribution(df: DataFrame) -> DataFrame:
    """One row per return kind, plus the mean absolute gap between the kinds."""
    gap = df.agg(F.avg(F.abs(F.col("simple_ret") - F.col("log_ret"))).alias("simple_minus_log_abs_mean"))
    long = df.select("simple_ret", "log_ret").unpivot([], ["simple_ret", "log_ret"], "kind", "r")
    stats = long.groupBy("kind").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"),
                                     F.min("r").alias("min"), F.max("r").alias("max"), F.count("r").alias("n"))
    return with_one_row(stats, gap)


def symbol_autocorrelation(df: DataFrame, ret: str, min_obs: int) -> DataFrame:
    """Lag-1 autocorrelation of returns and lag-1, lag-5 of their size, per symbol."""
    r = df.where(F.col(ret).isNotNull()).select("symbol", "date", F.col(ret).alias("r"),
                                                F.abs(F.col(ret)).alias("a"))
    r = r.withColumns({"r1": lag("r", 1), "a1": lag("a", 1), "a5": lag("a", 5)})

    def corr(x: str, y: str):
        return pearson(F.when(F.col(y).isNotNull(), F.col(x)), F.col(y))

    return r.groupBy("symbol").agg(
        corr("r", "r1").alias("ret_autocorr_lag1"), corr("a", "a1").alias("abs_ret_autocorr_lag1"),
        corr("a", "a5").alias("abs_ret_autocorr_lag5"), F.count("r").alias("n")).where(F.col("n") >= min_obs)


def autocorrelation_overview(per_symbol: DataFrame) -> DataFrame:
    c1, a1, a5 = "ret_autocorr_lag1", "abs_ret_autocorr_lag1", "abs_ret_autocorr_lag5"
    from crosstide.operators.ranking import quantile_table
    per_symbol = stage(per_symbol)
    medians = quantile_table(per_symbol, [], [c1, a1], [0.5])
    means = per_symbol.agg(F.count("symbol").alias("symbols"), F.avg(c1).alias(f"mean_{c1}"),
                           F.avg(a1).alias(f"mean_{a1}"), F.avg(a5).alias(f"mean_{a5}"))
    return with_one_row(means, medians.select(F.col(f"{c1}_q0").alias(f"median_{c1}"),
                                              F.col(f"{a1}_q0").alias(f"median_{a1}")))


def market_series(df: DataFrame, ret: str = "log_ret", window: int = 20) -> DataFrame:
    """Mean return per date, its size and the annualised realised volatility."""
    daily = df.groupBy("date").agg(F.avg(ret).alias("market_log_ret"))
    frame = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    vol = rolled(F.stddev_samp, "market_log_ret", window, window, frame) * math.sqrt(252)
    return daily.withColumns({"market_abs_ret": F.abs("market_log_ret"), "market_realized_vol": vol})


def market_autocorrelation(series: DataFrame, lags: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Autocorrelation of market return size and realised volatility: ``series, lag, autocorr, n``."""
    long = series.unpivot(["date"], ["market_abs_ret", "market_realized_vol"], "series", "x")
    long = long.where(F.col("x").isNotNull())
    w = Window.partitionBy("series").orderBy("date")
    shifted = long.withColumn("_s", F.explode(F.array(*[F.lit(k) for k in lags]))).select(
        "series", "date", "x", F.col("_s").alias("lag"))
    w = Window.partitionBy("series", "lag").orderBy("date")
    for k in lags:
        shifted = shifted.withColumn(f"_y{k}", F.lag("x", k).over(w))
    y = F.coalesce(*[F.when(F.col("lag") == k, F.col(f"_y{k}")) for k in lags])
    pairs = shifted.withColumn("y", y).where(F.col("y").isNotNull())
    return pairs.groupBy("series", "lag").agg(pearson("x", "y").alias("autocorr"), F.count("x").alias("n"))
