"""Cross-sectional evaluation and portfolios, for many runs at once.

Every function takes ``keys``: the columns that identify a run (score, split, regime, fold ...).
Scores that share their rows stand side by side as columns: the rows are shuffled once by date, and a task ranks and
correlates all scores of a date as Arrow columns. Dates with more than ``DAY_ROWS`` rows are unpivoted and ranked by
``ranking``, so one date may be arbitrarily large; series tables hold one row per run and calendar date.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crosstide.functions.numeric import TINY, pearson, ratio
from crosstide.operators.ranking import split_by_size, with_group_size, with_position, with_ranks
from crosstide.session import stage

PERIODS = 252.0
DAY_ROWS = 1_000_000        # a cross-section that one task holds as Arrow columns, 8 MB a column


def leg_size(n: Column | str, share: float) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.floor(n * F.lit(share)))


# -- one cross-section in a task -----------------------------------------------------------------

class _Day:
    """The columns of one date, its rows in the order of ``tie``."""

    def __init__(self, table: pa.Table, tie: str | None):
        self.table = table if tie is None else table.take(pc.sort_indices(table[tie]))
        self._values: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._orders: dict[str, np.ndarray] = {}

    def values(self, c: str) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where they are known."""
        if c not in self._values:
            column = self.table[c].combine_chunks()
            self._values[c] = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        return self._values[c]

    def known(self, *columns: str) -> np.ndarray:
        return reduce(np.logical_and, [self.table[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False) for c in columns])

    def order(self, c: str, rows: np.ndarray) -> np.ndarray:
        """The ``rows`` by ascending value, equal values by ``tie``."""
        if c not in self._orders:
            self._orders[c] = np.argsort(self.values(c)[0], kind="stable")
        return self._orders[c][rows[self._orders[c]]]

    def ranks(self, c: str, rows: np.ndarray) -> np.ndarray:
        """Average-tie ranks of the ``rows``."""
        order = self.order(c, rows)
        x = self.values(c)[0][order]
        first = np.append(True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))
        at = np.flatnonzero(first)
        out = np.empty(len(rows))
        out[order] = ((at + 1 + np.append(at[1:], len(x))) / 2)[np.cumsum(first) - 1]
        return out[rows]


def _correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    if a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def _fields(df: DataFrame, columns: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in columns], *[T.StructField(n, t) for n, t in more]])


def _runs_long(df: DataFrame, kept: list[str], runs: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """One row per row and run, the run's columns under ``names``."""
    each = F.array(*[F.struct(F.lit(i).alias("_run"), *[F.col(c).alias(n) for c, n in zip(run, names)]) for i, run in enumerate(runs)])
    return df.select(*kept, F.explode(each).alias("_e")).select(*kept, "_e.*")


def day_stats(df: DataFrame, keys: list[str], runs: list[tuple[str, str]], min_names: int, *, share: float | None = None,
              tie: str = "symbol") -> DataFrame:
    """Per group, date and ``_run`` (a place in ``runs``, pairs of a score and a target column): all ``rows``, complete pairs ``n``, and, if
    they are at least ``min_names``, ``rank_ic`` and ``ic``; with ``share`` also the target's mean over each leg of ``bucket_size`` names.
    """
    day = [*keys, "date"]
    used = list(dict.fromkeys([*day, *[c for run in runs for c in run], *([] if share is None else [tie])]))
    df = df.select(*used)
    figures = [("rank_ic", T.DoubleType()), ("ic", T.DoubleType()), ("top_mean", T.DoubleType()), ("bottom_mean", T.DoubleType())]
    counts = [("_run", T.IntegerType()), ("rows", T.LongType()), ("n", T.LongType()), ("bucket_size", T.LongType())]

    def stats(table: pa.Table) -> pa.Table:
        d, out = _Day(table, None if share is None else tie), []
        for i, (s, t) in enumerate(runs):
            (x, has), (y, also) = d.values(s), d.values(t)
            rows = has & also
            n, found, k = int(rows.sum()), [None] * 4, None
            if n and n >= min_names:
                found[:2] = _correlation(d.ranks(s, rows), d.ranks(t, rows)), _correlation(x[rows], y[rows])
                if share is not None:
                    k, placed = max(1, math.floor(n * share)), y[d.order(s, rows)]
                    found[2:] = float(placed[n - k:].mean()), float(placed[:k].mean())
            out.append([i, d.table.num_rows, n, k, *found])
        own = table.select(day).take(pa.array(np.zeros(len(out), np.int64)))
        for (name, kind), column in zip([*counts, *figures], zip(*out)):
            own = own.append_column(name, pa.array(column, pa.float64() if kind == T.DoubleType() else pa.int32() if name == "_run" else pa.int64()))
        return own

    small, large = split_by_size(df, day, DAY_ROWS)
    parts = [] if small is None else [small.groupBy(*day).applyInArrow(stats, _fields(df, day, *counts, *figures))]
    if large is not None:
        parts.append(_sorted_stats(large, day, runs, min_names, share, tie).select(*day, *[n for n, _ in [*counts, *figures]]))
    return reduce(DataFrame.unionByName, parts)


def _sorted_stats(df: DataFrame, day: list[str], runs: list[tuple[str, str]], min_names: int, share: float | None, tie: str) -> DataFrame:
    """``day_stats`` of dates that no task holds: pairs in long form, ranked over the cluster."""
    by = [*day, "_run"]
    long = _runs_long(df, [*day, *([] if share is None else [tie])], runs, ["_x", "_y"])
    pairs = long.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    enough = F.count(F.lit(1)) >= min_names
    out = long.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("n"))
    ranked = with_ranks(pairs, by, {"_rs": "_x", "_rt": "_y"}, pct=False)
    out = out.join(ranked.groupBy(*by).agg(F.when(enough, pearson("_rs", "_rt")).alias("rank_ic"), F.when(enough, pearson("_x", "_y")).alias("ic")), by, "left")
    if share is None:
        return out.withColumns({"bucket_size": F.lit(None).cast("long"), **{c: F.lit(None).cast("double") for c in ("top_mean", "bottom_mean")}})
    placed = _placed(pairs, by, "_x", share, tie).where(F.col("n") >= min_names)
    legs = placed.groupBy(*by).agg(F.avg(F.when(F.col("_place") > F.col("n") - F.col("k"), F.col("_y"))).alias("top_mean"),
                                   F.avg(F.when(F.col("_place") <= F.col("k"), F.col("_y"))).alias("bottom_mean"), F.max("k").alias("bucket_size"))
    return out.join(legs, by, "left")


# -- information coefficient --------------------------------------------------------------------

def rank_ic(df: DataFrame, keys: list[str], score: str, target: str, min_names: int) -> DataFrame:
    """Spearman and Pearson correlation of score and target per date."""
    out = day_stats(df, keys, [(score, target)], min_names)
    return out.where(F.col("n") >= max(1, min_names)).select(*keys, "date", "rank_ic", "ic", "n")


def rank_ics(df: DataFrame, keys: list[str], runs: list[tuple[str, str]], min_names: int) -> DataFrame:
    """``rank_ic`` of many score and target columns at once; ``_run`` is the place in ``runs``."""
    out = day_stats(df, keys, runs, min_names)
    return out.where(F.col("n") >= max(1, min_names)).select(*keys, "_run", "date", "rank_ic", "ic", "n")


def ic_summary(ic: DataFrame, keys: list[str], horizon: int | Column = 1) -> DataFrame:
    """Mean, deviation and information ratios; the adjusted ratio uses every ``horizon``-th date."""
    h = horizon if isinstance(horizon, Column) else F.lit(int(max(1, horizon)))
    w = Window.partitionBy(*keys).orderBy("date")
    for series in ("rank_ic", "ic"):
        place = F.sum(F.when(F.col(series).isNotNull(), 1).otherwise(0)).over(
            w.rowsBetween(Window.unboundedPreceding, 0))
        pick = F.col(series).isNotNull() & ((place - 1) % h == 0)
        ic = ic.withColumn(f"_no_{series}", F.when(pick, F.col(series)))
    ic = ic.withColumn("_h", h.cast("double"))

    def ir(values: str, periods: Column) -> Column:
        return F.avg(values) / (F.stddev_samp(values) + F.lit(TINY)) * F.sqrt(periods)

    adjusted = F.lit(PERIODS) / F.max("_h")
    return ic.groupBy(*keys).agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.avg("ic").alias("mean_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"), F.stddev_samp("ic").alias("ic_std"),
        ir("_no_rank_ic", adjusted).alias("rank_ic_ir"), ir("_no_ic", adjusted).alias("ic_ir"),
        ir("rank_ic", F.lit(PERIODS)).alias("rank_ic_ir_raw"), ir("ic", F.lit(PERIODS)).alias("ic_ir_raw"),
        F.count("rank_ic").alias("ic_dates"), F.count("_no_rank_ic").alias("ic_dates_nonoverlap"))


def simple_ic_summary(ic: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and yearly ratio with no correction for overlapping labels."""
    return ic.groupBy(*keys).agg(
        F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("rank_ic_std"),
        (F.avg("rank_ic") / (F.stddev_samp("rank_ic") + F.lit(TINY)) * math.sqrt(PERIODS)).alias("rank_ic_ir"),
        F.count("rank_ic").alias("dates"))


# -- decile spread ------------------------------------------------------------------------------

def _placed(df: DataFrame, group: list[str], score: str, share: float, tie: str) -> DataFrame:
    """Rows with ``n``, leg size ``k`` and ascending place ``_place`` of the score in the group."""
    sized = with_group_size(df, group, score, "n")
    placed = with_position(sized, group, score, tie, "_place")
    return placed.withColumn("k", leg_size("n", share))


def decile_spread(df: DataFrame, keys: list[str], score: str, target: str, share: float, min_names: int, *,
                  tie: str = "symbol") -> DataFrame:
    out = day_stats(df, keys, [(score, target)], min_names, share=share, tie=tie).where(F.col("n") >= max(1, min_names))
    return out.select(*keys, "date", "top_mean", "bottom_mean", _spread(), "n", "bucket_size")


def _spread() -> Column:
    return (F.col("top_mean") - F.col("bottom_mean")).alias("top_bottom_spread")


def spread_summary(spread: DataFrame, keys: list[str], periods: float) -> DataFrame:
    s = "top_bottom_spread"
    return spread.groupBy(*keys).agg(
        F.avg(s).alias("mean_top_bottom_spread"), F.stddev_samp(s).alias("spread_std"),
        (F.avg(s) / (F.stddev_samp(s) + F.lit(TINY)) * math.sqrt(periods)).alias("spread_ir"),
        F.count(s).alias("spread_dates"))


# -- portfolio weights --------------------------------------------------------------------------

def leg_rows(df: DataFrame, keys: list[str], scores: list[str], share: float, min_names: int, *, need: tuple[str, ...] = (),
             sector_neutral: bool = False, least: int = 0, tie: str = "symbol") -> DataFrame:
    """The rows of both legs of every score, with ``_run`` (its place in ``scores``) and ``weight``.

    Rows without the score or a column of ``need`` are out, and so are dates with fewer than ``least`` rows left.
    """
    day = [*keys, "date"]
    kept = [c for c in df.columns if c not in scores or c in day]
    smallest = max(10, int(min_names * share)) if sector_neutral else max(1, min_names)
    need = (*need, *(["sector"] if sector_neutral else []))

    def legs(table: pa.Table) -> pa.Table:
        d, taken, runs, weights = _Day(table, tie), [], [], []
        complete = d.known(*need) if need else np.ones(table.num_rows, bool)
        sectors = pc.dictionary_encode(d.table["sector"].combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False) if sector_neutral else None
        for i, s in enumerate(scores):
            rows = complete & d.known(s)
            if rows.sum() < max(1, least):
                continue
            order = d.order(s, rows)
            groups = [order] if sectors is None else [order[sectors[order] == g] for g in np.unique(sectors[order])]
            sized = [(g, max(1, math.floor(len(g) * share))) for g in groups if len(g) >= smallest]
            sized = [(g, k) for g, k in sized if sectors is None or len(g) >= 2 * k]
            for g, k in sized:
                w, each = np.zeros(len(g)), 0.5 / (1 if sectors is None else len(sized)) / k
                w[len(g) - k:] += each
                w[:k] -= each
                chosen = np.union1d(np.arange(k), np.arange(len(g) - k, len(g)))
                taken.append(g[chosen])
                weights.append(w[chosen])
                runs.append(np.full(len(chosen), i, np.int32))
        glue = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        own = d.table.select(kept).take(pa.array(glue(taken, np.int64)))
        return own.append_column("_run", pa.array(glue(runs, np.int32))).append_column("weight", pa.array(glue(weights, np.float64)))

    small, large = split_by_size(df, day, DAY_ROWS)
    parts = [] if small is None else [small.groupBy(*day).applyInArrow(legs, _fields(df, kept, ("_run", T.IntegerType()), ("weight", T.DoubleType())))]
    if large is not None:
        long = _runs_long(large, kept, [(s,) for s in scores], ["_x"]).dropna(subset=["_x", *need])
        by = [*keys, "_run"]
        if least > 1:
            long = with_group_size(long, [*by, "date"], "_x", "_names").where(F.col("_names") >= least).drop("_names")
        if sector_neutral:
            usable = _placed(long, [*by, "date", "sector"], "_x", share, tie)
            usable = usable.where((F.col("n") >= smallest) & (F.col("n") >= 2 * F.col("k")))
            sectors = usable.select(*by, "date", "sector").distinct().groupBy(*by, "date").agg(F.count("sector").alias("_sectors"))
            out = _legs(usable.join(sectors, [*by, "date"]), F.col("_sectors"))
        else:
            out = _legs(_placed(long, [*by, "date"], "_x", share, tie).where(F.col("n") >= min_names), F.lit(1))
        parts.append(out.select(*kept, "_run", "weight"))
    return reduce(DataFrame.unionByName, parts)


def _weights(df: DataFrame, keys: list[str], score: str, **how) -> DataFrame:
    columns = [c for c in df.columns if c != "weight"]
    return leg_rows(df.withColumn("_score", F.col(score)), keys, ["_score"], **how).select(*columns, "weight")


def long_short_weights(df: DataFrame, keys: list[str], score: str, share: float, min_names: int, *,
                       tie: str = "symbol") -> DataFrame:
    """+0.5 spread over the top ``share`` of names and -0.5 over the bottom; both legs net."""
    return _weights(df, keys, score, share=share, min_names=min_names, tie=tie)


def sector_neutral_weights(df: DataFrame, keys: list[str], score: str, share: float, min_names: int, *,
                           tie: str = "symbol") -> DataFrame:
    """Long-short inside every usable sector, each sector with an equal part of the book."""
    return _weights(df, keys, score, share=share, min_names=min_names, sector_neutral=True, tie=tie)


def _legs(placed: DataFrame, parts: Column) -> DataFrame:
    is_long, is_short = F.col("_place") > F.col("n") - F.col("k"), F.col("_place") <= F.col("k")
    each = F.lit(0.5) / parts / F.col("k")
    weight = F.when(is_long, each).otherwise(0.0) - F.when(is_short, each).otherwise(0.0)
    return placed.where(is_long | is_short).withColumn("weight", weight).drop("_place", "n", "k")


# -- backtest -----------------------------------------------------------------------------------

def rebalance_rows(df: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Rows on every ``every``-th distinct date of the run."""
    w = Window.partitionBy(*keys).orderBy("date")
    dates = df.select(*keys, "date").distinct().withColumn("_rn", F.row_number().over(w))
    chosen = dates.where((F.col("_rn") - 1) % every == 0).select(*keys, "date")
    return df.join(chosen, keys + ["date"], "left_semi")


def held_periods(weights: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Return, turnover, positions and exposures per held period.

    Turnover is half the absolute weight change against the previous period, from zero at first.
    Each weight enters its own period with its sign and the next one with the opposite sign, so a
    sum per (period, symbol) is the trade: no outer join, and no loop over periods.
    """
    dates = weights.select(*keys, "date").distinct().withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))
    placed = weights.join(dates, keys + ["date"])
    own = F.struct(F.col("_r").alias("r"), F.col("weight").alias("d"), F.col("weight").alias("w"),
                   (F.col("weight") * F.col(ret)).alias("pl"), F.col("date").alias("date"))
    leave = F.struct((F.col("_r") + 1).alias("r"), (-F.col("weight")).alias("d"), F.lit(0.0).alias("w"),
                     F.lit(0.0).alias("pl"), F.lit(None).cast("date").alias("date"))
    moves = placed.select(*keys, "symbol", F.explode(F.array(own, leave)).alias("m")).select(*keys, "symbol", "m.*")
    traded = moves.groupBy(*keys, "r", "symbol").agg(
        F.sum("d").alias("d"), F.sum("w").alias("w"), F.sum("pl").alias("pl"), F.max("date").alias("date"))
    out = traded.groupBy(*keys, "r").agg(
        F.max("date").alias("date"), F.sum("pl").alias("gross_return"), (F.sum(F.abs("d")) / 2).alias("turnover"),
        F.sum(F.when(F.col("w") != 0, 1).otherwise(0)).alias("n_positions"),
        F.sum(F.abs("w")).alias("gross_exposure"), F.sum("w").alias("net_exposure"))
    return out.where(F.col("date").isNotNull()).drop("r")


def backtest(df: DataFrame, keys: list[str], score: str, ret: str, *, share: float, every: int,
             cost_bps: float, min_names: int, sector_neutral: bool = False, tie: str = "symbol") -> DataFrame:
    """Per rebalance date: returns, turnover, cost, positions, exposures and equity curves.

    A date with too few complete names is skipped and leaves the held weights as they were.
    """
    return backtests(df, keys, [score], ret, share=share, every=every, cost_bps=cost_bps, min_names=min_names, sector_neutral=sector_neutral,
                     tie=tie).drop("_run")


def backtests(df: DataFrame, keys: list[str], scores: list[str], ret: str, *, share: float, every: int,
              cost_bps: float, min_names: int, sector_neutral: bool = False, tie: str = "symbol") -> DataFrame:
    """``backtest`` of many score columns over one calendar; ``_run`` is the place in ``scores``."""
    columns = {f"_s{i}": F.col(c) for i, c in enumerate(scores)}
    rows = rebalance_rows(df, keys, every).select(*keys, "date", "symbol", "sector", ret, *[c.alias(n) for n, c in columns.items()])
    weights = leg_rows(rows, keys, list(columns), share, min_names, need=("symbol", "sector", ret), sector_neutral=sector_neutral,
                       least=min_names, tie=tie)
    keys = [*keys, "_run"]
    out = held_periods(stage(weights.select(*keys, "date", "symbol", "weight", ret)), keys, ret)
    out = out.withColumn("cost", F.col("turnover") * F.lit(cost_bps / 10000.0))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    running = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({
        "equity_gross": F.product(1 + F.col("gross_return")).over(running),
        "equity_net": F.product(1 + F.col("net_return")).over(running)})


def backtest_summary(bt: DataFrame, keys: list[str], periods: float) -> DataFrame:
    running = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    bt = bt.withColumn("_dd", F.col("equity_net") / F.max("equity_net").over(running) - 1)
    r = "net_return"
    ann, vol = F.avg(r) * periods, F.stddev_samp(r) * math.sqrt(periods)
    return bt.groupBy(*keys).agg(
        F.count(r).alias("periods"), F.avg(r).alias("mean_period_return_net"), ann.alias("ann_return_net"),
        vol.alias("ann_vol_net"), (ann / (vol + F.lit(TINY))).alias("sharpe_net"),
        F.min("_dd").alias("max_drawdown_net"), F.avg("turnover").alias("avg_turnover"),
        F.avg("cost").alias("avg_cost"), F.max_by("equity_net", "date").alias("final_equity_net"))


def suspect(sharpe: Column | str = "sharpe_net", icir: Column | str = "rank_ic_ir") -> Column:
    """Too good to be true: overlap or leakage is likely."""
    sharpe = F.col(sharpe) if isinstance(sharpe, str) else sharpe
    icir = F.col(icir) if isinstance(icir, str) else icir
    return F.coalesce(sharpe > 3.0, F.lit(False)) | F.coalesce(icir > 5.0, F.lit(False))


def score_metrics(df: DataFrame, keys: list[str], score: str, target: str, ret: str, *, horizon: int,
                  share: float, every: int, cost_bps: float, min_names: int,
                  sector_neutral: bool = False) -> DataFrame:
    """The full metric record per run: IC, spread, backtest, counts and the suspect flag."""
    days = stage(day_stats(df, keys, [(score, target)], min_names, share=share))
    return run_metrics(df, days, keys, [(score, target)], ret, horizon=horizon, share=share, every=every, cost_bps=cost_bps,
                       min_names=min_names, sector_neutral=sector_neutral).drop("_run")


def run_metrics(df: DataFrame, days: DataFrame, keys: list[str], runs: list[tuple[str, str]], ret: str, *, horizon: int,
                share: float, every: int, cost_bps: float, min_names: int, sector_neutral: bool = False) -> DataFrame:
    """``score_metrics`` of many score and target columns; ``days`` are their staged ``day_stats``, ``_run`` the place in ``runs``.

    Legs depend on the score alone: runs that share it share its backtest.
    """
    periods, by = PERIODS / every, [*keys, "_run"]
    enough = days.where(F.col("n") >= max(1, min_names))
    counts = days.groupBy(*by).agg(F.sum("rows").alias("rows"), F.count("date").alias("dates"))
    ic = ic_summary(enough, by, horizon)
    spread = spread_summary(enough.select(*by, _spread()), by, periods)
    scores = list(dict.fromkeys(s for s, _ in runs))
    bt = backtest_summary(backtests(df, keys, scores, ret, share=share, every=every, cost_bps=cost_bps, min_names=min_names,
                                    sector_neutral=sector_neutral), by, periods)
    using = F.array(*[F.array(*[F.lit(i) for i, (own, _) in enumerate(runs) if own == s]) for s in scores])
    bt = bt.withColumn("_run", F.explode(using[F.col("_run")]))
    out = counts.join(ic, by, "left").join(spread, by, "left").join(bt, by, "left")
    return out.withColumn("suspect_overfit_or_leak", suspect())


def in_regimes(df: DataFrame, regimes: dict[str, tuple[str, str]]) -> DataFrame:
    """One copy of a row per regime whose dates contain it, tagged ``regime``."""
    table = F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(a).cast("date").alias("_from"),
                               F.lit(b).cast("date").alias("_to")) for n, (a, b) in regimes.items()])
    tagged = df.withColumn("_g", F.explode(F.filter(
        table, lambda g: (F.col("date") >= g["_from"]) & (F.col("date") <= g["_to"]))))
    return tagged.withColumn("regime", F.col("_g.regime")).drop("_g")


# Default regime periods.
REGIMES = {
    "gfc_2008": ("2008-01-01", "2009-12-31"),
    "covid_2020": ("2020-01-01", "2020-12-31"),
    "inflation_2022": ("2022-01-01", "2022-12-31"),
}


def long_scores(df: DataFrame, scores: list[str], ids: list[str]) -> DataFrame:
    """Score columns unpivoted to ``score, x`` rows."""
    return df.unpivot(ids, scores, "score", "x")
