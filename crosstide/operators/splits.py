"""Leakage-safe labels and temporal splits.

Split rules only ever look at the table of distinct dates (one row per calendar date and split),
so every window here is bounded by the calendar; panel rows are filtered through equi-joins on it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.functions.numeric import seeded
from crosstide.operators.rolling import lead


def as_date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def add_years(day: dt.date, years: int) -> dt.date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:                       # 29 February
        return day.replace(year=day.year + years, day=28)


# -- labels -------------------------------------------------------------------------------------

def attach_labels(df: DataFrame, target: str, ret: str, horizon: int, lag: int) -> DataFrame:
    """Execution-lagged target and return with the date the label ends; incomplete rows go."""
    if lag < 0:
        raise ValueError("the execution lag cannot be negative")
    labelled = df.withColumns({
        "eval_target": lead(target, lag) if lag else F.col(target),
        "eval_return": lead(ret, lag) if lag else F.col(ret),
        "label_end_date": lead("date", lag + horizon)})
    return labelled.dropna(subset=["eval_target", "eval_return", "label_end_date"])


# -- chronological split, purge, embargo --------------------------------------------------------

def assign_split(df: DataFrame, train_end, val_end) -> DataFrame:
    d = F.col("date")
    return df.withColumn("split", F.when(d <= as_date(train_end), "train")
                         .when(d <= as_date(val_end), "val").otherwise("test"))


def purge(df: DataFrame, train_end, val_end, data_end=None) -> DataFrame:
    """Keep rows whose label ends inside their split.

    The test split ends at ``data_end``, by default the last date of the (label-complete) panel.
    """
    if data_end is None:
        limit = df.agg(F.max("date")).scalar()
    else:
        limit = as_date(data_end)
    end = (F.when(F.col("split") == "train", as_date(train_end))
           .when(F.col("split") == "val", as_date(val_end)).otherwise(limit))
    return df.where(F.col("label_end_date") <= end)


def embargo(df: DataFrame, days: int, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Drop the first ``days`` distinct dates of each validation and test split.

    Runs on the purged rows. A split with no more than ``days`` dates ends empty.
    """
    if days <= 0:
        return df
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("date")
    places = df.where(F.col("split") != "train").select(*keys, "date").distinct().withColumn(
        "_place", F.row_number().over(order))
    starts = places.where(F.col("_place") == days + 1).select(*keys, F.col("date").alias("_start"))
    dated = df.join(starts, keys, "left")
    return dated.where((F.col("split") == "train") | (F.col("date") >= F.col("_start"))).drop("_start")


def purged_splits(df: DataFrame, train_end, val_end, embargo_days: int, data_end=None,
                  keys: tuple[str, ...] = ("split",)) -> DataFrame:
    return embargo(purge(assign_split(df, train_end, val_end), train_end, val_end, data_end),
                   embargo_days, keys)


def calendar_positions(df: DataFrame) -> DataFrame:
    """0-based position of every distinct date; one row per calendar date."""
    return df.select("date").distinct().withColumn(
        "_pos", F.row_number().over(Window.orderBy("date")) - 1)


def calendar_embargo(df: DataFrame, calendar: DataFrame, train_end, val_end, days: int) -> DataFrame:
    """Split and purge, with the embargo counted in trading-calendar positions.

    A row must lie more than ``days`` positions after the last calendar date at or before the
    boundary. This differs from ``embargo``, which counts the dates left in the split.
    """
    split = purge(assign_split(df, train_end, val_end), train_end, val_end)
    if days <= 0:
        return split
    positions = calendar_positions(calendar)
    edges = positions.agg(
        F.coalesce(F.max(F.when(F.col("date") <= as_date(train_end), F.col("_pos"))), F.lit(0)).alias("_t"),
        F.coalesce(F.max(F.when(F.col("date") <= as_date(val_end), F.col("_pos"))), F.lit(0)).alias("_v"))
    edges = edges.select(F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.lit(-1).alias("_from")),
        F.struct(F.lit("val").alias("split"), (F.col("_t") + days).alias("_from")),
        F.struct(F.lit("test").alias("split"), (F.col("_v") + days).alias("_from")))).alias("_e")).select("_e.*")
    placed = split.join(positions, ["date"], "left").join(edges, ["split"], "left")
    return placed.where(F.col("_pos") > F.col("_from")).drop("_pos", "_from")


def split_audit(raw: DataFrame, kept: DataFrame, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Rows before and after, dates, range and last label end per split."""
    keys = list(keys)
    before = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"))
    # dates are counted from the small per-date table
    per_date = kept.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n"),
                                               F.max("label_end_date").alias("_end"))
    after = per_date.groupBy(*keys).agg(
        F.sum("_n").alias("kept_rows"), F.count("date").alias("dates"), F.min("date").alias("date_min"),
        F.max("date").alias("date_max"), F.max("_end").alias("label_end_max"))
    out = before.join(after, keys, "left").fillna(0, ["kept_rows", "dates"])
    return out.withColumn("dropped_rows", F.col("raw_rows") - F.col("kept_rows"))


# -- row budgets that keep whole dates ----------------------------------------------------------

def date_counts(df: DataFrame) -> DataFrame:
    """``date, n``: the calendar-sized table that the choices below work on."""
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def budget_dates(dates: DataFrame, max_rows: int | None, seed: int | None = None) -> DataFrame:
    """Whole dates whose running row count stays within ``max_rows``, at least one.

    In calendar order, or in a seeded hash order when ``seed`` is given.
    """
    if max_rows is None:
        return dates
    order = [F.col("date")] if seed is None else [seeded(seed, F.col("date")), F.col("date")]
    w = Window.orderBy(*order)
    placed = dates.withColumns({"_cum": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                                "_place": F.row_number().over(w)})
    return placed.where((F.col("_cum") <= max_rows) | (F.col("_place") == 1)).drop("_cum", "_place")


def stride_dates(dates: DataFrame, stride: int, max_dates: int | None = None) -> DataFrame:
    """Every ``stride``-th distinct date, then the first ``max_dates`` of them."""
    places = dates.withColumn("_pos", F.row_number().over(Window.orderBy("date")) - 1)
    places = places.where(F.col("_pos") % stride == 0)
    if max_dates is not None:
        places = places.where(F.col("_pos") / stride < max_dates)
    return places.drop("_pos")


def shard_dates(dates: DataFrame, shards: int) -> DataFrame:
    """Add ``shard``: position of the date among the given dates, modulo the number of shards."""
    return dates.withColumn("shard", (F.row_number().over(Window.orderBy("date")) - 1) % shards)


def on_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the chosen dates, with any extra column of the date table."""
    return df.join(dates.drop("n"), ["date"])


def sample_symbols(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """First ``n`` symbols in sorted order, or in a seeded hash order."""
    order = [F.col("symbol")] if seed is None else [seeded(seed, F.col("symbol")), F.col("symbol")]
    chosen = df.select("symbol").distinct().orderBy(*order).limit(n)
    return df.join(chosen, "symbol", "left_semi")


# -- walk-forward folds -------------------------------------------------------------------------

def yearly_folds(first_train_end: str, holdout_start: str, val_years: int = 1,
                 step_years: int = 1) -> list[tuple[str, dt.date, dt.date]]:
    """Expanding folds ``(name, train_end, val_end)`` whose validation ends by the hold-out."""
    train_end, holdout = dt.date.fromisoformat(first_train_end), dt.date.fromisoformat(holdout_start)
    folds = []
    while add_years(train_end, val_years) <= holdout:
        folds.append((f"fold_{len(folds) + 1}", train_end, add_years(train_end, val_years)))
        train_end = add_years(train_end, step_years)
    return folds


def holdout_fold(holdout_start: str) -> tuple[str, dt.date, dt.date]:
    """Train through the day before the hold-out; everything after it is the test split."""
    last = dt.date.fromisoformat(holdout_start) - dt.timedelta(days=1)
    return "holdout", last, last


def expand_folds(df: DataFrame, folds: list[tuple[str, dt.date, dt.date]]) -> DataFrame:
    """One copy of each row per fold, with ``fold``, ``train_end`` and ``val_end``."""
    table = F.array(*[F.struct(F.lit(n).alias("fold"), as_date(t).alias("train_end"),
                               as_date(v).alias("val_end")) for n, t, v in folds])
    out = df.withColumn("_fold", F.explode(table))
    return out.select(*df.columns, "_fold.*")


def fold_splits(df: DataFrame, folds: list[tuple[str, dt.date, dt.date]], embargo_days: int) -> DataFrame:
    """Purged, embargoed rows of every fold at once, keyed by ``fold`` and ``split``."""
    expanded = expand_folds(df, folds)
    return purged_splits(expanded, F.col("train_end"), F.col("val_end"), embargo_days,
                         keys=("fold", "split"))


def out_of_fold_dates(df: DataFrame, first_train_end: str, train_end: str, step_years: int = 1) -> DataFrame:
    """Training dates to infer out of fold: ``fold, fold_train_end, infer_end, date``."""
    limit, end = dt.date.fromisoformat(train_end), dt.date.fromisoformat(first_train_end)
    steps = []
    while end < limit:
        nxt = add_years(end, step_years)
        steps.append((f"until_{end}", end, min(nxt, limit)))
        end = nxt
    dates = df.where(F.col("date") <= as_date(limit)).select("date").distinct()
    placed = expand_folds(dates, steps)
    inside = (F.col("date") > F.col("train_end")) & (F.col("date") <= F.col("val_end"))
    return placed.where(inside).select("fold", F.col("train_end").alias("fold_train_end"),
                                       F.col("val_end").alias("infer_end"), "date")


def early_stop_dates(df: DataFrame, years: int = 1) -> DataFrame:
    """Internal train/validation flags per training date: the last year validates.

    When that leaves a side empty, the last fifth of the dates validates; with fewer than four
    dates every date does both.
    """
    w = Window.orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dates = df.select("date").distinct().withColumns({
        "_pos": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole),
        "_cut": F.add_months(F.max("date").over(whole), -12 * years), "_first": F.min("date").over(whole)})
    one_sided = F.col("_first") > F.col("_cut")
    tail = F.greatest(F.lit(1), F.floor(F.col("_n") / 5))
    in_val = F.when(one_sided, F.col("_pos") > F.col("_n") - tail).otherwise(F.col("date") > F.col("_cut"))
    tiny = F.col("_n") < 4
    return dates.select("date", (tiny | ~in_val).alias("in_train"), (tiny | in_val).alias("in_val"))
