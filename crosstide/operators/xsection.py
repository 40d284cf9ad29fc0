"""Cross-sectional transforms: per-date and per-date-group z-scores, ranks, clipping, scaling."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from crosstide.functions.numeric import clip, ratio
from crosstide.functions.scalars import with_one_row
from crosstide.operators import ranking
from crosstide.operators.ranking import average_rank, order_code, quantile_table, rank_parts, split_by_size, with_group_size, with_position, with_ranks
from crosstide.session import stage

# Scope name -> keys, in the order the features are named.
SCOPES = {"cs": ["date"], "sector": ["date", "sector"], "subind": ["date", "sub_industry"]}
WIDE = 300                  # columns that ``GROUP_ROWS`` rows of a date may have in one task, outputs included: 600 MB


def zscores(df: DataFrame, keys: list[str], columns: Iterable[str], prefix: str, source: DataFrame | None = None) -> DataFrame:
    """``{prefix}_z_{c}``: moments per group from one map-side-combined aggregate, joined back.

    The moments come from ``source`` where it is given: the same rows before costly columns were added to them. They are staged, so
    that the join knows their size before it would shuffle and sort the rows.
    """
    columns = list(columns)
    moments = stage((df if source is None else source).groupBy(*keys).agg(*[e for c in columns for e in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]))
    out = df.join(moments, keys, "left")
    out = out.withColumns({f"{prefix}_z_{c}": ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}") for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("m", "s")])


def _average_ranks(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average-tie rank of each value in its group as a share of the group's values; NaN where either is missing."""
    out = np.full(len(x), np.nan)
    rows = np.flatnonzero((group >= 0) & ~np.isnan(x))
    if not len(rows):
        return out
    order = rows[np.lexsort((x[rows], group[rows]))]
    g, v = group[order], x[order]
    place = np.arange(len(order))
    starts_group = np.append(True, g[1:] != g[:-1])
    starts_run = starts_group | np.append(True, v[1:] != v[:-1])
    group_at, run_at = np.flatnonzero(starts_group), np.flatnonzero(starts_run)
    first = run_at[np.cumsum(starts_run) - 1]
    last = np.append(run_at[1:], len(order))[np.cumsum(starts_run) - 1] - 1
    of_group = np.cumsum(starts_group) - 1
    members = np.diff(np.append(group_at, len(place)))
    out[order] = ((first + last) / 2 - group_at[of_group] + 1) / members[of_group]
    return out


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number per combination of the keys; -1 where one is null."""
    code = np.zeros(table.num_rows, np.int64)
    for k in keys:
        own = pc.dictionary_encode(table[k].combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where((own < 0) | (code < 0), -1, code * (own.max(initial=0) + 1) + own)
        code = np.unique(code, return_inverse=True)[1] - (code.min(initial=0) < 0)
    return code


def _group_zscores(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Distance to the group's mean in sample deviations; NaN where either is missing or the group does not vary."""
    out = np.full(len(x), np.nan)
    rows = np.flatnonzero((group >= 0) & ~np.isnan(x))
    if not len(rows):
        return out
    g, v = group[rows], x[rows]
    some = np.zeros(g.max() + 1)
    some[g] = v
    v = v - some[g]                         # less a value of the group: a constant group is 0 throughout
    n = np.bincount(g)
    v -= (np.bincount(g, v) / np.maximum(n, 1))[g]
    deviation = np.sqrt(np.bincount(g, v * v) / np.maximum(n - 1, 1))
    deviation[deviation == 0] = np.nan
    out[rows] = v / deviation[g]
    return out


def scope_ranks(df: DataFrame, scopes: dict[str, list[str]], columns: Iterable[str], *, scores: bool = False,
                dates: DataFrame | None = None) -> DataFrame:
    """``{prefix}_rank_{c}`` for every scope (prefix -> keys, ``date`` among them) and column, with ``scores`` also ``{prefix}_z_{c}``.

    All scopes share one shuffle by date, and a task ranks the columns of a date together. The rows of dates with
    more rows than a task holds (``GROUP_ROWS`` at ``WIDE`` columns) are unpivoted, range-sorted once for all scopes and columns, and pivoted back. The rows of
    a date are counted in ``dates`` where it is given: a table with the same dates that is read at less cost.
    """
    columns = list(columns)
    kinds = {"rank": _average_ranks} | ({"z": _group_zscores} if scores else {})
    names = [f"{prefix}_{kind}_{c}" for prefix in scopes for c in columns for kind in kinds]
    # narrow rows: more of them make the same megabytes
    most = ranking.GROUP_ROWS * max(1.0, WIDE / (len(df.columns) + len(names)))
    small, large = split_by_size(df, ["date"], most, dates)
    parts = []
    if small is not None:
        def ranked(table: pa.Table) -> pa.Table:
            for prefix, keys in scopes.items():
                group = _groups(table, keys)
                for c in columns:
                    x = pc.fill_null(table[c].cast(pa.float64()), float("nan")).to_numpy()
                    for kind, of in kinds.items():
                        table = table.append_column(f"{prefix}_{kind}_{c}", pa.array(of(x, group), from_pandas=True))
            return table
        schema = T.StructType([*small.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
        parts.append(small.groupBy("date").applyInArrow(ranked, schema))
    if large is not None:
        large = large if dates is None else stage(large)        # read several times
        out = _sorted_scope_ranks(large, scopes, columns)
        for prefix, keys in scopes.items() if scores else ():
            out = zscores(out, keys, columns, prefix, large)
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def _sorted_scope_ranks(df: DataFrame, scopes: dict[str, list[str]], columns: list[str]) -> DataFrame:
    slots = []
    for prefix, keys in scopes.items():
        group = F.concat_ws("\0", *[F.col(k).cast("string") for k in keys if k != "date"])
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        slots += [(f"{prefix}_rank_{c}", F.when(known, group), c) for c in columns]
    long = df.select("date", "symbol", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_slot"), group.alias("_group"), F.col(c).cast("double").alias("_x")) for i, (_, group, c) in enumerate(slots)])).alias("_e"))
    long = long.select("date", "symbol", "_e._slot", "_e._group", order_code(F.col("_e._x")).alias("_x")).where(
        F.col("_x").isNotNull() & F.col("_group").isNotNull())
    ranked = rank_parts(long, ["date", "_slot", "_group"], "_x", "_r").withColumn("_q", average_rank("_r"))
    # the order begins with the date: most of a row's ranks stand in one part, where the pivot combines them before its shuffle
    wide = ranked.groupBy("date", "symbol").agg(*[F.max(F.when(F.col("_slot") == i, F.col("_q"))).alias(out) for i, (out, _, _) in enumerate(slots)])
    return df.join(wide, ["date", "symbol"], "left")


def pct_ranks(df: DataFrame, keys: list[str], columns: Iterable[str], prefix: str, dates: DataFrame | None = None) -> DataFrame:
    """``{prefix}_rank_{c}`` within ``keys``."""
    return scope_ranks(df, {prefix: keys}, columns, dates=dates)


def cross_sectional(df: DataFrame, columns: Iterable[str], scopes: dict[str, list[str]] | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Ranks and z-scores of every scope, from one shuffle by date."""
    columns = [c for c in columns if c in df.columns]
    return scope_ranks(df, SCOPES if scopes is None else scopes, columns, scores=True, dates=dates)


def relative_targets(df: DataFrame, horizons: Iterable[int]) -> DataFrame:
    """Market-excess, ranked and sector-excess labels from ``target_ret_fwd_{h}d``."""
    horizons = list(horizons)
    raw = [f"target_ret_fwd_{h}d" for h in horizons]
    market = stage(df.groupBy("date").agg(*[F.avg(c).alias(f"_m_{c}") for c in raw]))
    sector = stage(df.where(F.col("sector").isNotNull()).groupBy("date", "sector").agg(
        *[F.avg(c).alias(f"_g_{c}") for c in raw]))
    ranked = with_ranks(df, ["date"], {f"target_rank_fwd_{h}d": c for h, c in zip(horizons, raw)})
    out = ranked.join(market, ["date"], "left").join(sector, ["date", "sector"], "left")
    columns = {}
    for h, c in zip(horizons, raw):
        columns[f"target_excess_market_fwd_{h}d"] = F.col(c) - F.col(f"_m_{c}")
        columns[f"target_excess_sector_fwd_{h}d"] = F.col(c) - F.col(f"_g_{c}")
    return out.withColumns(columns).drop(*[f"_{k}_{c}" for c in raw for k in ("m", "g")])


def liquidity_universe(df: DataFrame, liquidity: str, drop_share: float, *, tie: str = "symbol") -> DataFrame:
    """Drop the least liquid share of each date; ties by ``tie``, missing liquidity is dropped."""
    if drop_share <= 0:
        return df
    # the last row that goes, per date, from the two columns that order the rows; the others are not shuffled
    narrow = df.select("date", *dict.fromkeys([liquidity, tie])).where(F.col(liquidity).isNotNull())
    placed = with_position(with_group_size(narrow, ["date"], liquidity, "_n"), ["date"], liquidity, tie, "_place")
    place = lambda: F.struct(F.col(liquidity).alias("x"), F.col(tie).alias("tie"))
    cuts = stage(placed.where(F.col("_place") / F.col("_n") <= drop_share).groupBy("date").agg(F.max(place()).alias("_cut")))
    out = df.where(F.col("date").isNotNull() & F.col(liquidity).isNotNull()).join(cuts, ["date"], "left")
    return out.where(F.col("_cut").isNull() | (place() > F.col("_cut"))).drop("_cut").select(*df.columns)


def winsorize(df: DataFrame, columns: Iterable[str], share: float, keys: list[str] | None = None) -> DataFrame:
    """Clip each column to its per-date ``[share, 1 - share]`` quantiles; NULL stays NULL."""
    keys = ["date"] if keys is None else keys
    columns = list(columns)
    bounds = stage(quantile_table(df, keys, columns, [share, 1.0 - share]))
    out = df.join(bounds, keys, "left")
    clipped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"{c}_q0")), F.col(f"{c}_q1")))
               for c in columns}
    return out.withColumns(clipped).drop(*[f"{c}_q{i}" for c in columns for i in (0, 1)])


def standardize_dates(df: DataFrame, columns: Iterable[str], reach: float = 6.0) -> DataFrame:
    """Per-date standardised copy of ``columns``: mean-imputed, population deviation, clipped.

    A missing value becomes the mean, so it ends at 0; a (near) constant column is only centred.
    """
    columns = list(columns)
    moments = stage(df.groupBy("date").agg(*[e for c in columns for e in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]))
    out = df.join(moments, ["date"], "left")
    fixed = {}
    for c in columns:
        mean = F.coalesce(F.col(f"_m_{c}"), F.lit(0.0))
        scale = F.when(F.col(f"_s_{c}") > 1e-8, F.col(f"_s_{c}")).otherwise(1.0)
        fixed[c] = clip((F.coalesce(F.col(c), mean) - mean) / scale, -reach, reach)
    return out.withColumns(fixed).drop(*[f"_{k}_{c}" for c in columns for k in ("m", "s")])


def scaler_table(train: DataFrame, columns: Iterable[str], keys: list[str]) -> DataFrame:
    """Median, then mean and population deviation after imputing it: one row per ``keys``, or one in all."""
    columns = list(columns)
    medians = quantile_table(train, keys, columns, [0.5])
    rows = train.select(*keys, *columns)
    filled = rows.join(medians, keys, "left") if keys else with_one_row(rows, medians)
    value = {c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_q0"), F.lit(0.0)) for c in columns}
    stats = filled.groupBy(*keys).agg(*[e for c in columns for e in (
        F.max(F.coalesce(F.col(f"{c}_q0"), F.lit(0.0))).alias(f"_med_{c}"),
        F.avg(value[c]).alias(f"_mean_{c}"), F.stddev_pop(value[c]).alias(f"_std_{c}"))])
    return stats


def apply_scaler(df: DataFrame, stats: DataFrame, columns: Iterable[str], keys: list[str]) -> DataFrame:
    """Impute and scale with train-fitted statistics; an unusable deviation counts as 1."""
    columns = list(columns)
    out = df.join(stats, keys, "left") if keys else with_one_row(df, stats)
    scaled = {}
    for c in columns:
        dev = F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(1.0)
        filled = F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"))
        scaled[c] = F.coalesce((filled - F.col(f"_mean_{c}")) / dev, F.lit(0.0))
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in ("med", "mean", "std")])


def rank_blend(members: DataFrame, score: str, weight: str | None, *, run: str = "run",
               ids: tuple[str, ...] = ("date", "symbol"), groups: tuple[str, ...] = ()) -> DataFrame:
    """Average of per-date pct ranks over the members of a long prediction table.

    Only keys scored by every member of the group stay, which replaces a chain of joins. Weights
    fall back to equal when they do not sum to a positive number.
    """
    groups, ids = list(groups), list(ids)
    sizes = members.groupBy(*groups).agg(F.countDistinct(run).alias("_k")) if groups else None
    have = members.groupBy(*groups, *ids).agg(F.countDistinct(run).alias("_have"))
    if sizes is not None:
        complete = have.join(sizes, groups).where(F.col("_have") == F.col("_k"))
    else:
        complete = have.where(F.col("_have") == members.agg(F.countDistinct(run)).scalar())
    kept = members.join(complete.select(*groups, *ids), groups + ids, "left_semi")
    ranked = with_ranks(kept, groups + [run, "date"], {"_q": score})
    w = F.col(weight) if weight else F.lit(1.0)
    # rounded, so that the order of summation cannot split equal blends
    blended = ranked.groupBy(*groups, *ids).agg(
        F.round(F.avg("_q"), 12).alias("rank_equal"), F.sum(w * F.col("_q")).alias("_wq"), F.sum(w).alias("_w"))
    return blended.withColumn("rank_weighted", F.when(F.col("_w") > 0, F.round(F.col("_wq") / F.col("_w"), 12))
                              .otherwise(F.col("rank_equal"))).drop("_wq", "_w")


def row_blend(members: list[tuple[str, float]]) -> tuple[Column, Column]:
    """(equal, weighted) average of rank columns, ``(column, weight)``, within a row, as ``rank_blend`` has it where every
    member scores every row; ranks that are NULL are left out of the equal one.
    """
    known = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c, _ in members])
    weights = sum(w for _, w in members)
    equal = F.round(F.try_divide(reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) for c, _ in members]), known), 12)
    if weights <= 0:
        return equal, equal
    weighted = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in members])
    return equal, F.when(known > 0, F.round(weighted / F.lit(weights), 12))
