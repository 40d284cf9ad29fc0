"""Group roll-ups: aggregate per date or (date, group), roll over time, join back to the panel.

The aggregates combine on the map side, so a date or sector with a large share of the rows costs
one partial row per task. The rolled tables hold one row per calendar date and group; joins back
carry no hint and become broadcasts only when Spark measures the table as small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.functions.numeric import clip, ratio, share_where
from crosstide.operators.profile import Profile
from crosstide.operators.ranking import with_ranks
from crosstide.operators.rolling import half, mean, rolled, std, zscore
from crosstide.session import stage


def compounded(ret: str, w: int, window) -> Column:
    growth = F.log1p(clip(ret, low=-0.999))
    return F.expm1(rolled(F.sum, growth, w, half(w), window))


def _frames(keys: list[str]):
    ordered = Window.partitionBy(*keys).orderBy("date")
    return lambda w: ordered.rowsBetween(-(w - 1), 0)


def market_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(
        F.avg("ret_1d").alias("market_ret_1d"),
        share_where(F.col("ret_1d") > 0).alias("market_breadth_1d"),
        F.stddev_samp("ret_1d").alias("market_dispersion_1d"),
        F.sum("dollar_volume").alias("market_dollar_volume"))


def market_state(df: DataFrame, p: Profile) -> DataFrame:
    """Market table with rolled returns, volatility, breadth, dispersion and dollar-volume z.

    The window has no partition key: the table is one row per calendar date.
    """
    frames = _frames([])
    out = {f"market_ret_{w}d": compounded("market_ret_1d", w, frames(w)) for w in p.group_returns}
    for w in p.group_states:
        need = half(w, 5)
        out[f"market_vol_{w}d"] = std("market_ret_1d", w, need, frames(w))
        out[f"market_breadth_{w}d"] = mean("market_breadth_1d", w, need, frames(w))
        out[f"market_dispersion_{w}d"] = mean("market_dispersion_1d", w, need, frames(w))
    z = p.dollar_z
    out[f"market_dollar_volume_z_{z}d"] = zscore("market_dollar_volume", z, z // 2, frames(z))
    return market_daily(df).withColumns(out)


def group_daily(df: DataFrame, group: str, prefix: str, *, dispersion: bool = True) -> DataFrame:
    stats = [F.avg("ret_1d").alias(f"{prefix}_ret_1d"),
             share_where(F.col("ret_1d") > 0).alias(f"{prefix}_breadth_1d"),
             F.count("symbol").alias(f"{prefix}_n_stocks")]
    if dispersion:
        stats.append(F.stddev_samp("ret_1d").alias(f"{prefix}_dispersion_1d"))
    return df.where(F.col(group).isNotNull()).groupBy("date", group).agg(*stats)


def group_state(df: DataFrame, group: str, prefix: str, p: Profile) -> DataFrame:
    frames = _frames([group])
    out = {f"{prefix}_ret_{w}d": compounded(f"{prefix}_ret_1d", w, frames(w)) for w in p.group_returns}
    for w in p.group_states:
        need = half(w, 5)
        out[f"{prefix}_vol_{w}d"] = std(f"{prefix}_ret_1d", w, need, frames(w))
        out[f"{prefix}_breadth_{w}d"] = mean(f"{prefix}_breadth_1d", w, need, frames(w))
        out[f"{prefix}_dispersion_{w}d"] = mean(f"{prefix}_dispersion_1d", w, need, frames(w))
    return group_daily(df, group, prefix).withColumns(out)


def location_state(df: DataFrame, group: str, prefix: str, w: int) -> DataFrame:
    daily = group_daily(df, group, prefix, dispersion=False)
    ret = f"{prefix}_ret_1d"
    rolled_ret = F.expm1(rolled(F.sum, F.log1p(clip(ret, low=-0.999)), w, w // 2, _frames([group])(w)))
    return daily.withColumn(f"{prefix}_ret_{w}d", rolled_ret)


def join_back(df: DataFrame, rolled_table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; rows with a NULL group key match nothing and get NULL. The rolled table is staged: the join knows its size
    before it would shuffle and sort the rows."""
    return df.join(stage(rolled_table), keys, "left")


def market_industry(df: DataFrame, p: Profile) -> DataFrame:
    """Market, sector and sub-industry context with excess returns and momentum ranks."""
    out = join_back(df, market_state(df, p), ["date"])
    for group, prefix in (("sector", "sector"), ("sub_industry", "subind")):
        state = group_state(df, group, prefix, p)
        ranks = {f"{prefix}_mom_rank_{w}d": f"{prefix}_ret_{w}d" for w in p.momentum_ranks}
        out = join_back(out, member_ranks(state, df.where(F.col(group).isNotNull()).groupBy("date", group).agg(F.count(F.lit(1)).alias("_size")), group, ranks), ["date", group])
    return out.withColumns(excess_returns(p.excess))


def member_ranks(state: DataFrame, sizes: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """Percentage ranks over the members of all groups of a date, for values that all members of a group share.

    They follow from the groups' sizes: the tables hold a row per calendar date and group, not one per member.
    """
    sized = state.join(sizes, ["date", group])
    day = Window.partitionBy("date")
    for out, x in columns.items():
        members = F.when(F.col(x).isNotNull(), F.col("_size"))
        order = day.orderBy(F.col(x).asc_nulls_last())
        same = F.sum(members).over(order.rangeBetween(Window.currentRow, Window.currentRow))
        upto = F.sum(members).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        sized = sized.withColumn(out, F.when(F.col(x).isNotNull(), (upto - same + (same + 1) / F.lit(2.0)) / F.sum(members).over(day)))
    return sized.drop("_size")


def excess_returns(windows: Iterable[int]) -> dict[str, Column]:
    return {f"excess_{prefix}_ret_{w}d": F.col(f"ret_{w}d") - F.col(f"{prefix}_ret_{w}d")
            for w in windows for prefix in ("sector", "subind")}


def leave_one_out(df: DataFrame, keys: list[str], columns: Iterable[str], prefix: str, source: DataFrame | None = None) -> DataFrame:
    """``{prefix}_mean_{c}`` over the other members of the group, and ``{prefix}_excess_{c}``.

    The totals come from ``source`` where it is given (the same rows before columns were added). They are staged: the join
    knows their size before it would shuffle and sort the rows.
    """
    columns = list(columns)
    totals = stage((df if source is None else source).groupBy(*keys).agg(*[e for c in columns for e in (
        F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))]))
    out = df.join(totals, keys, "left")
    peers = {f"{prefix}_mean_{c}": ratio(F.col(f"_s_{c}") - F.col(c), F.col(f"_n_{c}") - 1) for c in columns}
    out = out.withColumns(peers)
    out = out.withColumns({f"{prefix}_excess_{c}": F.col(c) - F.col(f"{prefix}_mean_{c}") for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in ("s", "n")])


def style_buckets(df: DataFrame, inputs: tuple[str, str, str]) -> DataFrame:
    """Momentum, volatility and liquidity terciles per date; a missing rank falls in the top bucket."""
    names = ["style_mom_bucket", "style_vol_bucket", "style_liq_bucket"]
    df = with_ranks(df, ["date"], {f"_rank_{n}": c for n, c in zip(names, inputs)})
    df = df.withColumns({n: F.when(F.col(f"_rank_{n}") <= 1 / 3, 0).when(F.col(f"_rank_{n}") <= 2 / 3, 1)
                        .otherwise(2) for n in names})
    bucket = F.col(names[0]) * 9 + F.col(names[1]) * 3 + F.col(names[2])
    return df.withColumn("style_bucket", bucket).drop(*[f"_rank_{n}" for n in names])


def peer_style_geography(df: DataFrame, p: Profile) -> DataFrame:
    # the buckets first: only the given columns are shuffled by date and written, the joins of small tables come after
    out = df = stage(style_buckets(df, p.style_inputs))
    out = leave_one_out(out, ["date", "sector"], p.peer_inputs, "sector_peer", df)
    out = leave_one_out(out, ["date", "sub_industry"], p.peer_inputs, "subind_peer", df)
    w = p.location_return
    for level in ("hq_state", "hq_region"):
        out = join_back(out, location_state(df, level, level, w), ["date", level])
    out = leave_one_out(out, ["date", "style_bucket"], p.style_peer_inputs, "style_peer", df)
    return join_back(out, location_state(df, "style_bucket", "style", w), ["date", "style_bucket"])
