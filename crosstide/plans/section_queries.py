"""Queries over groups and cross-sections: roll-ups, peers, ranks, labels, universe, scaling, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosstide.functions.calendar import age_columns
from crosstide.functions.numeric import clip
from crosstide.operators import asof, rolling, rollup, splits, xsection
from crosstide.operators.roller import Roller
from crosstide.plans.base import P, TRAIN_END, bars, company_dim, core_prices, groups_of, panel
from crosstide.plans.feature_queries import KEY, cols, half
from crosstide.plans.registry import QUERIES, cte, lagged, led, over, pct_rank_sql, query, roll, z_sql
from crosstide.session import shared, stage


def compounded_sql(ret: str, w: int, key: str, need: int | None = None) -> str:
    need = half(w) if need is None else need
    return (f"case when count({ret}) {over(w, key)} >= {need} then "
            f"exp(sum(case when {ret} is not null then ln(1 + greatest({ret}, -0.999::double)) end) {over(w, key)}) - 1 end")


# -- market and group roll-ups ------------------------------------------------------------------

cte("market_daily", """
select date, avg(ret_1d) as market_ret_1d, avg(case when ret_1d > 0 then 1.0::double else 0 end) as market_breadth_1d,
       stddev_samp(ret_1d) as market_dispersion_1d, sum(dollar_volume) as market_dollar_volume from panel group by date""")
cte("market", "select *, " + ", ".join(
    f"{compounded_sql('market_ret_1d', w, '')} as market_ret_{w}d" for w in P.group_returns) + ", " + ", ".join(
    f"{roll('stddev_samp', 'market_ret_1d', w, half(w, 5), '')} as market_vol_{w}d, "
    f"{roll('avg', 'market_breadth_1d', w, half(w, 5), '')} as market_breadth_{w}d, "
    f"{roll('avg', 'market_dispersion_1d', w, half(w, 5), '')} as market_dispersion_{w}d" for w in P.group_states)
    + f", (market_dollar_volume - ({roll('avg', 'market_dollar_volume', P.dollar_z, P.dollar_z // 2, '')})) / "
    f"nullif({roll('stddev_samp', 'market_dollar_volume', P.dollar_z, P.dollar_z // 2, '')}, 0) "
    f"as market_dollar_volume_z_{P.dollar_z}d from market_daily")
_market = (["market_ret_1d", "market_breadth_1d", "market_dispersion_1d"] + [f"market_ret_{w}d" for w in P.group_returns]
           + [f"market_{s}_{w}d" for w in P.group_states for s in ("vol", "breadth", "dispersion")]
           + [f"market_dollar_volume_z_{P.dollar_z}d"])


@query("market_regime", KEY + "market_dollar_volume:e " + cols([f"market_ret_{w}d" for w in P.group_returns], "e") + " "
       + cols([c for c in _market if c not in [f"market_ret_{w}d" for w in P.group_returns]], 6),
       "select b.symbol, m.* from bars b left join market m on b.date = m.date")
def market_regime(spark, sf):
    p = stage(panel(spark, sf).select("symbol", "date", "ret_1d", "dollar_volume"))
    return rollup.join_back(p.select("symbol", "date"), rollup.market_state(p, P), ["date"])


cte("located_panel", """
select p.*, l.hq_state, l.hq_region from panel p left join located l on p.symbol = l.symbol""")


def _group_sql(group: str) -> str:
    k = "grp"
    return (f"select '{group}' as level, grp, date, r1 as ret_1d, br as breadth_1d, n as n_stocks, ds as dispersion_1d, " + ", ".join(
        f"{compounded_sql('r1', w, k)} as ret_{w}d" for w in P.group_returns) + ", " + ", ".join(
        f"{roll('stddev_samp', 'r1', w, half(w, 5), k)} as vol_{w}d, {roll('avg', 'br', w, half(w, 5), k)} as breadth_{w}d, "
        f"{roll('avg', 'ds', w, half(w, 5), k)} as dispersion_{w}d" for w in P.group_states)
        + f" from (select date, {group} as grp, avg(ret_1d) as r1, avg(case when ret_1d > 0 then 1.0::double else 0 end) as br, "
        f"stddev_samp(ret_1d) as ds, count(symbol) as n from located_panel where {group} is not null group by 1, 2)")


cte("sector_state", _group_sql("sector"))
cte("subind_state", _group_sql("sub_industry"))
_states = (["ret_1d", "breadth_1d", "dispersion_1d"] + [f"ret_{w}d" for w in P.group_returns]
           + [f"{s}_{w}d" for w in P.group_states for s in ("vol", "breadth", "dispersion")])


@query("group_rollup", "level:s grp:s date:d n_stocks:i " + cols(
    [f"ret_{w}d" for w in P.group_returns], "e") + " " + cols(
    [c for c in _states if c not in [f"ret_{w}d" for w in P.group_returns]], 6), "\nunion all by name ".join([
    "select * from sector_state", "select * from subind_state", _group_sql("hq_state"), _group_sql("hq_region")]))
def group_rollup(spark, sf):
    dim = company_dim(spark, sf).select("symbol", "sector", "sub_industry", "hq_state", "hq_region")
    p = stage(panel(spark, sf).select("symbol", "date", "ret_1d").join(dim, "symbol", "left"))
    parts = []
    for level in ("sector", "sub_industry", "hq_state", "hq_region"):
        state = rollup.group_state(p, level, "g", P)
        names = {c: c.removeprefix("g_") for c in state.columns if c.startswith("g_")}
        parts.append(state.withColumnsRenamed(names | {level: "grp"}).withColumn("level", F.lit(level)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


cte("excess", "select p.symbol, p.date, p.sector, p.sub_industry, " + ", ".join(
    f"r.ret_{w}d - s.ret_{w}d as excess_sector_ret_{w}d, r.ret_{w}d - i.ret_{w}d as excess_subind_ret_{w}d" for w in P.excess)
    + ", " + ", ".join(f"s.ret_{w}d as sector_ret_{w}d, i.ret_{w}d as subind_ret_{w}d" for w in P.momentum_ranks)
    + " from panel p join rets r on p.symbol = r.symbol and p.date = r.date "
    "left join sector_state s on p.date = s.date and p.sector = s.grp "
    "left join subind_state i on p.date = i.date and p.sub_industry = i.grp")


@query("group_excess_rank", KEY + cols([f"excess_{g}_ret_{w}d" for w in P.excess for g in ("sector", "subind")], "e") + " "
       + cols([f"{g}_mom_rank_{w}d" for w in P.momentum_ranks for g in ("sector", "subind")], 6),
       "select *, " + ", ".join(f"{pct_rank_sql(f'{g}_ret_{w}d', 'date')} as {g}_mom_rank_{w}d"
                                for w in P.momentum_ranks for g in ("sector", "subind")) + " from excess")
def group_excess_rank(spark, sf):
    base = bars(spark, sf).withColumns(rolling.simple_returns(P.returns))
    base = base.withColumn("dollar_volume", F.col("close") * F.col("volume")).join(groups_of(spark, sf), "symbol", "left")
    return rollup.market_industry(stage(base), P)


# -- beta, peers, style -------------------------------------------------------------------------

def _beta_sql() -> str:
    inner = ["select symbol, date, ret_1d, m"]
    for w in P.betas:
        need = max(20, w // 2)
        inner.append(f", case when count(case when m is not null then ret_1d end) {over(w)} >= {need} then "
                     f"covar_samp(ret_1d, m) {over(w)} / nullif({roll('var_samp', 'm', w, need)}, 0) end as beta_{w}d, "
                     f"case when count(case when m is not null then ret_1d end) {over(w)} >= {need} then "
                     f"covar_samp(ret_1d, pm) {over(w)} / nullif(stddev_samp(pr) {over(w)} * stddev_samp(pm) {over(w)}, 0) "
                     f"end as corr_market_{w}d")
    inner.append(" from (select p.symbol, p.date, p.ret_1d, k.market_ret_1d as m, case when p.ret_1d is not null then k.market_ret_1d end as pm, "
                 "case when k.market_ret_1d is not null then p.ret_1d end as pr from panel p left join market_daily k on p.date = k.date)")
    return "".join(inner)


cte("betas", "select *, " + ", ".join(f"ret_1d - beta_{w}d * m as idio_ret_{w}d" for w in P.betas) + f" from ({_beta_sql()})")


@query("beta_corr_idio", KEY + cols([f"{s}_{w}d" for w in P.betas for s in ("beta", "corr_market", "idio_ret", "idio_vol")], 6),
       "select *, " + ", ".join(f"{roll('stddev_samp', f'idio_ret_{w}d', w, max(20, w // 2))} as idio_vol_{w}d" for w in P.betas)
       + " from betas")
def beta_corr_idio(spark, sf):
    p = stage(core_prices(spark, sf).select("symbol", "date", "ret_1d", "dollar_volume"))
    market = rollup.market_daily(p).select("date", "market_ret_1d")
    joined = rollup.join_back(p, market, ["date"])
    return rolling.market_linkage(joined, P.betas)


# The inputs of every cross-sectional step: one table with all columns that the profile names.

FEATURE_COLUMNS = sorted({*P.cross_inputs, *P.peer_inputs, *P.style_inputs, *P.style_peer_inputs, *P.node_features,
                          *[c for c in P.core_features if "_rank_" not in c]})
for _name, _query in (("f_skip", "skip_momentum"), ("f_range", "vol_range"), ("f_sma", "sma_gap_slope"), ("f_boll", "bollinger_cci"),
                      ("f_chan", "channel_williams"), ("f_volume", "volume_stats"), ("f_amihud", "amihud"), ("f_idio", "beta_corr_idio"),
                      ("f_age", "age_features")):
    cte(_name, QUERIES[_query].sql)


def _feature_sql() -> str:
    sources = {"panel": "p", "rets": "r", "vols": "v", "rsis": "x", "excess": "e", "f_skip": "k", "f_range": "g", "f_sma": "m", "f_boll": "b",
               "f_chan": "c", "f_volume": "u", "f_amihud": "h", "f_idio": "i", "f_age": "a"}
    owner = {"ret_1d": "p", "log_dollar_volume": "p"}
    for c in FEATURE_COLUMNS:
        for prefix, alias in (("excess_", "e"), ("mom_", "k"), ("parkinson_", "g"), ("gk_", "g"), ("sma_", "m"), ("boll_", "b"), ("channel_", "c"),
                              ("volume_", "u"), ("dollar_volume_", "u"), ("amihud_", "h"), ("beta_", "i"), ("idio_", "i"), ("corr_market_", "i"),
                              ("firm_", "a"), ("sp500_", "a"), ("rsi_", "x"), ("vol_", "v"), ("downside_", "v"), ("ret_", "r")):
            if c not in owner and c.startswith(prefix):
                owner[c] = alias
    joins = " ".join(f"join {t} {a} on p.symbol = {a}.symbol and p.date = {a}.date" for t, a in sources.items() if t != "panel")
    picked = [f"round({owner[c]}.{c}, 12) as {c}" if c.startswith("excess_") else f"{owner[c]}.{c}" for c in FEATURE_COLUMNS]
    return (f"select p.symbol, p.date, p.sector, p.sub_industry, p.close, q.mom, {', '.join(picked)} "
            f"from panel p {joins} join (select symbol, date, {lagged('close', 4)} / nullif({lagged('close', 12)}, 0) - 1 as mom from bars) q "
            "on p.symbol = q.symbol and p.date = q.date")


cte("signals", _feature_sql())


def _windows(prefix: str) -> list[int]:
    """Window sizes of the wanted columns with this prefix."""
    found = [c[len(prefix):] for c in FEATURE_COLUMNS if c.startswith(prefix)]
    return sorted({int(w[:-1]) for w in found if w[:-1].isdigit()})


def entity_features(spark, sf):
    """All wanted columns that need one symbol's history only: one shuffle, one pass of shared windows."""
    df = bars(spark, sf).withColumns(rolling.price_state())
    df = df.withColumns(rolling.simple_returns(_windows("ret_")) | rolling.skip_momentum(P.skip_pairs) | {
        "mom": F.try_divide(rolling.lag("close", 4), rolling.lag("close", 12)) - 1})
    df = df.withColumns(rolling.range_terms())
    out = Roller(df)
    # asked for one by one: a statistic that is named costs passes, whether its column is kept or not
    every = {f"vol_{w}d": out.std("ret_1d", w, half(w)) for w in _windows("vol_")}
    every |= {f"downside_vol_{w}d": out.std(("_down", rolling.signed_part("ret_1d", -1)), w, half(w)) for w in _windows("downside_vol_")}
    for name in ("parkinson", "gk"):
        every |= {f"{name}_vol_{w}d": F.sqrt(clip(out.mean(f"{name}_term", w, half(w)), 0.0)) for w in _windows(f"{name}_vol_")}
    for name in ("volume", "dollar_volume"):
        every |= {f"{name}_z_{w}d": out.zscore(name, w, half(w)) for w in _windows(f"{name}_z_")}
    every |= (rolling.rsi(out, _windows("rsi_")) | rolling.bollinger(out, _windows("boll_z_")) | rolling.channels(out, _windows("channel_pos_"))
              | rolling.amihud(out, _windows("amihud_")) | rolling.averages(out, _windows("sma_gap_")))
    df = out.finish({n: c for n, c in every.items() if n in FEATURE_COLUMNS or n.startswith("sma_")})
    df = df.withColumns({f"sma_gap_{w}d": F.try_divide(F.col("close"), F.col(f"sma_{w}d")) - 1 for w in _windows("sma_gap_")})
    own = [c for c in FEATURE_COLUMNS if c in df.columns]
    return df.select("symbol", "date", *dict.fromkeys(["close", "mom", "ret_1d", "dollar_volume", *own]))


def signals(spark, sf, *, write: bool = True):
    """The panel of ``feature_panel``, written once per session; without ``write`` derived if it is not there."""
    return shared(spark, "signals", sf, lambda: feature_panel(spark, sf), write=write)


@query("feature_panel", KEY + "sector:s sub_industry:s close:2 mom:6 " + cols(FEATURE_COLUMNS, "e"), "select * from signals")
def feature_panel(spark, sf):
    """Panel with every column that cross-sections, peers, styles, graphs and models read."""
    dim = stage(company_dim(spark, sf).select("symbol", "sector", "sub_industry", "founded_year", "legacy_founded_year", "date_added"))
    w = [int(c.rsplit("_", 1)[1][:-1]) for c in FEATURE_COLUMNS if c.startswith("excess_sector_ret_")]
    # the roll-ups start from a few columns; they hold a row per date and group, so the wide rows are neither written nor shuffled for them
    narrow = stage(bars(spark, sf).select("symbol", "date", "close").withColumns(
        rolling.simple_returns([1])).drop("close").join(dim.select("symbol", "sector", "sub_industry"), "symbol", "left"))
    out = entity_features(spark, sf).join(dim, "symbol", "left")
    out = rollup.join_back(out, narrow.groupBy("date").agg(F.avg("ret_1d").alias("market_ret_1d")), ["date"])
    for group, prefix in (("sector", "sector"), ("sub_industry", "subind")):
        state = rollup.group_state(narrow, group, prefix, P).select("date", group, *[f"{prefix}_ret_{n}d" for n in w])
        out = rollup.join_back(out, state, ["date", group])
    # rounded, so that the order of summation cannot split or make ties
    out = out.withColumns({n: F.round(c, 12) for n, c in rollup.excess_returns(w).items()}).withColumns(age_columns())
    out = rolling.market_linkage(out, _windows("beta_"))
    return out.select("symbol", "date", "sector", "sub_industry", "close", "mom", *FEATURE_COLUMNS)


_peers = list(P.peer_inputs)


def _loo_sql(x: str, keys: str) -> str:
    return (f"(sum({x}) over (partition by {keys}) - {x}) / nullif(count({x}) over (partition by {keys}) - 1, 0)")


@query("loo_peer", KEY + cols([f"{g}_peer_{k}_{c}" for c in _peers for g in ("sector", "subind") for k in ("mean", "excess")], 5),
       "select symbol, date, " + ", ".join(
           f"case when {k} is not null then {_loo_sql(c, f'date, {k}')} end as {g}_peer_mean_{c}, "
           f"case when {k} is not null then {c} - {_loo_sql(c, f'date, {k}')} end as {g}_peer_excess_{c}"
           for c in _peers for g, k in (("sector", "sector"), ("subind", "sub_industry"))) + " from signals")
def loo_peer(spark, sf):
    df = signals(spark, sf)
    out = rollup.leave_one_out(df, ["date", "sector"], _peers, "sector_peer")
    return rollup.leave_one_out(out, ["date", "sub_industry"], _peers, "subind_peer", df)


def _bucket(x: str) -> str:
    return f"case when {x} <= 1/3.0::double then 0 when {x} <= 2/3.0::double then 1 else 2 end"


_style_peers = list(P.style_peer_inputs)
cte("styled", f"""
select *, {_bucket('q1')} * 9 + {_bucket('q2')} * 3 + {_bucket('q3')} as style_bucket, {_bucket('q1')} as style_mom_bucket,
       {_bucket('q2')} as style_vol_bucket, {_bucket('q3')} as style_liq_bucket
from (select *, {pct_rank_sql('ret_12d', 'date')} as q1, {pct_rank_sql('vol_12d', 'date')} as q2,
             {pct_rank_sql('log_dollar_volume', 'date')} as q3 from signals)""")


@query("style_bucket", KEY + "style_mom_bucket:i style_vol_bucket:i style_liq_bucket:i style_bucket:i style_n_stocks:i "
       "style_ret_1d:6 style_breadth_1d:6 style_ret_12d:e " + cols(
    [f"style_peer_{k}_{c}" for c in _style_peers for k in ("mean", "excess")], 6),
    "with g as (select date, style_bucket as b, avg(ret_1d) as r1, avg(case when ret_1d > 0 then 1.0::double else 0 end) as br, "
    f"count(symbol) as n from styled group by 1, 2), h as (select *, {compounded_sql('r1', 12, 'b', 6)} as r12 from g) "
    "select symbol, s.date, style_mom_bucket, style_vol_bucket, style_liq_bucket, style_bucket, n as style_n_stocks, "
    "r1 as style_ret_1d, br as style_breadth_1d, r12 as style_ret_12d, " + ", ".join(
        f"{_loo_sql(c, 's.date, style_bucket')} as style_peer_mean_{c}, {c} - {_loo_sql(c, 's.date, style_bucket')} as style_peer_excess_{c}"
        for c in _style_peers) + " from styled s left join h on s.date = h.date and s.style_bucket = h.b")
def style_bucket(spark, sf):
    df = signals(spark, sf).select(*dict.fromkeys(["symbol", "date", "ret_1d", *P.style_inputs, *_style_peers]))
    df = stage(rollup.style_buckets(df, P.style_inputs))
    state = rollup.location_state(df.select("date", "symbol", "ret_1d", "style_bucket"), "style_bucket", "style", 12)
    df = rollup.leave_one_out(df, ["date", "style_bucket"], _style_peers, "style_peer")
    return rollup.join_back(df, state, ["date", "style_bucket"])


# -- cross-sections -----------------------------------------------------------------------------

_cross = list(P.cross_inputs)


@query("cs_zscore", KEY + cols([f"cs_z_{c}" for c in _cross], 5),
       "select symbol, date, " + ", ".join(f"{z_sql(c, 'date')} as cs_z_{c}" for c in _cross) + " from signals")
def cs_zscore(spark, sf):
    # read twice, and still less than writing it once: the windows shuffle the seven columns of the bars
    return xsection.zscores(signals(spark, sf, write=False).select("symbol", "date", *_cross), ["date"], _cross, "cs")


@query("cs_pct_rank", KEY + cols([f"cs_rank_{c}" for c in _cross], 6),
       "select symbol, date, " + ", ".join(f"{pct_rank_sql(c, 'date')} as cs_rank_{c}" for c in _cross) + " from signals")
def cs_pct_rank(spark, sf):
    rows = signals(spark, sf, write=False).select("symbol", "date", *_cross)
    return xsection.pct_ranks(rows, ["date"], _cross, "cs", bars(spark, sf))


_neutral = list(P.cross_inputs)


@query("group_neutral", KEY + cols([f"{g}_{k}_{c}" for c in _neutral for g in ("sector", "subind") for k in ("z", "rank")], 5),
       "select symbol, date, " + ", ".join(
           f"case when {k} is not null then {z_sql(c, f'date, {k}')} end as {g}_z_{c}, "
           f"{pct_rank_sql(c, f'date, {k}', f'and {k} is not null')} as {g}_rank_{c}"
           for c in _neutral for g, k in (("sector", "sector"), ("subind", "sub_industry"))) + " from signals")
def group_neutral(spark, sf):
    scopes = {k: v for k, v in xsection.SCOPES.items() if k != "cs"}
    rows = signals(spark, sf, write=False).select("symbol", "date", "sector", "sub_industry", *_neutral)
    return xsection.cross_sectional(rows, _neutral, scopes, bars(spark, sf))


cte("fwd", "select symbol, date, sector, " + ", ".join(
    f"{led('close', h)} / nullif(close, 0) - 1 as target_ret_fwd_{h}d" for h in P.targets) + " from panel")


def _targets_sql(h: int) -> str:
    x = f"target_ret_fwd_{h}d"
    return (f"{x} - avg({x}) over (partition by date) as target_excess_market_fwd_{h}d, "
            f"{pct_rank_sql(x, 'date')} as target_rank_fwd_{h}d, "
            f"case when sector is not null then {x} - avg({x}) over (partition by date, sector) end as target_excess_sector_fwd_{h}d")


cte("targets", "select *, " + ", ".join(_targets_sql(h) for h in P.targets) + " from fwd")


def targets_panel(spark, sf):
    df = bars(spark, sf).select("symbol", "date", "close").withColumns(rolling.forward_returns(P.targets))
    return xsection.relative_targets(stage(df.join(groups_of(spark, sf), "symbol", "left")), P.targets)


@query("targets", KEY + cols([f"target_{f}_fwd_{h}d" for h in P.targets
                              for f in ("ret", "excess_market", "rank", "excess_sector")], 6), "select * from targets")
def targets(spark, sf):
    return targets_panel(spark, sf)


@query("liquidity_universe", KEY + "log_dollar_volume:6", """
select * from (select symbol, date, log_dollar_volume,
                      row_number() over (partition by date order by log_dollar_volume nulls last, symbol)::double
                      / count(log_dollar_volume) over (partition by date) as q from panel)
where log_dollar_volume is not null and q > 0.2::double""")
def liquidity_universe(spark, sf):
    df = core_prices(spark, sf).select("symbol", "date", "log_dollar_volume")
    return xsection.liquidity_universe(df, "log_dollar_volume", 0.2)


_clip = [c for c in P.core_features if c in FEATURE_COLUMNS]


@query("winsorize", KEY + cols(_clip, 6),
       "with q as (select date, " + ", ".join(
           f"quantile_cont({c}, 0.01::double) as lo_{c}, quantile_cont({c}, 0.99::double) as hi_{c}" for c in _clip)
       + " from signals group by date) select symbol, s.date, " + ", ".join(
           f"case when {c} is not null then least(greatest({c}, lo_{c}), hi_{c}) end as {c}" for c in _clip)
       + " from signals s join q on s.date = q.date")
def winsorize(spark, sf):
    return xsection.winsorize(signals(spark, sf).select("symbol", "date", *_clip), _clip, 0.01)


@query("train_impute_scale", KEY + cols(_clip, 6),
       f"with tr as (select * from signals where date <= date '{TRAIN_END}'), "
       "md as (select " + ", ".join(f"quantile_cont({c}, 0.5::double) as {c}" for c in _clip) + " from tr), "
       "st as (select " + ", ".join(f"avg(coalesce(tr.{c}, md.{c})) as m_{c}, stddev_pop(coalesce(tr.{c}, md.{c})) as s_{c}"
                                    for c in _clip) + " from tr, md) "
       "select symbol, date, " + ", ".join(
           f"(coalesce(s.{c}, md.{c}) - m_{c}) / case when s_{c} > 0 then s_{c} else 1 end as {c}" for c in _clip)
       + " from signals s, md, st")
def train_impute_scale(spark, sf):
    df = signals(spark, sf).select("symbol", "date", *_clip)
    stats = xsection.scaler_table(df.where(F.col("date") <= splits.as_date(TRAIN_END)), _clip, [])
    return xsection.apply_scaler(df, stats, _clip, [])


# -- as-of --------------------------------------------------------------------------------------

cte("sparse_state", """
select symbol, date, case when (date - date '1990-01-01') // 7 % 26 = 5 then null else close end as state_close,
       volume as state_volume from bars where (date - date '1990-01-01') // 7 % 13 = 5 and symbol % 7 <> 3""")


@query("asof_daily", KEY + "state_close:2 state_volume:2 state_date:d", """
select b.symbol, b.date, s.state_close, s.state_volume, s.date as state_date
from bars b asof left join sparse_state s on b.symbol = s.symbol and b.date >= s.date""")
def asof_daily(spark, sf):
    b = bars(spark, sf)
    week = F.floor(F.datediff("date", F.lit("1990-01-01").cast("date")) / 7)
    state = b.where((week % 13 == 5) & (F.col("symbol") % 7 != 3)).select(
        "symbol", "date", F.when(week % 26 != 5, F.col("close")).alias("state_close"),
        F.col("volume").alias("state_volume"), F.col("date").alias("state_date"))
    return asof.asof_backward(b.select("symbol", "date"), state)
