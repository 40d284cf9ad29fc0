"""Queries over single entities: bars, scopes, quality, dimension and window features."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from crosstide.functions.calendar import age_columns, calendar_columns
from crosstide.functions.scalars import with_one_row
from crosstide.functions.text import earliest_year, first_year
from crosstide.operators import quality, rolling
from crosstide.operators.roller import Roller
from crosstide.plans.base import P, bars, company_dim, core_prices
from crosstide.plans.registry import cte, lagged, led, over, query, roll
from crosstide.sources import tables

KEY = "symbol:i date:d "


def cols(names, digits) -> str:
    return " ".join(f"{n}:{digits}" for n in names)


def half(w: int, floor: int = 3) -> int:
    return max(floor, w // 2)


# -- bars, scopes, quality ----------------------------------------------------------------------

@query("bars_weekly", KEY + "open:2 high:2 low:2 close:2 volume:2", "select * from bars")
def bars_weekly(spark, sf):
    return bars(spark, sf)


@query("bars_events", KEY + "open:4 high:4 low:4 close:4 volume:1", """
select user_id as symbol, ts::date as date, arg_min(value, row(ts, event_id)) as open, max(value) as high,
       min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*)::double as volume
from events group by 1, 2""")
def bars_events(spark, sf):
    return tables.daily_events(spark, sf)


@query("load_scope", KEY + "close:2 rows_scoped:i symbols_scoped:i date_min:d date_max:d", """
with s as (select * from bars where date between date '1996-01-01' and date '2000-12-31'),
     h as (select * from s where symbol in (select symbol from s group by symbol having count(date) >= 200)),
     f as (select * from h where symbol in (select symbol from (select distinct symbol from h) order by symbol limit 40))
select symbol, date, close, (select count(*) from f) as rows_scoped, (select count(distinct symbol) from f) as symbols_scoped,
       (select min(date) from f) as date_min, (select max(date) from f) as date_max
from f""")
def load_scope(spark, sf):
    scoped = tables.scope(bars(spark, sf), start="1996-01-01", end="2000-12-31", min_history=200, max_symbols=40)
    summary = tables.load_summary(scoped).withColumnsRenamed({"rows": "rows_scoped", "symbols": "symbols_scoped"})
    return with_one_row(scoped.select("symbol", "date", "close"), summary)


cte("dirty", """
select symbol, date, case when symbol % 17 = 4 and week_no % 40 = 1 then null else open end as open,
       case when symbol % 10 = 5 and week_no % 60 = 2 then low - 1 else high end as high, low,
       case when symbol % 19 = 7 and week_no % 45 = 3 then -close else close end as close,
       case when symbol % 10 = 3 and week_no % 50 = 0 then 0 else volume end as volume
from (select *, (date - date '1990-01-01') // 7 as week_no from bars)""")


def dirty_bars(spark, sf):
    """Bars with bad rows put in by a rule on symbol and week, the same rule as in the SQL."""
    s, week = F.col("symbol"), F.floor(F.datediff("date", F.lit("1990-01-01").cast("date")) / 7)
    b = bars(spark, sf)
    return b.select(
        "symbol", "date",
        F.when((s % 17 == 4) & (week % 40 == 1), None).otherwise(F.col("open")).alias("open"),
        F.when((s % 10 == 5) & (week % 60 == 2), F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low",
        F.when((s % 19 == 7) & (week % 45 == 3), -F.col("close")).otherwise(F.col("close")).alias("close"),
        F.when((s % 10 == 3) & (week % 50 == 0), 0.0).otherwise(F.col("volume")).alias("volume"))


_missing = [f"missing_{c}" for c in quality.CORE]
_inverted = "coalesce(high < greatest(open, close, low), false) or coalesce(low > least(open, close, high), false)"


@query("quality_report", "rows:i symbols:i date_min:d date_max:d duplicate_symbol_dates:i " + cols(_missing, "i")
       + " non_positive_close_rows:i non_positive_volume_rows:i ohlc_inversion_rows:i moves_warn:i moves_error:i", f"""
with twice as (select * from dirty union all select * from dirty where symbol % 23 = 1),
     r as (select close / nullif(lag(close) over (partition by symbol order by date), 0) - 1 as ret from dirty)
select count(*) as rows, count(distinct symbol) as symbols, min(date) as date_min, max(date) as date_max,
       count(*) - count(distinct (symbol, date)) as duplicate_symbol_dates,
       {', '.join(f'count(*) filter (where {c} is null) as missing_{c}' for c in quality.CORE)},
       count(*) filter (where close <= 0) as non_positive_close_rows,
       count(*) filter (where volume <= 0) as non_positive_volume_rows,
       count(*) filter (where {_inverted}) as ohlc_inversion_rows,
       (select count(*) filter (where abs(ret) > 0.5) from r) as moves_warn,
       (select count(*) filter (where abs(ret) > 3.0) from r) as moves_error
from twice""")
def quality_report(spark, sf):
    dirty = dirty_bars(spark, sf)
    twice = dirty.unionByName(dirty.where(F.col("symbol") % 23 == 1))
    moves = quality.large_moves(dirty.withColumns(rolling.simple_returns([1])))
    return with_one_row(quality.quality_report(twice), moves)


@query("bad_bar_filter", KEY + "open:2 high:2 low:2 close:2 volume:2", f"""
select * from dirty where open is not null and high is not null and low is not null and close > 0 and volume > 0
       and not ({_inverted})""")
def bad_bar_filter(spark, sf):
    return tables.without_bad_bars(dirty_bars(spark, sf))


# -- calendar, dimension, ages ------------------------------------------------------------------

@query("calendar_features", KEY + "year:i month:i quarter:i day_of_week:i is_month_end:i is_quarter_end:i "
       "month_sin:6 month_cos:6", """
select symbol, date, year(date) as year, month(date) as month, quarter(date) as quarter, isodow(date) - 1 as day_of_week,
       (last_day(date) = date)::int as is_month_end, (last_day(date) = date and month(date) % 3 = 0)::int as is_quarter_end,
       sin(2 * pi() * month(date) / 12) as month_sin, cos(2 * pi() * month(date) / 12) as month_cos
from (select distinct l_suppkey as symbol, l_shipdate::date as date from lineitem)""")
def calendar_features(spark, sf):
    days = tables.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumns(calendar_columns())


_levels = tables.GROUP_LEVELS
cte("dim", f"""
select l.symbol, company, date_added, l.sector, l.sub_industry, l.hq_city, l.hq_state, l.hq_region,
       regexp_extract_all(founded, '(?:18|19|20)[0-9]{{2}}')[1]::double as founded_year,
       list_min(list_transform(regexp_extract_all(founded, '(?:18|19|20)[0-9]{{2}}'), lambda x: x::int))::double as legacy_founded_year,
       {', '.join(f'dense_rank() over (order by l.{g}) - 1 as {g}_code, count(l.symbol) over (partition by l.{g}) as {g}_n_companies' for g in _levels)}
from (select symbol, company, date_added, founded, coalesce(sector, 'Unknown') as sector,
             coalesce(sub_industry, 'Unknown') as sub_industry, hq_city, hq_state, hq_region from located) l""")


@query("company_dimension", "symbol:i company:s date_added:d sector:s sub_industry:s hq_city:s hq_state:s hq_region:s "
       "founded_year:0 legacy_founded_year:0 " + " ".join(f"{g}_code:i {g}_n_companies:i" for g in _levels),
       "select * from dim")
def company_dimension(spark, sf):
    return company_dim(spark, sf)


@query("years_in_documents", "doc_id:i first_year:0 earliest_year:0", """
select doc_id, y[1]::double as first_year, list_min(list_transform(y, lambda x: x::int))::double as earliest_year
from (select doc_id, regexp_extract_all(text, '(?:18|19|20)[0-9]{2}') as y from documents)""")
def years_in_documents(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select("doc_id", first_year("text").alias("first_year"), earliest_year("text").alias("earliest_year"))


@query("age_features", KEY + "first_trade_age_years:6 firm_age_years:0 legacy_firm_age_years:0 "
       "sp500_membership_age_years:6 sp500_member_asof:i", """
select b.symbol, b.date, (b.date - min(b.date) over (partition by b.symbol)) / 365.25::double as first_trade_age_years,
       year(b.date) - founded_year as firm_age_years, year(b.date) - legacy_founded_year as legacy_firm_age_years,
       case when b.date >= date_added then (b.date - date_added) / 365.25::double end as sp500_membership_age_years,
       coalesce((b.date >= date_added)::int, 0) as sp500_member_asof
from bars b left join dim d on b.symbol = d.symbol""")
def age_features(spark, sf):
    dim = company_dim(spark, sf).select("symbol", "founded_year", "legacy_founded_year", "date_added")
    return tables.panel(bars(spark, sf).select("symbol", "date"), dim).withColumns(age_columns())


# -- price state and returns --------------------------------------------------------------------

_state = ["log_price", "log_volume", "log_dollar_volume", "intraday_ret", "overnight_ret", "high_low_range",
          "close_location", "open_location", "close_to_high", "close_to_low", "ret_per_log_dollar_volume"]
_prev = lagged("close", 1)


@query("price_state", KEY + "dollar_volume:2 typical_price:4 amount:2 " + cols(_state, 6), f"""
select symbol, date, close * volume as dollar_volume, (high + low + close) / 3 as typical_price,
       volume * ((open + high + low + close) / 4) as amount, ln(greatest(close, 1e-12)) as log_price,
       ln(1 + volume) as log_volume, ln(1 + close * volume) as log_dollar_volume,
       close / nullif(open, 0) - 1 as intraday_ret, open / nullif({_prev}, 0) - 1 as overnight_ret,
       high / nullif(low, 0) - 1 as high_low_range, (close - low) / nullif(high - low, 0) as close_location,
       (open - low) / nullif(high - low, 0) as open_location, close / nullif(high, 0) - 1 as close_to_high,
       close / nullif(low, 0) - 1 as close_to_low,
       abs(close / nullif({_prev}, 0) - 1) / nullif(ln(1 + close * volume), 0) as ret_per_log_dollar_volume
from bars""")
def price_state(spark, sf):
    df = bars(spark, sf).withColumns(rolling.price_state() | rolling.traded_amount() | rolling.simple_returns([1]))
    return df.withColumns(rolling.impact())


cte("rets", "select symbol, date, close, ln(close) as lp, "
    + ", ".join(f"close / nullif({lagged('close', w)}, 0) - 1 as ret_{w}d" for w in P.returns) + " from bars")
_rets = [f"ret_{w}d" for w in P.returns]


@query("returns", KEY + cols(_rets, 6) + " " + cols([f"log_ret_{w}d" for w in P.returns], 6) + " "
       + cols([f"rev_{w}d" for w in P.returns], 6) + " " + cols([f"mom_accel_{a}_{b}" for a, b in P.accel_pairs], 6)
       + " additivity_ok:b",
       "select r.symbol, r.date, " + ", ".join(_rets) + ", "
       + ", ".join(f"lp - {lagged('lp', w, 'r.symbol')} as log_ret_{w}d, -ret_{w}d as rev_{w}d" for w in P.returns) + ", "
       + ", ".join(f"ret_{a}d - ret_{b}d as mom_accel_{a}_{b}" for a, b in P.accel_pairs)
       + ", g.ok as additivity_ok from rets r join (select symbol, coalesce(max(abs(s - direct)) < 1e-9, true) as ok from ("
       + f"select symbol, {roll('sum', 'r1', 5, 5)} as s, lp - {lagged('lp', 5)} as direct from ("
       + f"select symbol, date, lp, lp - {lagged('lp', 1)} as r1 from rets)) group by symbol) g on r.symbol = g.symbol")
def returns(spark, sf):
    df = bars(spark, sf).withColumn("log_price", F.log("close"))
    df = df.withColumns(rolling.simple_returns(P.returns) | rolling.log_returns(P.returns))
    df = df.withColumns(rolling.reversals(P.returns) | rolling.acceleration(P.accel_pairs) | rolling.additivity_gap())
    worst = F.max("_additivity_gap").over(Window.partitionBy("symbol"))
    return df.withColumn("additivity_ok", F.coalesce(worst < 1e-9, F.lit(True)))


@query("skip_momentum", KEY + cols([f"mom_{b}d_skip_{a}d" for a, b in P.skip_pairs], 6),
       "select symbol, date, " + ", ".join(
           f"{lagged('close', a)} / nullif({lagged('close', b)}, 0) - 1 as mom_{b}d_skip_{a}d" for a, b in P.skip_pairs)
       + " from bars")
def skip_momentum(spark, sf):
    return bars(spark, sf).withColumns(rolling.skip_momentum(P.skip_pairs))


# -- volatility ---------------------------------------------------------------------------------

cte("signed", """select *, case when ret_1d < 0 then ret_1d else 0 end as dn, case when ret_1d > 0 then ret_1d else 0 end as up
from panel""")
cte("vols", "select symbol, date, " + ", ".join(
    f"{roll('stddev_samp', 'ret_1d', w, half(w))} as vol_{w}d, {roll('stddev_samp', 'dn', w, half(w))} as downside_vol_{w}d, "
    f"{roll('stddev_samp', 'up', w, half(w))} as upside_vol_{w}d" for w in P.vols) + " from signed")


@query("vol_std", KEY + cols([f"{s}vol_{w}d" for w in P.vols for s in ("", "downside_", "upside_")], 6) + " "
       + cols([f"vol_ratio_{a}_{b}" for a, b in P.vol_ratio_pairs], 6),
       "select *, " + ", ".join(f"vol_{a}d / nullif(vol_{b}d, 0) as vol_ratio_{a}_{b}" for a, b in P.vol_ratio_pairs)
       + " from vols")
def vol_std(spark, sf):
    df = core_prices(spark, sf).select("symbol", "date", "ret_1d")
    out = Roller(df)
    return out.finish(rolling.return_vols(out, P.vols)).withColumns(rolling.vol_ratios(P.vol_ratio_pairs))


@query("vol_range", KEY + "true_range_pct:6 " + cols(
    [f"{s}_{w}d" for w in P.vols for s in ("parkinson_vol", "gk_vol", "atr")], 6),
    "with t as (select symbol, date, pow(ln(greatest(high, 1e-12) / greatest(low, 1e-12)), 2) / (4 * ln(2.0::double)) as pk, "
    "0.5::double * pow(ln(high / low), 2) - (2 * ln(2.0::double) - 1) * pow(ln(close / open), 2) as gk, "
    f"greatest(high - low, abs(high - {_prev}), abs(low - {_prev})) / nullif(close, 0) as true_range_pct from bars) "
    "select symbol, date, true_range_pct, " + ", ".join(
        f"sqrt(greatest({roll('avg', 'pk', w, half(w))}, 0)) as parkinson_vol_{w}d, "
        f"case when count(gk) {over(w)} >= {half(w)} then sqrt(greatest(avg(gk) {over(w)}, 0)) end as gk_vol_{w}d, "
        f"{roll('avg', 'true_range_pct', w, half(w))} as atr_{w}d" for w in P.vols).replace(
        "sqrt(greatest(case", "sqrt((case").replace("end, 0)) as parkinson", "end)) as parkinson") + " from t")
def vol_range(spark, sf):
    df = bars(spark, sf).withColumns(rolling.range_terms()).select(
        "symbol", "date", "parkinson_term", "gk_term", "true_range_pct")
    out = Roller(df)
    return out.finish(rolling.range_vols(out, P.vols))


@query("tail_drawdown", KEY + cols([f"ret_{s}_{w}d" for w in P.vols for s in ("skew", "kurt")], 5) + " "
       + cols([f"{s}_ret_{w}d" for w in P.vols for s in ("max", "min")], 6) + " "
       + cols([f"drawdown_from_{w}d_high" for w in P.drawdowns], 6),
       "select symbol, date, " + ", ".join(
           f"case when count(ret_1d) {over(w)} >= {half(w)} and count(ret_1d) {over(w)} >= 3 then skewness(ret_1d) {over(w)} end as ret_skew_{w}d, "
           f"case when count(ret_1d) {over(w)} >= {half(w)} and count(ret_1d) {over(w)} >= 4 then kurtosis(ret_1d) {over(w)} end as ret_kurt_{w}d, "
           f"{roll('max', 'ret_1d', w, half(w))} as max_ret_{w}d, {roll('min', 'ret_1d', w, half(w))} as min_ret_{w}d"
           for w in P.vols) + ", " + ", ".join(
           f"close / nullif({roll('max', 'close', w, max(5, w // 3))}, 0) - 1 as drawdown_from_{w}d_high"
           for w in P.drawdowns) + " from panel")
def tail_drawdown(spark, sf):
    df = core_prices(spark, sf).select("symbol", "date", "close", "ret_1d")
    out = Roller(df)
    return out.finish(rolling.tails(out, P.vols) | rolling.drawdowns(out, P.drawdowns))


# -- trend --------------------------------------------------------------------------------------

cte("smas", "select symbol, date, close, " + ", ".join(
    f"{roll('avg', 'close', w, half(w))} as sma_{w}d" for w in P.averages) + " from bars")


@query("sma_gap_slope", KEY + cols([f"sma_{w}d" for w in P.averages], 3) + " "
       + cols([f"sma_{s}_{w}d" for w in P.averages for s in ("gap", "slope")], 6),
       "select *, " + ", ".join(f"close / nullif(sma_{w}d, 0) - 1 as sma_gap_{w}d, "
                                f"sma_{w}d / nullif({lagged(f'sma_{w}d', w)}, 0) - 1 as sma_slope_{w}d"
                                for w in P.averages) + " from smas")
def sma_gap_slope(spark, sf):
    out = Roller(bars(spark, sf).select("symbol", "date", "close"))
    return out.finish(rolling.averages(out, P.averages)).withColumns(rolling.average_gaps(P.averages))


def _ema(name: str, span: int, x: str = "e.x") -> str:
    a = 2.0 / (span + 1)
    return f"{a!r}::double * {x} + {1 - a!r}::double * r.{name}"


_spans = list(P.averages)


@query("ema_macd", KEY + cols([f"ema_{w}d" for w in _spans], 3) + " " + cols([f"ema_gap_{w}d" for w in _spans], 6)
       + " macd_line:6 macd_signal:6 macd_hist:6", f"""
with recursive ordered as (select symbol, date, close as x, row_number() over (partition by symbol order by date) as rn from bars),
run as (
  select symbol, date, x, rn, {', '.join(f'x as e{s}' for s in _spans)}, x as f12, x as s26, 0::double as sig from ordered where rn = 1
  union all
  select e.symbol, e.date, e.x, e.rn, {', '.join(_ema(f'e{s}', s) for s in _spans)}, {_ema('f12', 12)}, {_ema('s26', 26)},
         {2 / 10!r}::double * (({_ema('f12', 12)}) - ({_ema('s26', 26)})) + {1 - 2 / 10!r}::double * r.sig
  from run r join ordered e on e.symbol = r.symbol and e.rn = r.rn + 1)
select symbol, date, {', '.join(f'e{s} as ema_{s}d, x / nullif(e{s}, 0) - 1 as ema_gap_{s}d' for s in _spans)},
       (f12 - s26) / nullif(x, 0) as macd_line, sig / nullif(x, 0) as macd_signal, (f12 - s26 - sig) / nullif(x, 0) as macd_hist
from run""")
def ema_macd(spark, sf):
    return rolling.exponential_trend(bars(spark, sf).select("symbol", "date", "close"), P.averages, P.macd)


cte("rsis", f"""
with d as (select symbol, date, close - {lagged('close', 1)} as step from bars),
     g as (select symbol, date, case when step is null then null else greatest(step, 0) end as gain,
                  case when step is null then null else -least(step, 0) end as loss from d)
select symbol, date, {', '.join(f"100 - 100 / (1 + ({roll('avg', 'gain', w, half(w))}) / nullif({roll('avg', 'loss', w, half(w))}, 0)) as rsi_{w}d" for w in P.rsi)}
from g""")


@query("rsi", KEY + cols([f"rsi_{w}d" for w in P.rsi], 5), "select * from rsis")
def rsi(spark, sf):
    out = Roller(bars(spark, sf).select("symbol", "date", "close"))
    return out.finish(rolling.rsi(out, P.rsi))


_typ = "(high + low + close) / 3"
_boll = {w: (roll("avg", "close", w, half(w, 5)), roll("stddev_samp", "close", w, half(w, 5))) for w in P.bollinger}


@query("bollinger_cci", KEY + cols([f"boll_{s}_{w}d" for w in P.bollinger for s in ("z", "bandwidth", "percent_b")], 6)
       + " " + cols([f"cci_approx_{w}d" for w in P.cci], 4),
       "select symbol, date, " + ", ".join(
           f"(close - m{w}) / nullif(s{w}, 0) as boll_z_{w}d, (4 * s{w}) / nullif(m{w}, 0) as boll_bandwidth_{w}d, "
           f"(close - (m{w} - 2 * s{w})) / nullif(4 * s{w}, 0) as boll_percent_b_{w}d" for w in P.bollinger) + ", "
       + ", ".join(f"(typ - tm{w}) / (0.015::double * nullif(ts{w}, 0)) as cci_approx_{w}d" for w in P.cci)
       + " from (select symbol, date, close, typ, " + ", ".join(
           f"{m} as m{w}, {s} as s{w}" for w, (m, s) in _boll.items()) + ", " + ", ".join(
           f"{roll('avg', 'typ', w, half(w, 5))} as tm{w}, {roll('stddev_samp', 'typ', w, half(w, 5))} as ts{w}"
           for w in P.cci) + f" from (select *, {_typ} as typ from bars))")
def bollinger_cci(spark, sf):
    out = Roller(bars(spark, sf).select("symbol", "date", "high", "low", "close"))
    return out.finish(rolling.bollinger(out, P.bollinger) | rolling.commodity_channel(out, P.cci))


@query("channel_williams", KEY + cols([f"{s}_{w}d" for w in P.channels for s in (
    "channel_pos", "breakout_high", "breakout_low", "williams_r")], 5),
    "select symbol, date, " + ", ".join(
        f"(close - l{w}) / nullif(h{w} - l{w}, 0) as channel_pos_{w}d, close / nullif(h{w}, 0) - 1 as breakout_high_{w}d, "
        f"close / nullif(l{w}, 0) - 1 as breakout_low_{w}d, -100 * (h{w} - close) / nullif(h{w} - l{w}, 0) as williams_r_{w}d"
        for w in P.channels) + " from (select symbol, date, close, " + ", ".join(
        f"{roll('max', 'high', w, half(w, 5))} as h{w}, {roll('min', 'low', w, half(w, 5))} as l{w}" for w in P.channels)
    + " from bars)")
def channel_williams(spark, sf):
    out = Roller(bars(spark, sf).select("symbol", "date", "high", "low", "close"))
    return out.finish(rolling.channels(out, P.channels))


# -- liquidity ----------------------------------------------------------------------------------

def _z(x: str, w: int) -> str:
    return f"({x} - ({roll('avg', x, w, half(w))})) / nullif({roll('stddev_samp', x, w, half(w))}, 0)"


@query("volume_stats", KEY + cols([f"volume_{s}_{w}d" for w in P.volumes for s in ("mean", "z", "ratio", "mom", "vol")], 5)
       + " " + cols([f"dollar_volume_mean_{w}d" for w in P.volumes], 1) + " "
       + cols([f"dollar_volume_z_{w}d" for w in P.volumes], 5),
       "select symbol, date, " + ", ".join(
           f"{roll('avg', 'volume', w, half(w))} as volume_mean_{w}d, {_z('volume', w)} as volume_z_{w}d, "
           f"volume / nullif({roll('avg', 'volume', w, half(w))}, 0) as volume_ratio_{w}d, "
           f"volume / nullif({lagged('volume', w)}, 0) - 1 as volume_mom_{w}d, {roll('stddev_samp', 'vr', w, half(w))} as volume_vol_{w}d, "
           f"{roll('avg', 'dollar_volume', w, half(w))} as dollar_volume_mean_{w}d, {_z('dollar_volume', w)} as dollar_volume_z_{w}d"
           for w in P.volumes) + f" from (select *, volume / nullif({lagged('volume', 1)}, 0) - 1 as vr from panel)")
def volume_stats(spark, sf):
    df = core_prices(spark, sf).select("symbol", "date", "volume", "dollar_volume")
    out = Roller(df.withColumn("_volume_ret", rolling.change("volume", 1)))
    return out.finish(rolling.volume_stats(out, P.volumes))


@query("amihud", KEY + cols([f"amihud_{w}d" for w in P.volumes], 9), "select symbol, date, " + ", ".join(
    f"{roll('avg', 'a', w, half(w))} as amihud_{w}d" for w in P.volumes)
    + " from (select symbol, date, abs(ret_1d) / nullif(dollar_volume, 0) as a from panel)")
def amihud(spark, sf):
    out = Roller(core_prices(spark, sf).select("symbol", "date", "ret_1d", "dollar_volume"))
    return out.finish(rolling.amihud(out, P.volumes))


# -- sequences ----------------------------------------------------------------------------------

@query("sequence_grid", KEY + "history_rows:i label_end_date:d history_close_sum:3 history_from:d future_to:d", f"""
select symbol, date, rn as history_rows, label_end as label_end_date, s as history_close_sum, f as history_from, label_end as future_to
from (select symbol, date, row_number() over (partition by symbol order by date) as rn, {led('date', 12)} as label_end,
             sum(close) {over(26)} as s, min(date) {over(26)} as f from bars) where rn >= 26 and label_end is not null""")
def sequence_grid(spark, sf):
    return rolling.sequence_windows(bars(spark, sf), 26, 12, ["close"]).select(
        "symbol", "date", "history_rows", "label_end_date",
        F.aggregate("history", F.lit(0.0), lambda acc, x: acc + x["close"]).alias("history_close_sum"),
        F.get("history", F.lit(0))["date"].alias("history_from"), F.element_at("future_dates", -1).alias("future_to"))


@query("sequence_splits", "split:s symbols:i rows:i date_min:d date_max:d min_rows_per_symbol:i "
       "median_rows_per_symbol:1 max_rows_per_symbol:i", """
with p as (select * from (values ('train', date '1995-01-01', date '1998-12-31'), ('val', date '1999-01-01', date '1999-12-31'),
                                 ('test', date '2000-01-01', date '2099-12-31')) t(split, a, b)),
     k as (select split, symbol, count(*) as n, min(date) as f, max(date) as l from bars join p on date between a and b
           group by 1, 2 having count(*) >= 40)
select split, count(*) as symbols, sum(n) as rows, min(f) as date_min, max(l) as date_max, min(n) as min_rows_per_symbol,
       median(n) as median_rows_per_symbol, max(n) as max_rows_per_symbol from k group by split""")
def sequence_splits(spark, sf):
    from crosstide.operators.experiments import window_splits
    periods = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"),
               "test": ("2000-01-01", "2099-12-31")}
    return window_splits(bars(spark, sf), periods, 40)
