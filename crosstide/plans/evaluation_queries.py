"""Queries over labelled panels: splits, folds, row budgets, correlation, portfolios, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crosstide.functions.text import agreed_horizon
from crosstide.operators import evaluate, quality, rolling, splits, xsection
from crosstide.plans.base import (
    COST_BPS, EXECUTION_LAG, FIRST_TRAIN_END, HOLDOUT, HORIZON, MIN_NAMES, P, REGIMES_SQL, SHARE,
    STAND_IN_REGIMES, TRAIN_END, VAL_END, bars, groups_of)
from crosstide.plans.feature_queries import KEY, cols
from crosstide.plans.registry import cte, lagged, led, pct_rank_sql, query, seeded_sql
from crosstide.plans.section_queries import targets_panel
from crosstide.session import shared, stage

TARGET, RETURN = f"target_excess_sector_fwd_{HORIZON}d", f"target_ret_fwd_{HORIZON}d"

# -- labelled panel -----------------------------------------------------------------------------

cte("labelled", f"""
select * from (
  select t.symbol, t.date, t.sector, t.{TARGET}, t.{RETURN}, s.mom, -s.ret_1d as reversal, -s.ret_4d as rev_4d, -s.ret_12d as rev_12d, s.log_dollar_volume,
         {led(f't.{TARGET}', EXECUTION_LAG).replace('by symbol order by date', 'by t.symbol order by t.date')} as eval_target,
         {led(f't.{RETURN}', EXECUTION_LAG).replace('by symbol order by date', 'by t.symbol order by t.date')} as eval_return,
         {led('t.date', EXECUTION_LAG + HORIZON).replace('by symbol order by date', 'by t.symbol order by t.date')} as label_end_date
  from targets t join signals s on t.symbol = s.symbol and t.date = s.date)
where eval_target is not null and eval_return is not null and label_end_date is not null""")
cte("raw_split", f"""
select *, case when date <= date '{TRAIN_END}' then 'train' when date <= date '{VAL_END}' then 'val' else 'test' end as split
from labelled""")
cte("purged", f"""
select * from raw_split where label_end_date <= case split when 'train' then date '{TRAIN_END}' when 'val' then date '{VAL_END}'
       else (select max(date) from labelled) end""")
cte("kept", f"""
select p.* from purged p join (select split, date, dense_rank() over (partition by split order by date) as place
                               from (select distinct split, date from purged)) d on p.split = d.split and p.date = d.date
where p.split = 'train' or place > {HORIZON}""")


def labelled(spark, sf, *, write: bool = True) -> DataFrame:
    return shared(spark, "labelled", sf, lambda: _labelled(spark, sf), write=write)


def _labelled(spark, sf) -> DataFrame:
    """Targets, two scores' inputs and execution-lagged labels; incomplete rows removed."""
    df = bars(spark, sf).select("symbol", "date", "close", "volume").withColumns(
        {"log_dollar_volume": F.log1p(F.col("close") * F.col("volume"))} | rolling.forward_returns([HORIZON]) | rolling.simple_returns([1, 4, 12])
        | {"mom": F.try_divide(rolling.lag("close", 4), rolling.lag("close", 12)) - 1})
    df = df.withColumns({"reversal": -F.col("ret_1d"), "rev_4d": -F.col("ret_4d"), "rev_12d": -F.col("ret_12d")})
    df = df.join(groups_of(spark, sf), "symbol", "left")
    # staged, so that the join knows its size and the rows stay dealt out by symbol
    sector_mean = stage(df.where(F.col("sector").isNotNull()).groupBy("date", "sector").agg(F.avg(RETURN).alias("_m")))
    df = df.join(sector_mean, ["date", "sector"], "left").withColumn(TARGET, F.col(RETURN) - F.col("_m")).drop("_m")
    horizon = agreed_horizon(TARGET, RETURN)
    return splits.attach_labels(df, TARGET, RETURN, horizon, EXECUTION_LAG).select(
        "symbol", "date", "sector", "mom", "reversal", "rev_4d", "rev_12d", "log_dollar_volume",
        "eval_target", "eval_return", "label_end_date")


def kept_rows(spark, sf) -> DataFrame:
    return splits.purged_splits(labelled(spark, sf), TRAIN_END, VAL_END, HORIZON)


@query("split_purge_embargo", KEY + "split:s eval_target:6 eval_return:6 label_end_date:d", "select * from kept")
def split_purge_embargo(spark, sf):
    return kept_rows(spark, sf)


_audit = "split:s raw_rows:i kept_rows:i dropped_rows:i dates:i date_min:d date_max:d label_end_max:d"


@query("split_audit", _audit, """
select r.split, r.n as raw_rows, coalesce(k.n, 0) as kept_rows, r.n - coalesce(k.n, 0) as dropped_rows, coalesce(k.dates, 0) as dates,
       date_min, date_max, label_end_max
from (select split, count(*) as n from raw_split group by split) r left join
     (select split, count(*) as n, count(distinct date) as dates, min(date) as date_min, max(date) as date_max,
             max(label_end_date) as label_end_max from kept group by split) k on r.split = k.split""")
def split_audit(spark, sf):
    df = labelled(spark, sf)
    return splits.split_audit(splits.assign_split(df, TRAIN_END, VAL_END),
                              splits.purged_splits(df, TRAIN_END, VAL_END, HORIZON))


_horizons = [1, 4, 12]


@query("purge_by_horizon", "horizon:i split:s raw_rows:i crossing_rows:i", "\nunion all ".join(f"""
select {h} as horizon, split, count(*) as raw_rows, count(*) filter (where label_end > case split when 'train' then date '{TRAIN_END}' else date '{VAL_END}' end) as crossing_rows
from (select date, {led('date', EXECUTION_LAG + h)} as label_end,
             case when date <= date '{TRAIN_END}' then 'train' when date <= date '{VAL_END}' then 'val' else 'test' end as split from bars)
where split <> 'test' and label_end is not null group by split""" for h in _horizons))
def purge_by_horizon(spark, sf):
    df = splits.assign_split(bars(spark, sf).select("symbol", "date"), TRAIN_END, VAL_END)
    ends = df.withColumns({f"h{h}": rolling.lead("date", EXECUTION_LAG + h) for h in _horizons})
    long = ends.select("split", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("end"))
                                                    for h in _horizons])).alias("e")).select("split", "e.*")
    limit = F.when(F.col("split") == "train", splits.as_date(TRAIN_END)).otherwise(splits.as_date(VAL_END))
    return long.where((F.col("split") != "test") & F.col("end").isNotNull()).groupBy("horizon", "split").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("end") > limit).alias("crossing_rows"))


cte("calendar_pos", "select date, row_number() over (order by date) - 1 as pos from (select distinct date from bars)")


@query("calendar_embargo", KEY + "split:s label_end_date:d", f"""
select p.symbol, p.date, p.split, p.label_end_date from purged p join calendar_pos c on p.date = c.date
where p.split = 'train'
   or (p.split = 'val' and c.pos > (select coalesce(max(pos), 0) from calendar_pos where date <= date '{TRAIN_END}') + {HORIZON})
   or (p.split = 'test' and c.pos > (select coalesce(max(pos), 0) from calendar_pos where date <= date '{VAL_END}') + {HORIZON})""")
def calendar_embargo(spark, sf):
    return splits.calendar_embargo(labelled(spark, sf), bars(spark, sf), TRAIN_END, VAL_END, HORIZON)


# -- row budgets over dates ---------------------------------------------------------------------

@query("eval_cap_dates", KEY + "split:s shard:i", """
with v as (select * from kept where split <> 'train' and symbol in (select symbol from (select distinct symbol from kept) order by symbol limit 60)),
     d as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from v)),
     s as (select date from d where pos % 2 = 0 and pos / 2 < 60),
     c as (select v.date, sum(count(*)) over (order by v.date) as cum from v join s on v.date = s.date group by v.date),
     k as (select date, row_number() over (order by date) - 1 as pos from c where cum <= 2000)
select v.symbol, v.date, v.split, k.pos % 3 as shard from v join k on v.date = k.date""")
def eval_cap_dates(spark, sf):
    kept = stage(splits.sample_symbols(kept_rows(spark, sf).select("symbol", "date", "split"), 60))
    rows = kept.where(F.col("split").isin("val", "test"))
    dates = splits.budget_dates(splits.stride_dates(splits.date_counts(rows), 2, 60), 2000)
    return splits.on_dates(rows, splits.shard_dates(dates, 3))


@query("sampled_dates", KEY + "split:s", f"""
with d as (select date, count(*) as n from kept where split = 'train' group by date),
c as (select date from (select date, sum(n) over (order by {seeded_sql(7, 'date')}, date rows unbounded preceding) as upto,
        row_number() over (order by {seeded_sql(7, 'date')}, date) as place from d) where upto <= 5000 or place = 1),
r as (select symbol, date, split from kept where split = 'train' and date in (select date from c))
select * from r where symbol in (select symbol from (select distinct symbol from r) order by {seeded_sql(7, 'symbol')}, symbol limit 50)""")
def sampled_dates(spark, sf):
    train = kept_rows(spark, sf).where(F.col("split") == "train").select("symbol", "date", "split")
    chosen = splits.budget_dates(splits.date_counts(train), 5000, seed=7)
    return splits.sample_symbols(splits.on_dates(train, chosen), 50, seed=7)


# -- folds --------------------------------------------------------------------------------------

cte("folds", f"""
select 'fold_' || row_number() over (order by t) as fold, t as train_end, (t + interval 1 year)::date as val_end
from (select unnest(generate_series(date '{FIRST_TRAIN_END}', date '{HOLDOUT}', interval 1 year))::date as t)
where (t + interval 1 year)::date <= date '{HOLDOUT}'
union all select 'holdout', date '{HOLDOUT}' - 1, date '{HOLDOUT}' - 1""")
cte("fold_raw", """
select f.*, l.symbol, l.date, l.label_end_date,
       case when date <= train_end then 'train' when date <= val_end then 'val' else 'test' end as split
from labelled l cross join folds f""")
cte("fold_purged", """
select *, dense_rank() over (partition by fold, split order by date) as place from fold_raw
where label_end_date <= case split when 'train' then train_end when 'val' then val_end else (select max(date) from labelled) end""")


def all_folds():
    return splits.yearly_folds(FIRST_TRAIN_END, HOLDOUT) + [splits.holdout_fold(HOLDOUT)]


@query("walk_forward_folds", "fold:s " + _audit, f"""
select r.fold, r.split, r.n as raw_rows, coalesce(k.n, 0) as kept_rows, r.n - coalesce(k.n, 0) as dropped_rows, coalesce(k.dates, 0) as dates,
       date_min, date_max, label_end_max
from (select fold, split, count(*) as n from fold_raw group by 1, 2) r left join
     (select fold, split, count(*) as n, count(distinct date) as dates, min(date) as date_min, max(date) as date_max, max(label_end_date) as label_end_max
      from fold_purged where split = 'train' or place > {HORIZON} group by 1, 2) k on r.fold = k.fold and r.split = k.split""")
def walk_forward_folds(spark, sf):
    df = labelled(spark, sf).select("symbol", "date", "label_end_date")
    raw = splits.expand_folds(df, all_folds())
    raw = splits.assign_split(raw, F.col("train_end"), F.col("val_end"))
    return splits.split_audit(raw, splits.fold_splits(df, all_folds(), HORIZON), keys=("fold", "split"))


@query("out_of_fold_schedule", "fold_train_end:d infer_end:d dates:i rows:i date_min:d date_max:d", f"""
with s as (select t as a, least((t + interval 1 year)::date, date '{TRAIN_END}') as b
           from (select unnest(generate_series(date '1995-12-31', date '{TRAIN_END}', interval 1 year))::date as t) where t < date '{TRAIN_END}')
select a as fold_train_end, b as infer_end, count(distinct date) as dates, count(*) as rows, min(date) as date_min, max(date) as date_max
from labelled join s on date > a and date <= b group by 1, 2""")
def out_of_fold_schedule(spark, sf):
    df = labelled(spark, sf).select("symbol", "date")
    steps = splits.out_of_fold_dates(df, "1995-12-31", TRAIN_END)
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return steps.join(per_date, ["date"]).groupBy("fold_train_end", "infer_end").agg(
        F.count("date").alias("dates"), F.sum("n").alias("rows"), F.min("date").alias("date_min"),
        F.max("date").alias("date_max"))


@query("early_stop_split", "date:d in_train:b in_val:b", """
with d as (select distinct date from kept where split = 'train'), m as (select max(date) as hi from d)
select date, date <= (hi - interval 1 year)::date as in_train, date > (hi - interval 1 year)::date as in_val from d, m""")
def early_stop_split(spark, sf):
    # splits, purge and embargo follow from the dates alone: a table of the calendar's size stands for the rows
    pairs = stage(labelled(spark, sf, write=False).select("date", "label_end_date").distinct())
    return splits.early_stop_dates(splits.purged_splits(pairs, TRAIN_END, VAL_END, HORIZON).where(F.col("split") == "train"))


# -- scores and correlation ---------------------------------------------------------------------

cte("scored", f"""
select symbol, date, sector, split, eval_target, eval_return, score, x from (
  select symbol, date, sector, split, eval_target, eval_return, 'baseline_score' as score, {pct_rank_sql('mom', 'date')} as x from kept
  union all
  select symbol, date, sector, split, eval_target, eval_return, 'model_score' as score, reversal as x from kept) where split <> 'train'""")

RUN = ["score", "split"]
_run = "score:s split:s "


def scored(spark, sf) -> DataFrame:
    return shared(spark, "scored", sf, lambda: _scored(spark, sf))


def _scored(spark, sf) -> DataFrame:
    """Validation and test rows in long form: one row per score (momentum rank, reversal)."""
    kept = kept_rows(spark, sf).where(F.col("split") != "train")
    kept = kept.select("symbol", "date", "sector", "split", "eval_target", "eval_return", "mom",
                       F.col("reversal").alias("model_score"))
    kept = xsection.pct_ranks(kept, ["date"], ["mom"], "cs")
    kept = kept.withColumnRenamed("cs_rank_mom", "baseline_score")
    return evaluate.long_scores(kept, ["baseline_score", "model_score"],
                                ["symbol", "date", "sector", "split", "eval_target", "eval_return"])


def ic_sql(keys: str, source: str, x: str = "x", target: str = "eval_target", names: int = MIN_NAMES) -> str:
    return f"""
select {keys}, date, corr(rx, rt) as rank_ic, corr(x_, t_) as ic, count(*) as n from (
  select {keys}, date, {x} as x_, {target} as t_,
         rank() over (partition by {keys}, date order by {x}) + (count(*) over (partition by {keys}, date, {x}) - 1) / 2.0::double as rx,
         rank() over (partition by {keys}, date order by {target}) + (count(*) over (partition by {keys}, date, {target}) - 1) / 2.0::double as rt
  from {source} where {x} is not null and {target} is not null)
group by {keys}, date having count(*) >= {names}"""


cte("daily_ic", f"""
select score, split, date, case when isnan(rank_ic) then null else rank_ic end as rank_ic, case when isnan(ic) then null else ic end as ic, n
from ({ic_sql('score, split', 'scored')})""")


@query("rank_ic", _run + "date:d rank_ic:6 ic:6 n:i", "select * from daily_ic")
def rank_ic(spark, sf):
    return evaluate.rank_ic(scored(spark, sf), RUN, "x", "eval_target", MIN_NAMES)


def flagship(spark, sf, min_names: int = MIN_NAMES) -> DataFrame:
    """Rank correlation per date of skip momentum with the lagged forward label, after purge and embargo."""
    return evaluate.rank_ic(scored(spark, sf), RUN, "x", "eval_target", min_names)


cte("placed", f"""
select *, floor(greatest(n * {SHARE}::double, 1)) as k from (
  select *, row_number() over (partition by score, split, date order by x, symbol) as place, count(*) over (partition by score, split, date) as n
  from scored where x is not null and eval_target is not null) where n >= {MIN_NAMES}""")
cte("spread", """
select score, split, date, avg(eval_target) filter (where place > n - k) as top_mean, avg(eval_target) filter (where place <= k) as bottom_mean,
       avg(eval_target) filter (where place > n - k) - avg(eval_target) filter (where place <= k) as top_bottom_spread,
       max(n) as n, max(k) as bucket_size from placed group by 1, 2, 3""")


@query("decile_spread", _run + "date:d top_mean:6 bottom_mean:6 top_bottom_spread:6 n:i bucket_size:i", "select * from spread")
def decile_spread(spark, sf):
    return evaluate.decile_spread(scored(spark, sf), RUN, "x", "eval_target", SHARE, MIN_NAMES)


# -- portfolios ---------------------------------------------------------------------------------

def weights_sql(source: str, keys: str) -> str:
    return f"""
select {keys}, date, symbol, eval_return, (case when place > n - k then 0.5::double / k else 0 end) - (case when place <= k then 0.5::double / k else 0 end) as weight
from (select *, floor(greatest(n * {SHARE}::double, 1)) as k from (
        select *, row_number() over (partition by {keys}, date order by x, symbol) as place, count(*) over (partition by {keys}, date) as n
        from {source} where x is not null))
where n >= {MIN_NAMES} and (place > n - k or place <= k)"""


@query("ls_weights", _run + "date:d symbol:i weight:8", weights_sql("scored", "score, split"))
def ls_weights(spark, sf):
    return evaluate.long_short_weights(scored(spark, sf), RUN, "x", SHARE, MIN_NAMES)


_need = max(10, int(MIN_NAMES * SHARE))


@query("sector_neutral_weights", _run + "date:d symbol:i sector:s weight:8", f"""
with p as (select *, floor(greatest(n * {SHARE}::double, 1)) as k from (
             select *, row_number() over (partition by score, split, date, sector order by x, symbol) as place,
                    count(*) over (partition by score, split, date, sector) as n from scored where x is not null and sector is not null)),
     u as (select * from p where n >= {_need} and n >= 2 * k),
     s as (select score, split, date, count(distinct sector) as parts from u group by 1, 2, 3)
select u.score, u.split, u.date, u.symbol, u.sector,
       (case when place > n - k then 0.5::double / parts / k else 0 end) - (case when place <= k then 0.5::double / parts / k else 0 end) as weight
from u join s on u.score = s.score and u.split = s.split and u.date = s.date where place > n - k or place <= k""")
def sector_neutral_weights(spark, sf):
    return evaluate.sector_neutral_weights(scored(spark, sf), RUN, "x", SHARE, MIN_NAMES)


def backtest_ctes(source: str, keys: str, prefix: str) -> None:
    """Shared tables ``{prefix}_bt``: the per-period backtest of a long score table."""
    k = [c.strip() for c in keys.split(",")]
    same = " and ".join(f"a.{c} = b.{c}" for c in k)
    cte(f"{prefix}_rows", f"""
select s.* from {source} s join (
  select *, row_number() over (partition by {keys} order by date) - 1 as pos from (select distinct {keys}, date from {source})) d
  on {' and '.join(f's.{c} = d.{c}' for c in k)} and s.date = d.date
where d.pos % {HORIZON} = 0 and x is not null and sector is not null and eval_return is not null""")
    cte(f"{prefix}_w", weights_sql(f"{prefix}_rows", keys))
    cte(f"{prefix}_d", f"select *, row_number() over (partition by {keys} order by date) as r from (select distinct {keys}, date from {prefix}_w)")
    cte(f"{prefix}_m", f"""
select {keys}, r, symbol, sum(w) as d from (
  select {', '.join(f'a.{c}' for c in k)}, b.r, a.symbol, a.weight as w from {prefix}_w a join {prefix}_d b on {same} and a.date = b.date
  union all select {', '.join(f'a.{c}' for c in k)}, b.r + 1, a.symbol, -a.weight from {prefix}_w a join {prefix}_d b on {same} and a.date = b.date)
group by {keys}, r, symbol""")
    cte(f"{prefix}_bt", f"""
select *, product(1 + gross_return) over (partition by {keys} order by date) as equity_gross,
       product(1 + net_return) over (partition by {keys} order by date) as equity_net
from (select *, gross_return - cost as net_return from (
  select a.*, t.turnover, t.turnover * {COST_BPS}::double / 10000 as cost
  from (select {keys}, date, sum(weight * eval_return) as gross_return, count(*) filter (where weight <> 0) as n_positions,
               sum(abs(weight)) as gross_exposure, sum(weight) as net_exposure from {prefix}_w group by {keys}, date) a
  join {prefix}_d b on {same} and a.date = b.date
  join (select {keys}, r, sum(abs(d)) / 2 as turnover from {prefix}_m group by {keys}, r) t
    on {' and '.join(f'a.{c} = t.{c}' for c in k)} and b.r = t.r))""")


backtest_ctes("scored", "score, split", "run")
_bt = ("gross_return:6 turnover:6 cost:8 net_return:6 n_positions:i gross_exposure:6 net_exposure:6 "
       "equity_gross:e equity_net:e")
BT = dict(share=SHARE, every=HORIZON, cost_bps=COST_BPS, min_names=MIN_NAMES)
PERIODS_PER_YEAR = 252.0 / HORIZON


@query("backtest", _run + "date:d " + _bt, "select * from run_bt")
def backtest(spark, sf):
    return evaluate.backtest(scored(spark, sf), RUN, "x", "eval_return", **BT)


def bt_summary_sql(keys: str, bt: str) -> str:
    p = f"{PERIODS_PER_YEAR}::double"
    return f"""
select {keys}, count(net_return) as periods, avg(net_return) as mean_period_return_net, avg(net_return) * {p} as ann_return_net,
       stddev_samp(net_return) * sqrt({p}) as ann_vol_net,
       avg(net_return) * {p} / (stddev_samp(net_return) * sqrt({p}) + 1e-12) as sharpe_net, min(dd) as max_drawdown_net,
       avg(turnover) as avg_turnover, avg(cost) as avg_cost, arg_max(equity_net, date) as final_equity_net
from (select *, equity_net / max(equity_net) over (partition by {keys} order by date) - 1 as dd from {bt}) group by {keys}"""


_bts = ("periods:i mean_period_return_net:6 ann_return_net:5 ann_vol_net:5 sharpe_net:6 max_drawdown_net:6 avg_turnover:6 "
        "avg_cost:8 final_equity_net:e")


@query("backtest_summary", _run + _bts + " suspect:b",
       f"select *, coalesce(sharpe_net > 3.0, false) as suspect from ({bt_summary_sql('score, split', 'run_bt')})")
def backtest_summary(spark, sf):
    bt = evaluate.backtest(scored(spark, sf), RUN, "x", "eval_return", **BT)
    out = evaluate.backtest_summary(bt, RUN, PERIODS_PER_YEAR)
    return out.withColumn("suspect", evaluate.suspect("sharpe_net", F.lit(None).cast("double")))


def ic_summary_sql(keys: str, ic: str, horizon: str = str(HORIZON)) -> str:
    def ir(x: str, periods: str) -> str:
        return f"avg({x}) / (stddev_samp({x}) + 1e-12) * sqrt({periods})"
    adj = f"252.0::double / max({horizon})"
    return f"""
select {keys}, avg(rank_ic) as mean_rank_ic, avg(ic) as mean_ic, stddev_samp(rank_ic) as rank_ic_std, stddev_samp(ic) as ic_std,
       {ir('no_r', adj)} as rank_ic_ir, {ir('no_i', adj)} as ic_ir, {ir('rank_ic', '252.0::double')} as rank_ic_ir_raw,
       {ir('ic', '252.0::double')} as ic_ir_raw, count(rank_ic) as ic_dates, count(no_r) as ic_dates_nonoverlap
from (select *, case when rank_ic is not null and (pr - 1) % {horizon} = 0 then rank_ic end as no_r,
             case when ic is not null and (pi - 1) % {horizon} = 0 then ic end as no_i
      from (select *, count(rank_ic) over (partition by {keys} order by date rows unbounded preceding) as pr,
                   count(ic) over (partition by {keys} order by date rows unbounded preceding) as pi from {ic})) group by {keys}"""


_ics = ("mean_rank_ic:6 mean_ic:6 rank_ic_std:6 ic_std:6 rank_ic_ir:5 ic_ir:5 rank_ic_ir_raw:5 ic_ir_raw:5 ic_dates:i "
        "ic_dates_nonoverlap:i")


@query("ic_summary", _run + _ics + " simple_ir:5", f"""
select s.*, q.simple_ir from ({ic_summary_sql('score, split', 'daily_ic')}) s join (
  select score, split, avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12) * sqrt(252.0::double) as simple_ir from daily_ic group by 1, 2) q
on s.score = q.score and s.split = q.split""")
def ic_summary(spark, sf):
    ic = rank_ic(spark, sf)
    simple = evaluate.simple_ic_summary(ic, RUN).select(*RUN, F.col("rank_ic_ir").alias("simple_ir"))
    return evaluate.ic_summary(ic, RUN, HORIZON).join(simple, RUN)


@query("spread_summary", _run + "mean_top_bottom_spread:6 spread_std:6 spread_ir:5 spread_dates:i", f"""
select score, split, avg(top_bottom_spread) as mean_top_bottom_spread, stddev_samp(top_bottom_spread) as spread_std,
       avg(top_bottom_spread) / (stddev_samp(top_bottom_spread) + 1e-12) * sqrt({PERIODS_PER_YEAR}::double) as spread_ir,
       count(top_bottom_spread) as spread_dates from spread group by 1, 2""")
def spread_summary(spark, sf):
    return evaluate.spread_summary(decile_spread(spark, sf), RUN, PERIODS_PER_YEAR)


cte("regime_scored", f"""
select s.*, g.regime from scored s join (values {REGIMES_SQL}) g(regime, a, b) on s.date between g.a and g.b""")
cte("regime_ic", f"""
select score, split, regime, date, case when isnan(rank_ic) then null else rank_ic end as rank_ic,
       case when isnan(ic) then null else ic end as ic, n from ({ic_sql('score, split, regime', 'regime_scored')})""")
backtest_ctes("regime_scored", "score, split, regime", "reg")
cte("reg_spread", f"""
select score, split, regime, date, avg(eval_target) filter (where place > n - k) - avg(eval_target) filter (where place <= k) as s
from (select *, floor(greatest(n * {SHARE}::double, 1)) as k from (
        select *, row_number() over (partition by score, split, regime, date order by x, symbol) as place,
               count(*) over (partition by score, split, regime, date) as n from regime_scored where x is not null and eval_target is not null)
      where n >= {MIN_NAMES}) group by 1, 2, 3, 4""")
_RK = "score, split, regime"


def _on(a: str, b: str) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in ("score", "split", "regime"))


@query("regime_metrics", _run + "regime:s rows:i dates:i " + _ics + " mean_top_bottom_spread:6 spread_std:6 spread_ir:5 "
       "spread_dates:i " + _bts + " suspect_overfit_or_leak:b", f"""
select c.*, i.* exclude ({_RK}), s.* exclude ({_RK}), b.* exclude ({_RK}),
       coalesce(sharpe_net > 3.0, false) or coalesce(rank_ic_ir > 5.0, false) as suspect_overfit_or_leak
from (select {_RK}, count(*) as rows, count(distinct date) as dates from regime_scored group by 1, 2, 3) c
left join ({ic_summary_sql(_RK, 'regime_ic')}) i on {_on('c', 'i')}
left join (select {_RK}, avg(s) as mean_top_bottom_spread, stddev_samp(s) as spread_std,
                  avg(s) / (stddev_samp(s) + 1e-12) * sqrt({PERIODS_PER_YEAR}::double) as spread_ir, count(s) as spread_dates
           from reg_spread group by 1, 2, 3) s on {_on('c', 's')}
left join ({bt_summary_sql(_RK, 'reg_bt')}) b on {_on('c', 'b')}""")
def regime_metrics(spark, sf):
    tagged = evaluate.in_regimes(scored(spark, sf), STAND_IN_REGIMES)
    return evaluate.score_metrics(tagged, RUN + ["regime"], "x", "eval_target", "eval_return", horizon=HORIZON, **BT)


# -- many horizons ------------------------------------------------------------------------------

_families = ["ret", "excess_market", "rank", "excess_sector"]
_pairs = [(f, h) for h in P.targets for f in _families]
cte("multi", "select * from (" + "\nunion all ".join(f"""
select t.symbol, t.date, '{f}' as target_family, {h} as horizon, -r.ret_{h}d as x, t.target_{f}_fwd_{h}d as y,
       case when t.date <= date '{TRAIN_END}' then 'train' when t.date <= date '{VAL_END}' then 'val' else 'test' end as split
from targets t join rets r on t.symbol = r.symbol and t.date = r.date
where not ({' and '.join(f't.target_{a}_fwd_{b}d is null' for a, b in _pairs)})""" for f, h in _pairs) + ") where split <> 'train'")


@query("multi_horizon_eval", "horizon:i target_family:s split:s mean_rank_ic:6 rank_ic_std:6 rank_ic_ir:5 dates:i rows:i", f"""
with ic as ({ic_sql('horizon, target_family, split', 'multi', 'x', 'y')}),
     n as (select horizon, target_family, split, count(*) filter (where x is not null and y is not null) as rows from multi group by 1, 2, 3)
select n.*, m, s, m / (s + 1e-12) * sqrt(252.0::double) as rank_ic_ir, coalesce(d, 0) as dates, m as mean_rank_ic, s as rank_ic_std
from n left join (select horizon, target_family, split, avg(rank_ic) as m, stddev_samp(rank_ic) as s, count(rank_ic) as d from ic group by 1, 2, 3) i
on n.horizon = i.horizon and n.target_family = i.target_family and n.split = i.split""")
def multi_horizon_eval(spark, sf):
    df = splits.assign_split(targets_panel(spark, sf), TRAIN_END, VAL_END).where(F.col("split").isin("val", "test"))
    df = df.dropna(how="all", subset=[f"target_{f}_fwd_{h}d" for f, h in _pairs])
    predictions = bars(spark, sf).select("symbol", "date", "close").withColumns(rolling.simple_returns(P.targets)).select(
        "symbol", "date", *[(-F.col(f"ret_{h}d")).alias(f"pred_{h}") for h in P.targets])
    joined = stage(predictions.join(df, ["symbol", "date"]))
    long = joined.select("symbol", "date", "split", F.explode(F.array(*[
        F.struct(F.lit(f).alias("target_family"), F.lit(h).alias("horizon"), F.col(f"pred_{h}").alias("x"),
                 F.col(f"target_{f}_fwd_{h}d").alias("y")) for f, h in _pairs])).alias("_e")).select(
        "symbol", "date", "split", "_e.*")
    keys = ["horizon", "target_family", "split"]
    ic = evaluate.rank_ic(long, keys, "x", "y", MIN_NAMES)
    rows = long.groupBy(*keys).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("rows"))
    return rows.join(evaluate.simple_ic_summary(ic, keys), keys, "left").fillna(0, ["dates"])


# -- diagnostics --------------------------------------------------------------------------------

cte("diag", f"""
select symbol, date, close, {lagged('close', 1)} as close_lag1, close / nullif({lagged('close', 1)}, 0) - 1 as simple_ret,
       ln(close) - ln({lagged('close', 1)}) as log_ret from bars""")


@query("return_distribution", "kind:s mean:6 std:6 min:6 max:5 n:i simple_minus_log_abs_mean:6", """
select *, (select avg(abs(simple_ret - log_ret)) from diag) as simple_minus_log_abs_mean from (
  select 'simple_ret' as kind, avg(simple_ret) as mean, stddev_samp(simple_ret) as std, min(simple_ret) as min, max(simple_ret) as max, count(simple_ret) as n from diag
  union all select 'log_ret', avg(log_ret), stddev_samp(log_ret), min(log_ret), max(log_ret), count(log_ret) from diag)""")
def return_distribution(spark, sf):
    return quality.return_distribution(quality.with_diagnostic_returns(bars(spark, sf)))


cte("auto", """
select symbol, count(r) as n, corr(r, r1) as ret_autocorr_lag1, corr(a, a1) as abs_ret_autocorr_lag1, corr(a, a5) as abs_ret_autocorr_lag5
from (select symbol, r, abs(r) as a, lag(r) over w as r1, lag(abs(r)) over w as a1, lag(abs(r), 5) over w as a5
      from (select symbol, date, log_ret as r from diag where log_ret is not null) window w as (partition by symbol order by date))
group by symbol having count(r) >= 252""")


@query("autocorr", "symbol:i n:i ret_autocorr_lag1:6 abs_ret_autocorr_lag1:6 abs_ret_autocorr_lag5:6", "select * from auto")
def autocorr(spark, sf):
    return quality.symbol_autocorrelation(quality.with_diagnostic_returns(bars(spark, sf)), "log_ret", 252)


@query("autocorr_overview", "symbols:i mean_ret_autocorr_lag1:6 mean_abs_ret_autocorr_lag1:6 mean_abs_ret_autocorr_lag5:6 "
       "median_ret_autocorr_lag1:6 median_abs_ret_autocorr_lag1:6", """
select count(*) as symbols, avg(ret_autocorr_lag1) as mean_ret_autocorr_lag1, avg(abs_ret_autocorr_lag1) as mean_abs_ret_autocorr_lag1,
       avg(abs_ret_autocorr_lag5) as mean_abs_ret_autocorr_lag5, median(ret_autocorr_lag1) as median_ret_autocorr_lag1,
       median(abs_ret_autocorr_lag1) as median_abs_ret_autocorr_lag1 from auto""")
def autocorr_overview(spark, sf):
    return quality.autocorrelation_overview(autocorr(spark, sf))


_mk = """
with d as (select date, avg(log_ret) as m from diag group by date),
     s as (select date, abs(m) as a, case when count(m) over w >= 20 then stddev_samp(m) over w * sqrt(252.0::double) end as v
           from d window w as (order by date rows between 19 preceding and current row))"""


@query("market_vol_clustering", "series:s lag:i autocorr:6 n:i", _mk + "\nunion all ".join(
    f"{'' if i else ', t as (select 1) '}select '{name}' as series, {k} as lag, corr(x, y) as autocorr, count(*) as n from "
    f"(select x, lag(x, {k}) over (order by date) as y from (select date, {c} as x from s where {c} is not null)) where y is not null"
    for i, (name, c, k) in enumerate([("market_abs_ret", "a", 1), ("market_abs_ret", "a", 5),
                                      ("market_realized_vol", "v", 1), ("market_realized_vol", "v", 5)])))
def market_vol_clustering(spark, sf):
    series = quality.market_series(quality.with_diagnostic_returns(bars(spark, sf)))
    return quality.market_autocorrelation(series)


cte("raw_pred", "\nunion all ".join(f"""
select d.symbol, d.date, '{s}' as score, '{f}' as target, d.{s} as x, t.target_{f}_fwd_1d as y
from diag d join targets t on d.symbol = t.symbol and d.date = t.date""" for s in ("close", "close_lag1", "log_ret") for f in _families))


@query("raw_predictability", "score:s target:s mean_rank_ic:6 rank_ic_std:6 rank_ic_ir:5 dates:i", f"""
select score, target, avg(rank_ic) as mean_rank_ic, stddev_samp(rank_ic) as rank_ic_std,
       avg(rank_ic) / (stddev_samp(rank_ic) + 1e-12) * sqrt(252.0::double) as rank_ic_ir, count(rank_ic) as dates
from ({ic_sql('score, target', 'raw_pred', 'x', 'y')}) group by 1, 2""")
def raw_predictability(spark, sf):
    diag = quality.with_diagnostic_returns(bars(spark, sf).withColumns(rolling.forward_returns([1])))
    diag = diag.select("symbol", "date", "close", "close_lag1", "log_ret", "target_ret_fwd_1d").join(groups_of(spark, sf), "symbol", "left")
    labels = xsection.relative_targets(stage(diag), [1])
    scores = ["close", "close_lag1", "log_ret"]
    pairs = [(s, f"target_{f}_fwd_1d") for s in scores for f in _families]
    ic = evaluate.rank_ics(stage(labels.select("date", *scores, *[t for _, t in pairs[:len(_families)]])), [], pairs, MIN_NAMES)
    names = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(f).alias("target")) for s in scores for f in _families])
    ic = ic.withColumn("_e", names[F.col("_run")]).select("_e.*", "date", "rank_ic")
    return evaluate.simple_ic_summary(ic, ["score", "target"])
