"""Shared inputs of the registered queries: bars, companies and the joined panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosstide.functions.text import STATE_REGION
from crosstide.operators import rolling
from crosstide.operators.profile import WEEKLY
from crosstide.plans.registry import cte
from crosstide.session import shared
from crosstide.sources import tables

P = WEEKLY

# Settings of the stand-in panel.
TRAIN_END, VAL_END = "1998-12-31", "1999-12-31"
FIRST_TRAIN_END, HOLDOUT = "1997-12-31", "2001-01-01"
MIN_NAMES = 20
HORIZON, EXECUTION_LAG = 4, 1
SHARE, COST_BPS = 0.10, 5.0
STAND_IN_REGIMES = {"year_1998": ("1998-01-01", "1998-12-31"), "year_1999": ("1999-01-01", "1999-12-31"),
                    "year_2000": ("2000-01-01", "2000-12-31")}
REGIMES_SQL = ", ".join(f"('{n}', date '{a}', date '{b}')" for n, (a, b) in STAND_IN_REGIMES.items())


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly bars, written once per session: most queries read them, some several times."""
    return shared(spark, "bars", sf, lambda: tables.weekly_bars(spark, sf))


def company_dim(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dimension(tables.companies(spark, sf))


def groups_of(spark: SparkSession, sf: str) -> DataFrame:
    """Symbol with its sector and sub-industry only."""
    return tables.companies(spark, sf).select("symbol", "sector", "sub_industry")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with price state, one-step return and groups."""
    df = bars(spark, sf).withColumns(rolling.price_state())
    df = df.withColumns(rolling.simple_returns([1]))
    return df.join(groups_of(spark, sf), "symbol", "left")


cte("bars", """
select l_suppkey as symbol, date_trunc('week', l_shipdate)::date as date,
       arg_min(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as open,
       max(l_extendedprice) as high, min(l_extendedprice) as low,
       arg_max(l_extendedprice, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) as close,
       sum(l_quantity)::double as volume
from lineitem group by 1, 2""")

_states = ", ".join(f"'{s}'" for s in tables.STAND_IN_STATES)
cte("companies", f"""
select s_suppkey as symbol, s_name as company, r_name as sector, n_name as sub_industry,
       case when s_suppkey % 11 = 3 then n_name when s_suppkey % 13 = 5 then n_name || ' , Canada'
            else n_name || ', ' || [{_states}][s_suppkey % {len(tables.STAND_IN_STATES)} + 1] end as headquarters,
       (1950 + s_suppkey % 70)::bigint::varchar || ' (' || (1900 + s_suppkey % 50)::bigint::varchar || ')' as founded,
       date '1995-01-01' + (s_suppkey % 700)::int as date_added
from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")

_regions = ", ".join(f"'{s}': '{STATE_REGION[s]}'" for s in tables.STAND_IN_STATES)
cte("located", f"""
select *, case when hq_state = 'Unknown' then 'Unknown'
               else coalesce(map {{{_regions}}}[hq_state], 'Non-US') end as hq_region
from (select *, case when len(parts) >= 2 then parts[-1] else 'Unknown' end as hq_state,
             coalesce(parts[1], 'Unknown') as hq_city
      from (select *, list_filter(list_transform(string_split(headquarters, ','), lambda x: trim(x)), lambda x: x <> '') as parts
            from companies))""")

cte("panel", """
select b.*, b.close * b.volume as dollar_volume, ln(1 + greatest(b.close * b.volume, 0)) as log_dollar_volume,
       b.close / nullif(lag(b.close) over (partition by b.symbol order by b.date), 0) - 1 as ret_1d,
       c.sector, c.sub_industry
from bars b left join companies c on b.symbol = c.symbol""")


def with_ret(df: DataFrame) -> DataFrame:
    return df.withColumns(rolling.simple_returns([1]))


def core_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the one-step return and dollar volume, the input of the rolling families."""
    df = bars(spark, sf).withColumns({
        "dollar_volume": F.col("close") * F.col("volume"),
        **rolling.simple_returns([1])})
    return df.withColumn("log_dollar_volume", F.log1p("dollar_volume"))
