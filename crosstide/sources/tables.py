"""Readers of the given tables and the panels derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosstide.functions.numeric import finite
from crosstide.functions.text import clean_symbol, earliest_year, first_year, headquarters_parts, UNKNOWN
from crosstide.operators.ranking import with_position
from crosstide.session import stage

ORDER_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
GROUP_LEVELS = ["sector", "sub_industry", "hq_city", "hq_state", "hq_region"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open/high/low/close/volume per supplier and week.

    Every aggregate combines on the map side, so a supplier or week that holds much of the table
    shuffles one partial row per task. The result is unique in (symbol, date).
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *ORDER_KEY)
    price = F.col("l_extendedprice")
    rows = lines.select(F.col("l_suppkey").alias("symbol"),
                        F.trunc(F.to_date("l_shipdate"), "week").alias("date"), price, "l_quantity", line_order().alias("at"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by(price, "at").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, "at").alias("close"), F.sum("l_quantity").cast("double").alias("volume"))


def line_order() -> Column:
    """Date, order, line, part and price in cents as one number of 38 digits.

    A hash aggregate can keep the least and greatest number, which it cannot of a struct: that would
    sort the whole scan first. A part that outgrows its digits raises an error.
    """
    first = F.unix_date(F.to_date("l_shipdate"))
    parts = [(F.col("l_orderkey"), 12), (F.col("l_linenumber"), 2), (F.col("l_partkey"), 10), (F.round(F.col("l_extendedprice") * 100), 9)]
    return packed(first, parts)


def packed(first: Column, parts: list[tuple[Column, int]]) -> Column:
    """Whole numbers of known digits side by side in one decimal."""
    out = first.cast("decimal(38,0)")
    for part, digits in parts:
        out = (out * F.lit(10 ** digits).cast(f"decimal({digits + 1},0)")).cast("decimal(38,0)") + part.cast(f"decimal({digits},0)")
        out = out.cast("decimal(38,0)")
    return out


# States used for the stand-in headquarters, by key modulo their number.
STAND_IN_STATES = ["California", "Texas", "New York", "Illinois", "Georgia", "Washington"]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with nation and region as a company table."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    state = F.element_at(F.array(*[F.lit(x) for x in STAND_IN_STATES]),
                         (key % len(STAND_IN_STATES) + 1).cast("int"))
    head = (F.when(key % 11 == 3, F.col("n_name"))
            .when(key % 13 == 5, F.concat(F.col("n_name"), F.lit(" , Canada")))
            .otherwise(F.concat(F.col("n_name"), F.lit(", "), state)))
    founded = F.concat((F.lit(1950) + key % 70).cast("string"), F.lit(" ("),
                       (F.lit(1900) + key % 50).cast("string"), F.lit(")"))
    return (s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
            .select(key.alias("symbol"), F.col("s_name").alias("company"), F.col("r_name").alias("sector"),
                    F.col("n_name").alias("sub_industry"), head.alias("headquarters"),
                    founded.alias("founded"),
                    F.date_add(F.lit("1995-01-01").cast("date"), (key % 700).cast("int")).alias("date_added")))


def dimension(raw: DataFrame) -> DataFrame:
    """Company dimension: unknown fill, years, headquarters parts, codes and group sizes.

    One row per entity. One aggregate counts the members of every (level, value); a value's code is
    its place among the sorted values of its level. Both are joined back by value.
    """
    filled = raw.fillna(UNKNOWN, ["sector", "sub_industry", "company"])
    parts = headquarters_parts("headquarters")
    base = filled.select("symbol", "company", "sector", "sub_industry", F.to_date("date_added").alias("date_added"),
                         first_year("founded").cast("double").alias("founded_year"),
                         earliest_year("founded").cast("double").alias("legacy_founded_year"),
                         *[c.alias(n) for n, c in parts.items()])
    base = stage(base)
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("level"), F.col(g).alias("value")) for g in GROUP_LEVELS]))
    groups = base.select("symbol", pairs.alias("_g")).groupBy("_g.level", "_g.value").agg(F.count("symbol").alias("n"))
    groups = stage(with_position(groups, ["level"], "value", "value", "place"))
    for level in GROUP_LEVELS:
        own = groups.where(F.col("level") == level).select(
            F.col("value").alias(level), F.col("n").alias(f"{level}_n_companies"),
            (F.col("place") - 1).alias(f"{level}_code"))
        base = base.join(own, level, "left")
    return base


def panel(bars: DataFrame, dim: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bars left-joined to the dimension; broadcast only when Spark measures it as small."""
    side = dim if columns is None else dim.select("symbol", *columns)
    return bars.join(side, "symbol", "left")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel shape: one bar per user and day from the event stream table."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    at = packed(F.unix_micros(F.col("ts").cast("timestamp")), [(F.col("event_id"), 18)])
    rows = e.select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), "value", at.alias("at"))
    return rows.groupBy("symbol", "date").agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def scope(df: DataFrame, *, start: str | None = None, end: str | None = None,
          min_history: int = 0, max_symbols: int | None = None) -> DataFrame:
    """Date range, then minimum history, then the first symbols in sorted order."""
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if min_history > 0:
        long_enough = df.groupBy("symbol").agg(F.count("date").alias("_n")).where(F.col("_n") >= min_history)
        df = df.join(long_enough.select("symbol"), "symbol", "left_semi")
    if max_symbols:
        first = df.select("symbol").distinct().orderBy("symbol").limit(max_symbols)
        df = df.join(first, "symbol", "left_semi")
    return df


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
                  F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def clean_bars(df: DataFrame) -> DataFrame:
    """Symbols normalised and non-finite numbers turned into NULL."""
    numbers = [c for c in ("open", "high", "low", "close", "adj_close", "volume") if c in df.columns]
    return df.withColumns({"symbol": clean_symbol("symbol"), **{c: finite(F.col(c).cast("double")) for c in numbers}})


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``; a map-side ``max_by``, so duplicate piles never gather.

    Every column takes the value beside the greatest order, which all of them meet in the same row.
    With one order column of plain numbers or dates this stays in a hash aggregate.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    newest = df.groupBy(*keys).agg(*[F.max_by(F.col(c), at).alias(c) for c in rest])
    return newest.select(*df.columns)


def bad_bar():
    """Condition for an unusable bar: missing core field, non-positive price or volume, inversion."""
    core = ["date", "symbol", "open", "high", "low", "close", "volume"]
    missing = F.col(core[0]).isNull()
    for c in core[1:]:
        missing = missing | F.col(c).isNull()
    return missing | non_positive("close") | non_positive("volume") | inverted()


def non_positive(c: str):
    return F.coalesce(F.col(c) <= 0, F.lit(False))


def inverted():
    top = F.col("high") < F.greatest("open", "close", "low")
    floor = F.col("low") > F.least("open", "close", "high")
    return F.coalesce(top, F.lit(False)) | F.coalesce(floor, F.lit(False))


def without_bad_bars(df: DataFrame) -> DataFrame:
    return df.where(~bad_bar())
