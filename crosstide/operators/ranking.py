"""Exact per-group ranks, positions and quantiles by range sort; no group has to fit one task.

A cross-section (one date, or one date and sector) has no size limit of its own, and one date may hold a third of
the rows. Groups are counted first. Those of up to ``GROUP_ROWS`` rows share one shuffle by group and are ranked by
windows. The rows of larger ones are sorted over the whole cluster by (group, value): ``repartitionByRange`` cuts the
order into parts of about equal size wherever the cuts fall, and a row's number in its part is its local place. A
small table of counts per part and group turns local places into places in the group. The sorted rows are
staged, so that parts and places stay as they are however often tasks are run again. Quantiles come from counts, without a sort.

Ties: rows with one value are neighbours in one part, where a window over (group, value) needs no further
shuffle, as it asks for what the range partitioning gives already. Doubles take part as order-preserving longs,
since Spark would normalise (and shuffle again by) a floating-point window key. A value that a sample of the
rows finds very often is dealt to several sub-runs, whose counts are put together from a table of such values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from crosstide.session import stage

GROUP_ROWS = 250_000        # a group that one task ranks in memory
PART_BITS = 33              # monotonically_increasing_id: number of the part above, number of the row below
# Layout only: values with so many rows in this share of the rows are dealt to sub-runs.
SAMPLE, HOT, HOT_MOST, SUB_RUNS = 1 / 64, 1024, 1000, 64
FINENESS = (1, 4096)        # parts of the value range per doubling, by the steps of the quantiles; the last step has each value by itself


def order_code(c: Column) -> Column:
    """A long that orders and equals as the double does (negative and positive zero are equal)."""
    x = F.abs(c.cast("double"))
    # the logarithm may be off by one next to a power of two; halving and doubling are exact
    e = F.least(F.greatest(F.floor(F.log2(x)), F.lit(-1022)), F.lit(1023))
    m = x / F.pow(F.lit(2.0), e)
    code = (F.when(x >= F.lit(float("inf")), F.when(F.isnan(x), F.lit(2047 * 2 ** 52 + 1)).otherwise(F.lit(2047 * 2 ** 52)))
            .when(m >= 2, (e + 1024) * F.lit(2 ** 52) + ((m / 2 - 1) * F.lit(2.0 ** 52)).cast("long"))
            .when(m < 1, F.when(e > -1022, (e + 1022) * F.lit(2 ** 52) + ((m * 2 - 1) * F.lit(2.0 ** 52)).cast("long"))
                  .otherwise((x * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")))
            .otherwise((e + 1023) * F.lit(2 ** 52) + ((m - 1) * F.lit(2.0 ** 52)).cast("long")))
    return F.when(c == 0, F.lit(0).cast("long")).when(c < 0, -code).when(c.isNotNull(), code)


def _match(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def _sorted(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Rows over the cluster in the order of ``columns`` and ``order``, numbered within their part."""
    by = [*[F.col(k) for k in columns], *order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Staged sorted ``rows`` with ``_shift``, which added to ``_at`` gives the place in the group from 0, and the group's ``_members``."""
    rows = rows.withColumn("_part", F.shiftright("_at", PART_BITS))
    group = Window.partitionBy(*keys)
    sizes = rows.groupBy("_part", *keys).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stage(sizes.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                               (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_shift"), F.sum("_rows").over(group).alias("_members")))
    on = _match(rows, sizes, [("_part", "_p"), *[(k, f"_k{i}") for i, k in enumerate(keys)]])
    return rows.join(sizes, on).drop("_part", "_p", *[f"_k{i}" for i in range(len(keys))])


def _hot_values(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Values with a great many rows in a sample: they are laid out differently, their result is the same."""
    seen = df.where(F.col("_code").isNotNull() & (F.rand(17) < SAMPLE)).groupBy(*keys, "_code").agg(F.count(F.lit(1)).alias("_seen"))
    rows = seen.where(F.col("_seen") >= HOT).orderBy(F.desc("_seen")).limit(HOT_MOST).drop("_seen").collect()
    if not rows:
        return None
    schema = T.StructType([T.StructField(f"_h{i}", f.dataType) for i, f in enumerate(seen.drop("_seen").schema)])
    return df.sparkSession.createDataFrame(rows, schema)


def rank_parts(df: DataFrame, keys: list[str], x: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_below``, ``{prefix}_ties`` and ``{prefix}_n`` (NULL where ``x`` is NULL)."""
    floating = isinstance(df.schema[x].dataType, (T.DoubleType, T.FloatType))
    rows = df.withColumn("_code", order_code(F.col(x)) if floating else F.col(x))
    hot = _hot_values(rows, keys)
    names = [*keys, "_code"]
    run = ["_code"] if hot is None else ["_code", "_sub"]
    if hot is not None:                             # at most HOT_MOST rows are broadcast
        on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(hot[f"_h{i}"]) for i, k in enumerate(names)])
        flagged = F.broadcast(hot.withColumn("_hot", F.lit(True)))
        marked = rows.join(flagged, on, "left").drop(*hot.columns)
        rows = marked.withColumn("_sub", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SUB_RUNS)) + 1).otherwise(0).cast("int")).drop("_hot")
    rows = rows.withColumn("_known", F.col("_code").isNotNull())
    rows = _sorted(rows, [*keys, "_known", *run], [])
    same = Window.partitionBy(*keys, "_known", *run)
    rows = rows.withColumns({"_first": F.min("_at").over(same), "_ties": F.count(F.lit(1)).over(same)})
    rows = _grouped(stage(rows if hot is not None else rows.drop("_code")), [*keys, "_known"])
    rows = rows.withColumn("_below", F.col("_first") + F.col("_shift"))
    if hot is not None:
        runs = rows.where(F.col("_known") & (F.col("_sub") > 0)).groupBy(*names).agg(F.min("_below").alias("_b"), F.count(F.lit(1)).alias("_t"))
        runs = runs.withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(names)})
        on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(runs[f"_h{i}"]) for i, k in enumerate(names)])
        rows = rows.join(F.broadcast(runs), on, "left").withColumns({"_below": F.coalesce("_b", "_below"), "_ties": F.coalesce("_t", "_ties")})
    return rows.select(*df.columns, *[F.when(F.col("_known"), F.col(c)).alias(f"{prefix}_{name}") for c, name in
                                       (("_below", "below"), ("_ties", "ties"), ("_members", "n"))])


def average_rank(prefix: str, pct: bool = True) -> Column:
    place = F.col(f"{prefix}_below") + (F.col(f"{prefix}_ties") + 1) / F.lit(2.0)
    return place / F.col(f"{prefix}_n") if pct else place


def split_by_size(df: DataFrame, keys: list[str], most: int | None = None, counted: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups that one task can hold, rows of larger ones); None for a side without groups. Counts once, in ``counted``
    where it is given: a table with the same groups that is read at less cost."""
    most = GROUP_ROWS if most is None else most
    sizes = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = sizes.where(F.col("_rows") > most)
    found = sizes.agg(F.count_if(F.col("_rows") > most).alias("large"), F.count(F.lit(1)).alias("all")).first()
    if not found["large"]:
        return df, None
    if found["large"] == found["all"]:
        return None, df
    names = stage(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    on = _match(df, names, [(k, f"_k{i}") for i, k in enumerate(keys)])
    return df.join(names, on, "left_anti"), df.join(names, on, "left_semi")


def _window_ranks(df: DataFrame, keys: list[str], columns: dict[str, str], pct: bool) -> DataFrame:
    group = Window.partitionBy(*keys)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    out = []
    for name, x in columns.items():
        order = group.orderBy(F.col(x).asc_nulls_last())
        place = F.rank().over(order) + (F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / F.lit(2.0)
        out.append(F.when(keyed & F.col(x).isNotNull(), place / F.count(x).over(group) if pct else place).alias(name))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def _sorted_ranks(df: DataFrame, keys: list[str], columns: dict[str, str], pct: bool) -> DataFrame:
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    kept = df.columns
    for i, (out, x) in enumerate(columns.items()):
        df = rank_parts(df, keys, x, f"_r{i}")
        kept = [*kept, out]
        df = df.withColumn(out, F.when(keyed, average_rank(f"_r{i}", pct))).select(*kept)
    return df


def with_ranks(df: DataFrame, keys: list[str], columns: dict[str, str], *, pct: bool = True) -> DataFrame:
    """Average-tie ranks, ``{output: input}``; as a share of the non-null count when ``pct``.

    NULL inputs stay unranked and rows with a NULL key get NULL. ``df`` is read once more to count its groups.
    """
    small, large = split_by_size(df, keys)
    parts = [] if small is None else [_window_ranks(small, keys, columns, pct)]
    parts += [] if large is None else [_sorted_ranks(large, keys, columns, pct)]
    return reduce(DataFrame.unionByName, parts)


def with_group_size(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Non-null count of ``x`` per group: an aggregate joined back."""
    return df.join(df.groupBy(*keys).agg(F.count(x).alias(out)), keys, "left")


def with_position(df: DataFrame, keys: list[str], x: str, tie: str, out: str, *,
                  descending: bool = False, tie_descending: bool = False) -> DataFrame:
    """1-based place in the total order ``(x, tie)``; ``tie`` must be unique among equal ``x``.

    Rows with a NULL ``x`` get NULL and do not count. ``df`` is read once more to count its groups.
    """
    order = [F.desc(x) if descending else F.asc(x)]
    if tie != x:
        order.append(F.desc(tie) if tie_descending else F.asc(tie))
    small, large = split_by_size(df, keys)
    parts = []
    if small is not None:
        placed = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(x).isNull(), *order)).cast("long")
        parts.append(small.select(*df.columns, F.when(F.col(x).isNotNull(), placed).alias(out)))
    if large is not None:
        rows = _sorted(large.withColumn("_known", F.col(x).isNotNull()), [*keys, "_known"], order)
        rows = _grouped(stage(rows), [*keys, "_known"])
        parts.append(rows.select(*df.columns, F.when(F.col("_known"), F.col("_at") + F.col("_shift") + 1).alias(out)))
    return reduce(DataFrame.unionByName, parts)


def _range_part(x: Column, fineness: int) -> Column:
    """A whole number that never falls as the value rises: an exact order needs nothing else of it."""
    size = F.least(F.floor((F.log2(F.abs(x)) + 1100) * fineness), F.lit(2 ** 40))
    return F.when(F.isnan(x), F.lit(2 ** 41)).when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def quantile_table(df: DataFrame, keys: list[str], columns: list[str], probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per group: ``{column}_q{i}`` per prob.

    Values are counted by their doubling, then those of the parts that hold a wanted place by smaller parts, at last one by
    one. All counts are combined before their shuffle, no row is shuffled or sorted, and no group has to fit a task. ``df`` is
    read once per step, so it should be staged.
    """
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_name"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])).alias("_s"))
    long = long.select(*keys, "_s.*").where(F.col("_x").isNotNull())
    names = [*keys, "_name"]
    steps = [*[_range_part(F.col("_x"), n) for n in FINENESS], F.col("_x")]
    wanted = None
    for i, part in enumerate(steps):
        own = [*names, *(["_in"] if i else [])]         # the part of the step before
        if i:
            parts = wanted.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(names)], F.col("_part").alias("_in")).distinct()
            on = _match(long, parts, [(k, f"_k{j}") for j, k in enumerate(names)]) & (steps[i - 1] == F.col("_in"))
            rows = long.join(parts, on).drop(*[f"_k{j}" for j in range(len(names))])
        else:
            rows = long
        counts = rows.groupBy(*own, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        group = Window.partitionBy(*own)
        counts = counts.withColumn("_to", F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
        if i:
            places = wanted.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(names)], F.col("_part").alias("_p"), "_place", "_slot", "_w")
            on = _match(counts, places, [*[(k, f"_k{j}") for j, k in enumerate(names)], ("_in", "_p")])
            placed = counts.join(places, on)
        else:
            at = [F.lit(p) * (F.sum("_n").over(group) - 1) for p in probs]
            slots = F.array(*[F.struct(F.lit(2 * j + side).alias("_slot"), place.cast("long").alias("_place"), (a - F.floor(a)).alias("_w"))
                              for j, a in enumerate(at) for side, place in ((0, F.floor(a)), (1, F.ceil(a)))])
            placed = counts.withColumn("_slots", slots).select("*", F.explode("_slots").alias("_e")).select(*counts.columns, "_e.*")
        inside = (F.col("_place") < F.col("_to")) & (F.col("_place") >= F.col("_to") - F.col("_n"))
        wanted = stage(placed.where(inside).select(*names, "_part", "_slot", "_w", (F.col("_place") - (F.col("_to") - F.col("_n"))).alias("_place")))
    out = []
    for j, c in enumerate(columns):
        for i in range(len(probs)):
            low, high = (F.max(F.when((F.col("_name") == j) & (F.col("_slot") == 2 * i + side), F.col("_part"))) for side in (0, 1))
            weight = F.max(F.when((F.col("_name") == j) & (F.col("_slot") == 2 * i), F.col("_w")))
            out.append(F.when(weight > 0, low + (high - low) * weight).otherwise(low).alias(f"{c}_q{i}"))
    return wanted.groupBy(*keys).agg(*out)
