"""Mixing sources to target weights along a time-varying curriculum.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the words of all
documents; no source gives more than three times its words, the excess goes to the others by
weight. The share is found in closed form: with sources sorted by limit over weight, the level is the first at
which all sources from there on stay below their limits.

A source's documents stand in hash order. It is read through as often as its target holds its
size, then once more as far as whole documents fit into what is left less a reserve: two documents of its largest size, half
of it at most. The gap is filled from the documents behind the cut: largest size first, as many of each size as fit, in hash order, until none fits; the smallest one left
goes over the target if that comes nearer to it. The fill is a fold over a source's distinct sizes below twice its gap. The
order is a running sum over hash buckets, so a source with most of the rows is summed by many tasks; only the bucket
with the cut is looked into before the last pass. Sizes are words.

Each source has a weight schedule over training time, straight between knots. Its integral is the
share of the source's words that is due by a time; a copy's place in the cumulative demand, put through
the inverse of that integral, is its training position. Copies are range-sorted by position.

Defined cases: a null source is a source; a null or blank text has size 0 and is never chosen by
size, but taken with each full pass. Repeated rows are rows of their own. With no words at all, targets and takes
are 0. An empty table gives an empty result. Input columns are kept; helper columns get names that
no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.llm.common import fresh, hash60, hash60_sql, words
from crosstide.session import stage

MAX_PASSES = 3
WEIGHTS = 3
BUCKET_BITS = 12
UNIT = 10 ** 9              # positions of the report are in billionths
# Knots (time, weight) of the schedule of sources that weigh 1, 2 and 3.
CURRICULUM = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def targets(totals: DataFrame) -> DataFrame:
    """``totals`` (source, source_size): adds weight and target. A row per source, so it is small."""
    everything = Window.partitionBy()
    ranked = totals.select(
        "source", "source_size", F.sum("source_size").over(everything).alias("total"),
        ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % WEIGHTS + 1).alias("weight"))
    ranked = ranked.withColumn("limit", MAX_PASSES * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = Window.orderBy("ratio").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    below = F.sum("limit").over(upto) - F.sum("limit").over(Window.partitionBy("ratio"))
    level = (F.col("total") - below) / F.sum("weight").over(from_here)
    levels = ranked.withColumn("level", level)
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.withColumn("target", F.least(F.col("weight") * chosen, F.col("limit").cast("double"))).select(
        "source", "source_size", "weight", "target")


def sized(docs: DataFrame) -> tuple[DataFrame, str]:
    size = fresh(docs, "size")
    return docs.withColumn(size, F.size(words(F.col("text"))).cast("long")), size


def takes(docs: DataFrame, size: str) -> tuple[DataFrame, str]:
    """Adds a struct column: source_size, weight, target, upto (words of the source up to and with
    this document), passes, extra (one more copy in order), fill (one more copy in the gap) and at (where that copy begins)."""
    name, h, b, key, local = (fresh(docs, x) for x in ("mix", "hash", "bucket", "key", "local"))
    # a key that is never null: a plain equality on it keeps the partitioning that the running sum has made
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    rows = docs.withColumns({h: hash60(F.col("doc_id")), key: named}).withColumn(b, F.shiftright(F.col(h), 60 - BUCKET_BITS).cast("int"))
    sums = rows.groupBy("source", key, b).agg(F.sum(size).alias("n"), F.max(size).alias("largest"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.select("source", key, b, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                             F.max("largest").over(Window.partitionBy(key)).alias("largest")))
    shares = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    offsets = sums.join(shares.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("passes", passes)
    offsets = offsets.withColumn("rest", rest).withColumn("first", F.col("rest") - F.least(F.lit(2.0) * F.col("largest"), F.col("rest") / 2))
    offsets = stage(offsets.select(key, b, F.struct("start", "n", "source_size", "weight", "target", "passes", "rest", "first").alias(name)))
    running = Window.partitionBy(key, b).orderBy(h, "doc_id", size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.col(name)
    fill = _fill(rows.select(F.col(key).alias("key"), F.col(b).alias("bucket"), F.col(h).alias("h"), "doc_id", F.col(size).alias("n")),
                 offsets.select(F.col(key).alias("key"), F.col(b).alias("bucket"), f"{name}.*"))
    fill = fill.select(F.col("key").alias(key), F.col("bucket").alias(b), F.col("n").alias(size), F.struct(*fill.columns[3:]).alias(local))
    f = F.col(local)
    out = rows.withColumn(h, F.sum(size).over(running))
    # among documents of one size the running sum is their order
    place = fresh(out, "place")
    out = out.withColumn(place, F.row_number().over(Window.partitionBy(key, b, size).orderBy(h)))
    out = out.join(offsets, [key, b]).join(fill, [key, b, size], "left")
    upto = m["start"] + F.col(h)
    rank = F.col(place) - f["skip"]
    fills = F.coalesce((rank >= 1) & (rank <= f["allow"]), F.lit(False))
    begins = F.when(f["over"] & (f["before"] + rank == f["k"]), m["target"] - F.col(size)).otherwise(
        m["passes"] * m["source_size"] + f["start"] + (f["before"] + rank - 1) * F.col(size))
    out = out.withColumn(name, F.struct(
        m["source_size"].alias("source_size"), m["weight"].alias("weight"), m["target"].alias("target"), upto.alias("upto"), m["passes"].alias("passes"),
        ((F.col(size) > 0) & (upto <= m["first"])).alias("extra"), fills.alias("fill"), F.when(fills, begins).alias("at")))
    return out.drop(h, b, key, local, place), name


def _fill(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Which documents fill the gaps: (key, bucket, n) with ``allow``, the number of documents of size ``n`` taken from the bucket behind the
    first ``skip``; ``before``, those taken from earlier buckets; ``start``, the word at which the first of this size begins;
    ``k``, all of this size; ``over``, whether the last of them goes over the target."""
    edges = offsets.filter((F.col("start") <= F.col("first")) & (F.col("first") < F.col("start") + F.col("n")) & (F.col("passes") < MAX_PASSES))
    edges = edges.select("key", F.col("bucket").alias("cut"), "start", "rest", "first")
    running = Window.partitionBy("key").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.join(edges, (rows["key"] == edges["key"]) & (rows["bucket"] == edges["cut"])).drop(edges["key"])
    inside = stage(inside.select("key", "n", "start", "first", (F.col("start") + F.sum("n").over(running)).alias("upto")))
    got = inside.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("first"), F.col("upto"))), F.max("start")).alias("got"))
    gaps = stage(edges.join(got, "key").select("key", "cut", "got", (F.col("rest") - F.col("got")).alias("gap")))

    small = (F.col("n") > 0) & (F.col("n") < 2 * F.col("gap"))
    later = rows.select("key", "bucket", "n").join(gaps, "key").filter((F.col("bucket") > F.col("cut")) & small)
    here = inside.join(gaps, "key").filter(small)
    free = here.filter("upto > first")
    counts = later.groupBy("key", "n").count().unionByName(free.groupBy("key", "n").count()).groupBy("key", "n").agg(F.sum("count").alias("count"))
    lists = counts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "count")), asc=False).alias("sizes")).join(gaps, "key")

    def state(gap, filled, spare, rules):
        return F.struct(gap.cast("double").alias("gap"), filled.cast("double").alias("filled"), spare.cast("long").alias("spare"), rules.alias("rules"))

    def step(acc, e):
        k = F.least(e["count"], F.floor(acc["gap"] / e["n"]))
        rule = F.struct(e["n"].alias("n"), k.alias("k"), acc["filled"].alias("start"))
        return state(acc["gap"] - k * e["n"], acc["filled"] + k * e["n"], F.when(e["count"] > k, e["n"]).otherwise(acc["spare"]),
                     F.when(k > 0, F.concat(acc["rules"], F.array(rule))).otherwise(acc["rules"]))

    none = F.array().cast("array<struct<n:bigint,k:bigint,start:double>>")
    folded = lists.select("key", "cut", "got", F.aggregate("sizes", state(F.col("gap"), F.lit(0), F.lit(None), none), step).alias("f"))
    fitting = folded.select("key", "cut", "got", F.explode("f.rules").alias("r")).select(
        "key", "cut", "r.n", "r.k", (F.col("got") + F.col("r.start")).alias("start"), F.lit(False).alias("over"))
    beyond = folded.filter("f.spare - f.gap < f.gap").select(
        "key", "cut", F.col("f.spare").alias("n"), F.lit(1).cast("long").alias("k"), (F.col("got") + F.col("f.filled")).alias("start"), F.lit(True).alias("over"))
    rules = stage(fitting.unionByName(beyond).groupBy("key", "cut", "n").agg(F.sum("k").alias("k"), F.min("start").alias("start"), F.max("over").alias("over")))

    own = rows.select("key", "bucket", "n").join(rules, ["key", "n"]).filter("bucket > cut").groupBy("key", "n", "bucket").agg(
        F.count("*").alias("count"), F.lit(0).cast("long").alias("skip"))
    at_cut = inside.join(rules, ["key", "n"]).groupBy("key", "n", F.col("cut").alias("bucket")).agg(
        F.count_if(F.col("upto") > F.col("first")).alias("count"), F.count_if(F.col("upto") <= F.col("first")).alias("skip"))
    in_order = Window.partitionBy("key", "n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.unionByName(at_cut).withColumn("before", F.coalesce(F.sum("count").over(in_order), F.lit(0))).join(rules.drop("cut"), ["key", "n"])
    allow = F.least(F.col("count"), F.col("k") - F.col("before"))
    return stage(placed.filter("before < k").select("key", "bucket", "n", allow.alias("allow"), "skip", "before", "start", "k", "over"))


def copies(m: Column) -> Column:
    return m["passes"] + m["extra"].cast("long") + m["fill"].cast("long")


def share(m: Column, size: Column, copy: Column) -> Column:
    """Share of the source's words that is due when half of this copy is read."""
    begins = F.when((copy > m["passes"]) & m["fill"], m["at"]).otherwise((copy - 1) * m["source_size"] + m["upto"] - size)
    middle = begins + size / 2
    return F.when(m["target"] > 0, F.greatest(F.least(middle / m["target"], F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def position(share: Column, weight: Column, curriculum: dict = CURRICULUM) -> Column:
    """Training time at which ``share`` of a source's words is due: the inverse of its integrated schedule."""
    out = F.lit(None).cast("double")
    for w, knots in curriculum.items():
        pieces, done = [], 0.0
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            pieces.append((t0, t1, a, b, done, done + (t1 - t0) * (a + b) / 2))
            done = pieces[-1][-1]
        here = F.lit(float(knots[-1][0]))
        for t0, t1, a, b, c0, c1 in reversed(pieces):
            due, slope = share * F.lit(done) - F.lit(c0), (b - a) / (t1 - t0)
            inside = due / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * due, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            here = F.when(share * F.lit(done) <= F.lit(c1), F.lit(t0) + inside).otherwise(here)
        out = F.when(weight == w, here).otherwise(out)
    return out


def mix(docs: DataFrame, curriculum: dict = CURRICULUM) -> DataFrame:
    """A row per copy that the mix takes, with the document's columns, range-sorted by training position."""
    rows, size = sized(docs)
    rows, name = takes(rows, size)
    copy, at = fresh(rows, "copy"), fresh(rows, "position")
    m = F.col(name)
    rows = rows.withColumn(copy, F.explode(F.when(copies(m) > 0, F.sequence(F.lit(1).cast("long"), copies(m)))))
    rows = rows.withColumn(at, position(share(m, F.col(size), F.col(copy)), m["weight"], curriculum))
    return rows.repartitionByRange(F.col(at), F.col("doc_id"), F.col(copy)).sortWithinPartitions(at, "doc_id", copy).select(*docs.columns)


def report(docs: DataFrame, curriculum: dict = CURRICULUM) -> DataFrame:
    """What the mix takes of every document, and its copies' training positions in billionths as text; range-sorted by the first one,
    documents that are not taken last."""
    rows, size = sized(docs.select("doc_id", "text", "source"))
    rows, name = takes(stage(rows.drop("text")), size)
    m = F.col(name)
    at = F.when(copies(m) > 0, F.transform(F.sequence(F.lit(1).cast("long"), copies(m)),
                                           lambda c: F.floor(position(share(m, F.col(size), c), m["weight"], curriculum) * UNIT)))
    out = rows.select("doc_id", F.col(size).alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
                      (F.col(size) * copies(m)).alias("taken"), at.alias("at"))
    first = F.get("at", F.lit(0)).asc_nulls_last()
    out = out.repartitionByRange(first, F.col("doc_id")).sortWithinPartitions(first, "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join("at", ",").alias("positions"))


def _position_sql(share: str, weight: str, curriculum: dict = CURRICULUM) -> str:
    """Solves the schedule's integral piece by piece, as ``position`` does."""
    num = lambda v: f"{v!r}::double"
    cases = []
    for w, knots in curriculum.items():
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
        done, when = sum(areas), []
        for i, ((t0, a), (t1, b)) in enumerate(zip(knots, knots[1:], strict=False)):
            due, slope = f"({share} * {num(done)} - {num(float(sum(areas[:i])))})", (b - a) / (t1 - t0)
            inside = f"{due} / {num(a)}" if slope == 0 else f"(sqrt(greatest({num(a * a)} + {num(2 * slope)} * {due}, 0)) - {num(a)}) / {num(slope)}"
            when.append(f"when {share} * {num(done)} <= {num(float(sum(areas[:i + 1])))} then {num(t0)} + {inside}")
        cases.append(f"when {weight} = {w} then case {' '.join(when)} else {num(knots[-1][0])} end")
    return f"case {' '.join(cases)} end"


SQL = f"""
with recursive r as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
             {hash60_sql('doc_id')} as h from documents),
t as (select source, cast(sum(size) as bigint) as source_size from r group by source),
k as (select *, cast(sum(source_size) over () as bigint) as total, (row_number() over (order by source nulls last) - 1) % {WEIGHTS} + 1 as weight from t),
q as (select *, {MAX_PASSES} * source_size as lim, ({MAX_PASSES} * source_size)::double / weight as ratio from k),
v as (select a.*, (a.total - coalesce((select sum(b.lim) from q b where b.ratio < a.ratio), 0))::double
             / (select sum(b.weight) from q b where b.ratio >= a.ratio) as lvl from q a),
g as (select *, least(weight * (select arg_min(lvl, ratio) from v where lvl <= ratio), lim::double) as target from v),
p as (select source, source_size, weight, target, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as passes from g),
c as (select r.*, p.source_size, p.weight, p.target, p.passes, p.target - p.passes * p.source_size as rest,
        p.target - p.passes * p.source_size - least(2.0::double * max(r.size) over (partition by r.source), (p.target - p.passes * p.source_size) / 2) as edge,
        sum(r.size) over (partition by r.source order by h, doc_id, size rows unbounded preceding) as upto
      from r join p on r.source is not distinct from p.source),
e as (select *, size > 0 and upto <= edge as extra, max(case when size > 0 and upto <= edge then upto else 0 end) over (partition by source) as got,
        row_number() over (partition by source, size, size > 0 and upto <= edge order by upto) as rank from c),
sizes as (select source, size, count(*) as n, any_value(rest - got) as gap, any_value(got) as got, row_number() over (partition by source order by size desc) as i
          from e where not extra and size > 0 and passes < {MAX_PASSES} and size < 2 * (rest - got) group by source, size),
fold(source, i, size, k, start, gap, spare) as (
  select source, 0::bigint, 0::bigint, 0::bigint, any_value(got)::double, any_value(gap), null::bigint from sizes group by source
  union all
  select s.source, s.i, s.size, least(s.n, floor(f.gap / s.size)::bigint), f.start + f.k * f.size, f.gap - least(s.n, floor(f.gap / s.size)::bigint) * s.size,
         case when s.n > least(s.n, floor(f.gap / s.size)::bigint) then s.size else f.spare end
  from fold f join sizes s on s.source is not distinct from f.source and s.i = f.i + 1),
ends as (select source, arg_max(spare, i) as size, arg_max(gap, i) as gap from fold where spare is not null group by source),
last as (select f.source, arg_max(f.gap, f.i) as gap from fold f group by f.source),
chosen as (select source, size, k, start, false as beyond from fold where k > 0
           union all select ends.source, ends.size, 1, null, true from ends join last on ends.source is not distinct from last.source where ends.size - last.gap < last.gap),
rules as (select source, size, sum(k) as k, min(start) as start, bool_or(beyond) as beyond from chosen group by source, size),
z as (select e.*, coalesce(not extra and rank <= u.k, false) as fill, u.start, u.beyond and rank = u.k as beyond
      from e left join rules u on u.source is not distinct from e.source and u.size = e.size),
y as (select *, passes + extra::int + fill::int as copies from z),
x as (select *, list_transform(range(1, copies + 1), lambda n: case when n > passes and fill then
          (case when beyond then target - size else passes * source_size + start + (rank - 1) * size end) else (n - 1) * source_size + upto - size end) as begins from y),
s as (select *, list_transform(begins, lambda b: case when target > 0 then greatest(least((b + size / 2.0::double) / target, 1), 0) else 0 end) as shares from x)
select doc_id, size, source_size, target, cast(size * copies as bigint) as taken,
  case when copies > 0 then array_to_string(list_transform(shares, lambda w: cast(floor(({_position_sql('w', 'weight')}) * {UNIT}) as bigint)), ',') end as positions
from s"""
