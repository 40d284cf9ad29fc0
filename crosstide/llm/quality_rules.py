"""Quality rules with thresholds that follow the data.

Every text is measured once (words, symbols, repeated lines, repeated three-word windows). Each
measure is summarised per language and source by a mergeable quantile sketch: counts per bucket,
where a bucket keeps a number's seven leading bits, so a quantile is off by at most 1/64 of its value.
Sketches merge by adding counts into those of a language and of all documents.

Every sketch gives a limit: its upper quartile plus a multiple of its interquartile range, or of its standard deviation where that is
more, for word length, which has a lower limit too. Where most documents have none of what is counted both quartiles are 0: for
symbols the sketch's mean then gives the reach; repeated lines and repeated words, which many good documents have a few of, take their quartiles from the documents that have any.
The limits of group, language and all documents are blended by their counts: n documents weigh n / (n + ``PRIOR_ROWS``)
against the wider level, so no limit jumps when a group grows. A document is rejected when its count exceeds what its
length allows at the limit by more than ``NOISE`` standard deviations of a count. ``rejected_by`` names the rules that it breaks.

Defined cases: a null text has no words and fails the base rule, as does an empty one. A null
language or source is a group of its own. Repeated rows are measured and judged alike and all
stay or go together. An empty table gives an empty result. Columns of the input keep their names and
values; the measures travel in one struct column whose name no input column has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.llm.common import BLANKS, fresh, let, words
from crosstide.session import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LEADING_BITS = 7


@dataclass(frozen=True)
class Measure:
    """``scale * part / whole`` as a whole number, and how its limit follows from a sketch."""
    name: str
    part: str
    whole: str
    scale: int
    spread: int             # multiples of the interquartile range
    means: int = 0          # multiples of the mean, where those are more
    deviations: int = 0     # of the standard deviation, likewise
    any_only: bool = False  # quartiles of the documents that have any
    two_sides: bool = False # a rate with a lower limit as well; else a count with an upper one


MEASURES = (
    Measure("symbol_rate", "n_symbols", "n_words", 1000, 4, means=1),
    Measure("word_length", "word_chars", "n_words", 1000, 6, deviations=3, two_sides=True),
    Measure("dup_line_rate", "n_dup_lines", "n_lines", 1000, 4, any_only=True),
    Measure("repeat_rate", "n_repeat_words", "n_words", 1000, 4, any_only=True),
)
PRIOR_ROWS = 20
NOISE = 4


def repeated_words(w: Column) -> Column:
    """Number of words inside three-word windows that the array holds twice or more."""
    windows = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def starts_of(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def count(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(ordered, lambda s: let(starts_of(s), covered)))

    return let(windows, count)


def measured(text: Column) -> Column:
    """A struct of the base measures of one text."""
    t = F.coalesce(text, F.lit(""))
    per_words = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return let(F.struct(per_words.alias("w"), per_lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (m["l"]["n"] - m["l"]["d"]).cast("long").alias("n_dup_lines"),
        m["w"]["r"].cast("long").alias("n_repeat_words"),
        m["l"]["n"].cast("long").alias("n_lines")))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def rate(m: Column, x: Measure) -> Column:
    return F.when(m[x.whole] > 0, F.floor(F.lit(x.scale) * m[x.part] / m[x.whole]).cast("long")).otherwise(F.lit(0).cast("long"))


def dropped_bits(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - LEADING_BITS, F.lit(0))


def bucket(v: Column) -> Column:
    """The number with all but its leading bits cleared."""
    return v - F.pmod(v, F.pow(F.lit(2), dropped_bits(v)).cast("long"))


def sketches(rows: DataFrame, m: str) -> DataFrame:
    """Counts per language, source, measure and bucket of the documents that pass the base rule."""
    long = (rows.filter(~base_failed(F.col(m)))
            .select("lang", "source", F.posexplode(F.array(*[bucket(rate(F.col(m), x)) for x in MEASURES])).alias("measure", "bucket")))
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _per_measure(value) -> Column:
    out = F.lit(None)
    for i, x in enumerate(MEASURES):
        out = F.when(F.col("measure") == i, value(x)).otherwise(out)
    return out


def fences(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The limits (hi, lo) that the summed counts of each group give, and how many documents stand behind them."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    only = [i for i, x in enumerate(MEASURES) if x.any_only]
    merged = merged.filter((F.col("bucket") > 0) | ~F.col("measure").isin(only))
    group = Window.partitionBy(*keys, "measure")
    run = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("all"))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
    square = F.col("bucket").cast("decimal(19,0)") * F.col("bucket") * F.col("n")
    found = run.groupBy(*keys, "measure").agg(F.max("all").alias("rows"), at(1).alias("q1"), at(3).alias("q3"),
                                              (F.sum(F.col("bucket") * F.col("n")) / F.sum("n")).alias("mean"),
                                              (F.sum(square).cast("double") / F.sum("n")).alias("square"))
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    reach = F.greatest(_per_measure(lambda x: F.lit(x.spread)) * (F.col("q3") - F.col("q1")), _per_measure(lambda x: F.lit(x.means)) * F.col("mean"),
                       _per_measure(lambda x: F.lit(x.deviations)) * deviation)
    top = F.col("q3") + F.pow(F.lit(2), dropped_bits(F.col("q3"))).cast("long") - 1           # the bucket's largest number
    return found.select(*keys, "measure", "rows", (top + reach).alias("hi"), (F.col("q1") - reach).alias("lo"))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per language and source with an upper and a lower limit for each measure; null if no document has any of it."""
    groups = counts.select("lang", "source", "measure").distinct()
    for level, keys in (("g", ["lang", "source"]), ("l", ["lang"]), ("a", [])):
        own = fences(counts, keys)
        own = own.select(*[F.col(c).alias(f"{level}_{c}") for c in own.columns])
        on = F.col("measure") == F.col(f"{level}_measure")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{level}_{k}"))
        groups = groups.join(own, on, "left")

    def blended(side: str) -> Column:
        out = F.col(f"a_{side}")
        for level in ("l", "g"):
            rows = F.coalesce(F.col(f"{level}_rows"), F.lit(0))
            w = rows / (rows + PRIOR_ROWS)
            out = w * F.coalesce(F.col(f"{level}_{side}"), F.lit(0.0)) + (1 - w) * out
        return out

    limits = [F.max(F.when(F.col("measure") == i, blended(side))).alias(f"{x.name}_{side}")
              for i, x in enumerate(MEASURES) for side in ("hi", "lo") if side == "hi" or x.two_sides]
    return groups.groupBy("lang", "source").agg(*limits)


def breaks(m: Column, limits: Column, x: Measure) -> Column:
    """Whether the measured text lies beyond the limits; false where there is none."""
    hi = limits[f"{x.name}_hi"]
    if x.two_sides:
        return F.coalesce((rate(m, x) > hi) | (rate(m, x) < limits[f"{x.name}_lo"]), F.lit(False))
    allowed = m[x.whole] * hi / x.scale
    return F.coalesce(m[x.part] > allowed + NOISE * F.sqrt(F.greatest(allowed, F.lit(1.0))), F.lit(False))


def judge(docs: DataFrame, drop: tuple[str, ...] = ()) -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of measures and the names of the rules that the document breaks (a kept one: empty); returns the names of
    these two columns. Columns in ``drop`` are left out once they are measured.

    The measured rows are written once: the sketch and the filter read them back, so texts are
    taken apart once. The limits are a table with a row per language and source, written too, so
    that its size is known when Spark chooses how to join it.
    """
    m = fresh(docs, "measures")
    rows = stage(docs.withColumn(m, measured(F.col("text"))).drop(*drop))
    limits = stage(thresholds(sketches(rows, m)))
    lang, source = fresh(docs, "limit_lang"), fresh(docs, "limit_source")
    limit = fresh(docs, "limits")
    packed = limits.select(F.col("lang").alias(lang), F.col("source").alias(source),
                           F.struct(*[c for c in limits.columns if c not in ("lang", "source")]).alias(limit))
    out = rows.join(packed, rows["lang"].eqNullSafe(packed[lang]) & rows["source"].eqNullSafe(packed[source]), "left")
    broken = fresh(docs, "broken")
    names = F.concat_ws(",", F.when(base_failed(F.col(m)), F.lit("base")), *[F.when(breaks(F.col(m), F.col(limit), x), F.lit(x.name)) for x in MEASURES])
    return out.withColumn(broken, names).drop(lang, source, limit), m, broken


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    out, _, broken = judge(docs)
    return out.filter(F.col(broken) == "").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document."""
    out, m, broken = judge(docs.select("doc_id", "text", "lang", "source"), drop=("text",))
    return out.select("doc_id", *[F.col(m)[c].alias(c) for c in
                                  ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      base_failed(F.col(m)).alias("base_failed"), (F.col(broken) == "").alias("kept"), F.col(broken).alias("rejected_by"))


def _sql() -> str:
    rates = ", ".join(f"case when {x.whole} > 0 then cast(floor({x.scale}.0::double * {x.part} / {x.whole}) as bigint) else 0 end as v{i}"
                      for i, x in enumerate(MEASURES))
    union = " union all ".join(f"select lang, source, {i} as measure, v{i} as v from good" for i in range(len(MEASURES)))
    only = ", ".join(str(i) for i, x in enumerate(MEASURES) if x.any_only)

    def level(keys: str) -> str:
        lead = f"{keys}, " if keys else ""
        reach = "case measure " + " ".join(f"when {i} then greatest({x.spread} * (q3 - q1), {x.means} * mean, {x.deviations} * sqrt(greatest(square - mean * mean, 0)))" for i, x in enumerate(MEASURES)) + " end"
        return (f"select *, q3 + (1::bigint << greatest(length(bin(q3)) - {LEADING_BITS}, 0)) - 1 + {reach} as hi, q1 - {reach} as lo from (select {lead}measure, max(n_all) as n_all, "
                "min(case when 4 * upto >= n_all then bucket end) as q1, min(case when 4 * upto >= 3 * n_all then bucket end) as q3, "
                f"sum(bucket * n)::double / sum(n) as mean, sum(bucket::hugeint * bucket * n)::double / sum(n) as square from (select {lead}measure, bucket, n, sum(n) over (partition by {lead}measure order by bucket) as upto, "
                f"sum(n) over (partition by {lead}measure) as n_all from (select {lead}measure, bucket, sum(n) as n from counts "
                f"where bucket > 0 or measure not in ({only}) group by {lead}measure, bucket)) group by {lead}measure)")

    def blended(side: str) -> str:
        out = f"o.{side}"
        for level in ("b", "f"):
            w = f"(coalesce({level}.n_all, 0)::double / (coalesce({level}.n_all, 0) + {PRIOR_ROWS}))"
            out = f"{w} * coalesce({level}.{side}, 0) + (1 - {w}) * ({out})"
        return out

    limits = ", ".join(f"max(case when measure = {i} then {side} end) as {side}{i}" for i in range(len(MEASURES)) for side in ("hi", "lo"))
    rules = []
    for i, x in enumerate(MEASURES):
        allowed = f"({x.whole} * hi{i} / {x.scale})"
        test = f"v{i} > hi{i} or v{i} < lo{i}" if x.two_sides else f"{x.part} > {allowed} + {NOISE} * sqrt(greatest({allowed}, 1))"
        rules.append(f"case when {test} then '{x.name}' end")
    broken = "concat_ws(',', case when base_failed then 'base' end, " + ", ".join(rules) + ")"
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from g) where n > 1),
rep as (select rid, count(distinct p) as r from (select rid, unnest([i, i + 1, i + 2]) as p from twice) group by rid),
l as (select rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
m as (select d.doc_id, d.lang, d.source, cast(len(w.w) as bigint) as n_words,
        cast(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
        cast(len(l.l) - len(list_distinct(l.l)) as bigint) as n_dup_lines, cast(coalesce(rep.r, 0) as bigint) as n_repeat_words,
        len(l.l) as n_lines
      from d join w using (rid) join l using (rid) left join rep using (rid)),
r as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {rates} from m),
good as (select * from r where not base_failed),
counts as (select lang, source, measure, v - v % (1::bigint << greatest(length(bin(v)) - {LEADING_BITS}, 0)) as bucket, count(*) as n
           from ({union}) group by all),
fine as ({level('lang, source')}), bylang as ({level('lang')}), overall as ({level('')}),
chosen as (select k.lang, k.source, k.measure, {blended('hi')} as hi, {blended('lo')} as lo
      from (select distinct lang, source, measure from counts) k
      left join fine f on f.lang is not distinct from k.lang and f.source is not distinct from k.source and f.measure = k.measure
      left join bylang b on b.lang is not distinct from k.lang and b.measure = k.measure left join overall o on o.measure = k.measure),
limits as (select lang, source, {limits} from chosen group by lang, source),
judged as (select r.*, {broken} as rejected_by from r left join limits on r.lang is not distinct from limits.lang and r.source is not distinct from limits.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by = '' as kept, rejected_by from judged"""


SQL = _sql()
