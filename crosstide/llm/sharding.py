"""Shards by a weighted hash tree: region, rack, shard.

Every node has a draw for a document: an exponential arrival time whose rate is the summed weight of the shards
below it, made from a hash of the document's key, the level and the node's number. The descent takes the region with the
earliest draw, then the earliest of its racks, then the earliest of its shards, so a node wins with a chance in proportion
to its weight, and only the draws of the chosen path's siblings are made.

A draw depends on nothing but the key, the node and its weight. When a shard's weight changes, only the draws of its rack and
region change with it: rows move between that region and others, inside it between that rack and others, inside that between that shard
and others; nothing moves between two subtrees whose weights stay. A new shard in a new rack and region (as the
17th here) takes rows only into itself; one that is added to a rack takes rows into itself, and its heavier rack and region
take rows for all their shards.

Slots number the rows of a shard without gaps. The numbering is cut into hash buckets: rows are
counted per bucket, the counts are summed up per shard, and each bucket numbers its own rows.

Defined cases: a null key hashes as a key of its own; equal keys meet in one shard; a null
text has no bytes. An empty table gives an empty result. Columns of the input are kept by ``assign``,
whose result is one struct column with a name that the input does not have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.llm.common import fresh, let
from crosstide.session import stage

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards 0 to n - 1, filled rack by rack and region by region."""
    return [Shard(i, i // (per_rack * racks), i // per_rack) for i in range(shards)]


def arrival(key: Column, level: int, node: int, weight: float) -> Column:
    """Exponential time with the node's weight as rate, from 53 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2 ** 53))) / F.lit(weight)


LEVELS = ("region", "rack", "number")


def descend(key: Column, tree: list[Shard], level: int = 0) -> Column:
    """A struct (region, rack, shard) of the path with the earliest draw at each level."""
    below: dict[int, list[Shard]] = {}
    for s in tree:
        below.setdefault(getattr(s, LEVELS[level]), []).append(s)

    def under(node: int) -> Column:
        if level == len(LEVELS) - 1:
            s = below[node][0]
            return F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.number).alias("shard"))
        return descend(key, below[node], level + 1)

    if len(below) == 1:
        return under(next(iter(below)))
    draws = F.array(*[F.struct(arrival(key, level, n, sum(s.weight for s in shards)).alias("at"), F.lit(n).alias("node")) for n, shards in sorted(below.items())])

    def chosen(node: Column) -> Column:
        out = None
        for n in sorted(below):
            out = F.when(node == n, under(n)) if out is None else out.when(node == n, under(n))
        return out
    return let(F.array_min(draws)["node"], chosen)


def assign(docs: DataFrame, key: str, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """``docs`` with a struct column ``placed`` (or a fresh name): its path now and after growth."""
    return docs.withColumn(fresh(docs, "placed"), F.struct(
        descend(F.col(key), tree).alias("now"), descend(F.col(key), grown)["shard"].alias("grown")))


def numbered(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds ``slot``: 0, 1, 2 ... within each shard. ``rows`` is read twice, so stage it first."""
    bucket, n, start, at = (fresh(rows, x) for x in ("bucket", "n", "start", "at"))
    cut = rows.withColumn(bucket, F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = cut.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(counts.select(shard, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start)))
    inside = Window.partitionBy(shard, bucket).orderBy(*order)
    return (cut.withColumn(at, F.row_number().over(inside)).join(starts, [shard, bucket])
            .withColumn("slot", F.col(start) + F.col(at) - 1).drop(bucket, at, start))


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document, and its shard once there is one more."""
    placed = assign(docs.select("doc_id", "text"), "doc_id", topology(shards), topology(shards + 1))
    p = F.col(placed.columns[-1])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), p["now"]["shard"].alias("shard"), p["grown"].alias("grown_shard"),
        p["now"]["rack"].alias("rack"), p["now"]["region"].alias("region")))
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "rack", "region")
