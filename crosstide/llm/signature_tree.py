"""Exact n-gram Jaccard join by trees of signatures.

A document is its set of distinct shingles (64-bit hashes). Two documents link when their
Jaccard similarity reaches a limit; the result is the smallest document that links reach. ``SHINGLE`` words and
``PERCENT`` are those of the query; the pipeline passes its own.

1. Equal sets are one node, named by its smallest document. Nodes are told apart by the digest of their set, so no join is needed
   before they enter the forest; of equal sets in one slice of texts only the first enters.
2. Forest. Nodes that may link must meet in a tree. With sizes n <= m the sets differ in at most
   ``D = (n + m) * (100 - percent) / (100 + percent)`` shingles. The hash range is cut into ``D + 1 + slack`` segments; sets that link
   agree on at least ``1 + slack`` whole segments. A node is entered under the hash of each of its
   segments (cut for its size class; near the end of a class also for the next, so partners always share a
   cut). Empty segments are left out if the node has no more of them than the slack: another
   shared one is left then. So no link is lost. A node that shares fewer keys of a class with others than linked sets
   do leaves them again, so a common passage does not bring its documents together.
   Entries are shuffled once, as (key, node), and a window finds the keys with several nodes. Keys that a slice of texts holds often
   are heavy: theirs are made distinct and counted with partial sums instead, so that no key is one task's group.
3. Trees. The members of a forest key are bound into trees: leaves of similar sizes, inner nodes with
   the OR of their token bitmaps, their size range and least number of set bits. A dual traversal visits pairs of tree
   nodes and drops a pair when the largest possible overlap is too small, or when all of its
   documents are connected already. What is left at the leaves is compared exactly.
   A key's smallest member is its hub; a hub's tree holds all members of its keys, in blocks of bounded
   size. In hubs with several blocks whose members are then still in several components, those outside of the largest one
   are traversed with each other and with its blocks as well. After that no pair that shares a key is left unseen: it is
   connected, ruled out by a bound, or compared.
4. Components of the links by alternating stars, each round a written table.

Nowhere are all pairs of a group written out: near copies are skipped as soon as they are connected.

Defined cases: without words the set is empty and linked with nothing; with fewer words than a
shingle has the sequence is the only shingle. Rows that repeat a doc_id are one document (linked by
that id). A null doc_id gets a null component and is linked with nothing. An empty table gives an empty result.
``keep_one`` keeps all input columns; helper columns have names that no input column has.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from crosstide.session import noted, remove, small_broadcasts, stage

PERCENT = 90
SHINGLE = 3
BLOCK_SETS, BLOCK_SHINGLES = 1024, 200_000
LEAF = 16
SLICE_BYTES = 2_000_000
BROADCAST = 2 ** 18         # bytes of a table's files that the driver may make a hash table of: the tables joined here grow with the documents
SIEVE = 2 ** 24             # bits that tell which documents' texts are fetched, whatever their number
HEAVY = 4                   # entries of a key in one slice of texts
PARTS = 8                   # size classes of a set; an entry's number in them stands in the low bits of its id
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * A
    return h ^ (h >> np.uint64(29))


# -- sets and forest keys -----------------------------------------------------------------------

@lru_cache(maxsize=None)
def class_starts() -> list[int]:
    """Where each size class begins; a class is half as wide as it is far from 0."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def classes_of(n: int, percent: int = PERCENT) -> list[int]:
    """Classes of the larger set of any pair that a set of this size can belong to and link in."""
    first = bisect_right(class_starts(), n) - 1
    return list(range(first, bisect_right(class_starts(), n * 100 // percent)))


@lru_cache(maxsize=None)
def cut(size_class: int, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """Slack and inner segment borders for pairs whose larger set is in this class; none if only equal sets link."""
    first, largest = class_starts()[size_class], class_starts()[size_class + 1] - 1
    differ = 2 * largest * (100 - percent) // (100 + percent)
    slack = 0 if differ < 8 else 1 if differ < 16 else 2 + differ // 50
    # the smallest set of the class leaves about so many segments empty
    while slack < differ // 2 and slack + 0.5 < (empty := (differ + 1 + slack) * exp(-first * percent / 100 / (differ + 1 + slack))) + sqrt(empty):
        slack += 1
    pieces = differ + 1 + slack if differ else 0
    return slack, np.array([(i << 64) // pieces for i in range(1, pieces)], np.uint64)


def forest(u: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, int]]:
    """Per size class the keys under which a sorted set is entered, and how many of them it shares with any set that it links with.

    Linked sets agree on 1 + slack segments. Empty segments are left out if the set has no more of them than the slack; of those
    agreed on, each side leaves out its own empty ones at most, which are the same, so the rest is shared.
    """
    if not len(u):
        return []
    total = np.append(np.uint64(0), np.cumsum(mix(u), dtype=np.uint64))
    out = []
    for c in classes_of(len(u), percent):
        slack, inner = cut(c, percent)
        if not len(inner):
            continue
        at = np.concatenate([[0], np.searchsorted(u, inner), [len(u)]])
        count = np.diff(at)
        key = mix(mix(total[at[1:]] - total[at[:-1]] + count.astype(np.uint64) * B) + np.arange(len(count), dtype=np.uint64) * C + np.uint64(c))
        empty = int((count == 0).sum())
        out.append((key[count > 0].view(np.int64), 1 + slack - empty) if empty <= slack else (key.view(np.int64), 1))
    return out


def forest_keys(u: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All keys under which a sorted set is entered."""
    return np.concatenate([np.zeros(0, np.int64), *[k for k, _ in forest(u, percent)]])


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; distinct words of the slice are hashed once."""
    # bytes.lower and bytes.split touch exactly A-Z and the blanks of the word rule
    parts = [(t or "").encode().lower().split() for t in texts]
    code = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, code.dictionary.to_pylist()), np.uint64, len(code.dictionary))
    h = hashes[code.indices.to_numpy()] if len(code) else hashes
    s = h[:max(0, len(h) - shingle + 1)]
    for k in range(shingle if len(s) else 0):
        s = mix(s + h[k:k + len(s)] * (B if k % 2 else C)) if k else mix(s)
    out, at = [], 0
    for p in parts:
        n = len(p)
        if n >= shingle:
            out.append(np.unique(s[at:at + n - shingle + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(p), n)], np.uint64))
        else:
            out.append(s[:0])
        at += n
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of a few million bytes at a time; only that much is ever taken out of Arrow."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + SLICE_BYTES)))
        part = batch.slice(first, last - first)
        yield part.column(0), part.column(1).to_pylist()
        first = last


def heavy_keys(keys: list[np.ndarray], copies: list[int]) -> np.ndarray:
    """Keys that hold many of the documents whose sets have these keys and stand there so often."""
    name, at = np.unique(np.concatenate(keys), return_inverse=True)
    return name[np.bincount(at, np.repeat(copies, [len(k) for k in keys]), len(name)) >= HEAVY]


def _enter(shingle: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (part for batch in batches for part in _slices(batch)):
            sets = shingle_sets(texts, shingle)
            digest = [xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None for u in sets]
            known = ids.is_valid().to_pylist()
            copies = Counter(d for d, k in zip(digest, known, strict=True) if k)
            first = {d: i for i, (d, k) in reversed([*enumerate(zip(digest, known, strict=True))]) if k and d}
            none = np.zeros(0, np.int64)
            trees = [forest(u, percent) if known[i] and first.get(digest[i]) == i else [] for i, u in enumerate(sets)]
            if max(map(len, trees)) > PARTS:
                raise ValueError("sets of too many size classes can link at this percentage")
            keys = [k for t in trees for k, _ in t]
            heavy = heavy_keys([none, *keys], [0, *[copies[d] for d, t in zip(digest, trees, strict=True) for _ in t]])
            outer = np.append(0, np.cumsum([len(t) for t in trees])).astype(np.int32)
            inner = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(inner, pa.array(np.concatenate([none, *keys]), pa.int64()))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(u) for u in sets], pa.int64()), pa.array(digest, pa.binary()),
                pa.array([d and int.from_bytes(d[:8], "little", signed=True) & -PARTS for d in digest], pa.int64()),
                pa.ListArray.from_arrays(outer, lists), pa.array([[need for _, need in t] for t in trees], pa.list_(pa.int32())),
                pa.array([heavy if i == 0 else None for i in range(len(sets))], pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "set_id", "keys", "needs", "heavy"])
    return run


def _read_sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (part for batch in batches for part in _slices(batch)):
            sets = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(u) for u in sets], pa.int64()),
                                              pa.array([u.tobytes() for u in sets], pa.binary())], ["doc", "n", "shingles"])
    return run


# -- trees --------------------------------------------------------------------------------------

class Tree:
    """Binary trees, one per side, over sets sorted by size: per node its range, OR bitmap, size range and least
    bit count."""

    def __init__(self, sets: list[np.ndarray], sides: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        order = sorted(range(len(sets)), key=lambda i: (sides[i], len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0, i))
        self.order, self.sets = order, [sets[i] for i in order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        bits = 256
        while bits < 4 * max(1, int(self.size.max())):
            bits *= 2
        self.bitmap = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.bitmap, self.sets, strict=True):
            on = np.zeros(bits, bool)
            on[(s >> np.uint64(7)) & np.uint64(bits - 1)] = True
            row[:] = np.packbits(on).view(np.uint64)
        self.ones = np.bitwise_count(self.bitmap).sum(1).astype(np.int64)
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}
        cut = int((sides == sides.min()).sum())
        self.roots = [(0, cut), (cut, len(sets))] if cut < len(sets) else [(0, cut)]
        for root in self.roots:
            self._build(*root)

    def _build(self, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= LEAF:
            either = np.bitwise_or.reduce(self.bitmap[lo:hi], axis=0)
        else:
            either = self._build(lo, (lo + hi) // 2) | self._build((lo + hi) // 2, hi)
        self.nodes[lo, hi] = either, int(self.size[lo]), int(self.size[hi - 1]), int(self.ones[lo:hi].min())
        return either

    def may_link(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether some pair below could overlap enough: an upper bound from sizes and bitmaps."""
        (ea, la, ha, oa), (eb, lb, hb, ob) = self.nodes[a], self.nodes[b]
        p, need = self.percent, self.percent * (la + lb)
        shared = int(np.bitwise_count(ea & eb).sum())
        # a bit that a set has and the other side lacks stands for at least one shingle that is not shared
        most = min(ha, hb, ha - max(0, oa - shared), hb - max(0, ob - shared))
        return (100 + p) * most >= need and 100 * hb >= p * la and 100 * ha >= p * lb


def links(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None = None,
          percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that link and together connect all that links connect; items with one label count as connected.
    With two sides, only pairs across them are looked at."""
    if len(sets) < 2:
        return []
    tree = Tree(sets, np.zeros(len(sets), int) if sides is None else sides, percent)
    label = np.unique(labels, return_inverse=True)[1].astype(np.int64)[tree.order]
    found: list[tuple[int, int]] = []

    def compare(a: tuple[int, int], b: tuple[int, int]) -> None:
        i, j = slice(*a), slice(*b)
        shared = np.bitwise_count(tree.bitmap[i][:, None, :] & tree.bitmap[j][None, :, :]).sum(2).astype(np.int64)
        na, nb = tree.size[i][:, None], tree.size[j][None, :]
        most = np.minimum(na - tree.ones[i][:, None] + shared, nb - tree.ones[j][None, :] + shared)
        most = np.minimum(most, np.minimum(na, nb))
        likely = np.argwhere((100 + percent) * most >= percent * (na + nb))
        for x, y in likely.tolist():
            x, y = x + a[0], y + b[0]
            if (a == b and x >= y) or label[x] == label[y]:
                continue
            sx, sy = tree.sets[x], tree.sets[y]
            both = np.sort(np.concatenate([sx, sy]))
            same = int((both[1:] == both[:-1]).sum())
            if 100 * same >= percent * (len(sx) + len(sy) - same):
                found.append((tree.order[x], tree.order[y]))
                label[label == label[y]] = label[x]

    todo = [(tree.roots[0], tree.roots[-1])]
    while todo:
        a, b = todo.pop()
        la, lb = label[slice(*a)], label[slice(*b)]
        if la.min() == la.max() == lb.min() == lb.max():
            continue
        if a != b and not tree.may_link(a, b):
            continue
        big_a, big_b = a[1] - a[0] > LEAF, b[1] - b[0] > LEAF
        if not big_a and not big_b:
            compare(a, b)
        elif a == b:
            m = (a[0] + a[1]) // 2
            todo += [((a[0], m), (m, a[1])), ((m, a[1]), (m, a[1])), ((a[0], m), (a[0], m))]     # halves first
        elif big_a and (not big_b or a[1] - a[0] >= b[1] - b[0]):
            m = (a[0] + a[1]) // 2
            todo += [((m, a[1]), b), ((a[0], m), b)]
        else:
            m = (b[0] + b[1]) // 2
            todo += [(a, (m, b[1])), (a, (b[0], m))]
    return found


def _links_of(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of one tree; a document appears once however often it was sent."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["doc", "shingles"])
        doc = rows["doc"].to_numpy()
        sides = rows["block"].to_numpy() if "left" in rows else None
        pairs = links([np.frombuffer(s, np.uint64) for s in rows["shingles"]], rows["label"].to_numpy(), sides, percent)
        return pd.DataFrame({"u": [doc[i] for i, _ in pairs], "v": [doc[j] for _, j in pairs]}, dtype="int64")
    return run


# -- components ---------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(doc, label) for every end of an edge: the smallest document reachable. Alternates large and small stars
    until a round changes nothing; every round is written."""
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = digest(edges)
    while True:
        near = both(edges)
        least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = near.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = stage(low)
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stage(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        after = digest(edges)
        if after == before:
            break
        before = after
    labels = edges.select(F.col("u").alias("doc"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("label")).distinct())


def _meeting(entered: DataFrame) -> DataFrame:
    """(hub, set_id) of the nodes that share enough keys with others; the hub is the smallest node of a key."""
    entries = entered.select("set_id", F.posexplode("keys").alias("part", "list")).select(F.explode("list").alias("key"), (F.col("set_id") + F.col("part")).alias("id"))
    needs = entered.select("set_id", F.posexplode("needs").alias("part", "need")).select((F.col("set_id") + F.col("part")).alias("id"), "need").distinct()
    heavy = stage(entered.select(F.explode("heavy").alias("key")).distinct())
    node = lambda c: F.col(c).bitwiseAND(F.lit(-PARTS))
    key = Window.partitionBy("key")
    light = entries.join(heavy, "key", "left_anti").select("key", "id", F.min("id").over(key).alias("hub"), F.max("id").over(key).alias("top"))

    def hubs(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter(node("hub") < node("top")).select("key", "hub")

    often = stage(entries.join(heavy, "key", "left_semi").distinct())
    shared = stage(light.filter(node("hub") < node("top")).select("key", "id").distinct().unionByName(often.join(hubs(often).select("key"), "key", "left_semi").select("key", "id")))
    enough = stage(shared.groupBy("id").count().join(needs, "id").filter("count >= need").select("id"))
    kept = stage(shared.join(enough, "id", "left_semi"))
    return kept.join(hubs(kept), "key").select(node("hub").alias("hub"), node("id").alias("set_id")).filter("hub <> set_id").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; ``shingle`` words, ``percent`` the least similarity."""
    with small_broadcasts(docs.sparkSession, BROADCAST):
        return stage(_classes(docs, shingle, percent))


def sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids`` and few others: a bit per hash of an id tells. What reaches the driver has one
    size however many ids there are."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    found = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(SIEVE // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def among(bit: pd.Series) -> pd.Series:
        return pd.Series((shared.value[bit.to_numpy() >> 6] >> (bit.to_numpy() & 63)) & 1 == 1)

    return docs.where(among(bit))


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    with noted() as paths:
        entered = stage(docs.mapInArrow(_enter(shingle, percent),
                                        "doc_id long, n long, digest binary, set_id long, keys array<array<long>>, needs array<int>, heavy array<long>"))
    every = stage(entered.select("doc_id", "n", "digest", "set_id"))
    known = every.filter("doc_id is not null and n > 0")
    nodes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("set_id").alias("set_id"), F.first("n").alias("n")))
    met = stage(_meeting(entered))
    remove(docs.sparkSession, paths)            # the keys have met
    pairs = stage(met.join(nodes.select("set_id", F.col("node").alias("doc")), "set_id").select("hub", "doc"))
    centre = met.select("hub").distinct().join(nodes.select(F.col("set_id").alias("hub"), F.col("node").alias("centre"), "n"), "hub")
    sizes = stage(pairs.groupBy("hub").count().join(centre, "hub").select("hub", "centre", "count", _blocks(F.col("count"), F.col("n")).alias("blocks")))

    # written, so that Spark knows their size when it chooses how to fetch their texts; if it shuffles, then hardly more than these texts
    wanted = stage(pairs.select(F.col("doc").alias("doc_id")).unionByName(sizes.select(F.col("centre").alias("doc_id"))).distinct())
    sets = stage(sifted(docs, wanted).join(wanted, "doc_id", "left_semi").mapInArrow(_read_sets(shingle), "doc long, n long, shingles binary"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc")
    centres = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("doc"))
    trees = members.unionByName(centres).join(sets, "doc").withColumn("label", F.col("doc"))
    near = stage(trees.groupBy("hub", "block").applyInPandas(_links_of(percent), "u long, v long"))
    labels = stage(components(near))

    split = _still_split(pairs, sizes, labels)
    more = stage(split.join(sets, "doc").groupBy("hub", "left", "right").applyInPandas(_links_of(percent), "u long, v long"))
    # a document that repeats with different sets ties their nodes together
    of_set = known.select("doc_id", "digest").join(nodes, "digest").select("doc_id", "node").distinct()
    tied = of_set.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v")
    tied = of_set.join(tied.select("doc_id", "u"), "doc_id").select("u", F.col("node").alias("v"))
    final = components(near.unionByName(more).unionByName(tied))
    named = nodes.join(final, F.col("node") == F.col("doc"), "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    return every.select("doc_id", "n", "digest").join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _blocks(rows: Column, shingles: Column) -> Column:
    """Blocks for so many sets of about this size."""
    return F.ceil(F.greatest(rows / BLOCK_SETS, rows * shingles / BLOCK_SHINGLES, F.lit(1))).cast("int")


def _still_split(pairs: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (hub, left, right, block, doc, label) of the traversals still to be made in hubs with several blocks whose members are in
    several components. Members outside of the hub's largest component are blocked anew; each of their blocks meets itself, every other one
    and every block of the largest component, whose members need not meet each other. So a few strays cost one more visit."""
    rows = pairs.join(sizes.filter("blocks > 1"), "hub").join(labels, "doc", "left")
    rows = stage(rows.select("hub", "count", "blocks", "doc", F.coalesce("label", "doc").alias("label")))
    parts = rows.groupBy("hub", "label").agg(F.count("*").alias("part"))
    main = parts.groupBy("hub").agg(F.max_by("label", F.struct("part", "label")).alias("main"), F.max("part").alias("part"), F.count("*").alias("labels"))
    rows = rows.join(main.filter("labels > 1"), "hub")

    def blocks(count: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col("blocks") * count / F.col("count"))).cast("int")

    rows = rows.withColumns({"strays": blocks(F.col("count") - F.col("part")), "mains": blocks(F.col("part"))})
    stray = F.col("label") != F.col("main")
    rows = rows.withColumn("block", F.when(stray, F.pmod(F.xxhash64("doc"), F.col("strays")))
                           .otherwise(F.col("strays") + F.pmod(F.xxhash64("doc"), F.col("mains"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(stray, F.col("strays") + F.col("mains")).otherwise(F.col("strays")) - 1)).alias("other")
    return rows.select("hub", "doc", "label", "block", other).select(
        "hub", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "doc", "label")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; rows without an id stay."""
    kept = classes(docs, shingle, percent).filter("doc_id = component_id").select("doc_id").distinct()
    # the rows are dealt by their id in any case; the ids of the kept ones are too many to broadcast
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
