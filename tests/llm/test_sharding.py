import math
import struct
import zlib
from collections import Counter

import xxhash
from checktool import SF_DIR

from crosstide.llm import catalogue, sharding as S

SCHEMA = "doc_id long, text string, shard int, slot int, _placed string"


def draw(key, level, node, weight):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for part in (level, node):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", part), seed)
    return -math.log(((seed >> 11) + 0.5) / 2 ** 53) / weight


def brute(key, tree):
    """Descends level by level: the node with the earliest draw, at the rate of the weight below it."""
    nodes = tree
    for level, name in enumerate(("region", "rack", "number")):
        weight = Counter()
        for s in nodes:
            weight[getattr(s, name)] += s.weight
        best = min(weight, key=lambda n: (draw(key, level, n, weight[n]), n))
        nodes = [s for s in nodes if getattr(s, name) == best]
    return nodes[0].number


def test_moves_stay_in_subtrees_whose_weights_change():
    for grown in (S.topology(17) + [S.Shard(17, 0, 0)], [S.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else 1.0) for s in S.topology(16)]):
        before = S.topology(17) if len(grown) == 18 else S.topology(16)
        path = {s.number: (s.region, s.rack, s.number) for s in grown}
        changed = next(s for s in grown if s.number == (17 if len(grown) == 18 else 5))
        moved = 0
        for key in range(3000):
            a, b = path[brute(key, before)], path[brute(key, grown)]
            if a != b:
                moved += 1
                # where the two paths part, the new one enters the node that became heavier
                level = next(i for i in range(3) if a[i] != b[i])
                assert b[:level + 1] == (changed.region, changed.rack, changed.number)[:level + 1]
        assert 0 < moved < 1500


def test_descent_equals_brute_force(spark):
    ids = [*range(-50, 400), 2 ** 40, None]
    got = S.report(spark.createDataFrame([(i, "x", 1, 2, "c") for i in ids], SCHEMA)).collect()
    assert {r.doc_id: r.shard for r in got} == {i: brute(i, S.topology(16)) for i in ids}
    assert {r.doc_id: r.grown_shard for r in got} == {i: brute(i, S.topology(17)) for i in ids}
    for r in got:
        assert r.grown_shard in (r.shard, 16) and r.rack == r.shard // 4 and r.region == r.shard // 8


def test_slots_sizes_and_repeats(spark):
    rows = [(5, "é", 0, 0, "")] * 3 + [(6, None, 0, 0, ""), (7, "", None, None, None), (None, "y" * 100_000, 0, 0, "")] + [(i, "t", 0, 0, "") for i in range(100, 400)]
    got = S.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    one = {r.doc_id: r for r in got}
    assert (one[5].size, one[6].size, one[7].size, one[None].size) == (3, 1, 1, 100_001)
    assert one[5].text_crc32 == zlib.crc32("é".encode()) and one[6].text_crc32 == 0
    assert S.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_weights_give_shares_and_moves_stay_in_the_changed_subtree(spark):
    ids = spark.range(20_000)
    tree = [S.Shard(i, i // 4, i // 2, 1.0 + (i == 3)) for i in range(8)]
    heavier = [S.Shard(s.number, s.region, s.rack, s.weight * (3 if s.number == 5 else 1)) for s in tree]
    out = ids.select("id", S.descend(ids["id"], tree)["shard"].alias("a"), S.descend(ids["id"], heavier)["shard"].alias("b")).collect()
    n = Counter(r.a for r in out)
    assert abs(n[3] / 20_000 - 2 / 9) < 0.02 and abs(n[0] / 20_000 - 1 / 9) < 0.02
    moved = [r for r in out if r.a != r.b]
    assert moved and all(r.b // 4 == 1 for r in moved)                                     # into the region of the heavier shard,
    assert all(r.b // 2 == 2 for r in moved if r.a // 4 == 1) and all(r.b == 5 for r in moved if r.a // 2 == 2)     # rack and shard


def test_whole_table(spark):
    got = catalogue.QUERIES["op9_shard"](spark, SF_DIR).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got.shard) == set(range(16)) and set(got.law) == {"key"}
