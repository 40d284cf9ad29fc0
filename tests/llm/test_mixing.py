import math
import random
from collections import Counter

import pytest
from checktool import SF_DIR, compare, connection
from pyspark.sql import functions as F

from crosstide.llm import catalogue, mixing as M

SCHEMA = "doc_id long, text string, source string, size string, _size int, position int"


def water(sizes):
    """Targets by resharing the excess round after round. ``sizes``: words per source, in code point order, null last."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in sizes}
        capped |= over


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("words", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 20, "d": 1, None: 400}, {"a": 3}, {"é": 50, "z": 50, None: 1}, {"a": 0, "b": 70}])
def test_targets_and_takes(spark, words):
    rows, i = [], 0
    for s, n in words.items():
        left = n
        while left > 0:
            k = min(left, 1 + i % 7)
            rows.append((i, "w " * k, s))
            left, i = left - k, i + 1
        rows.append((i, None if s else " ", s))
        i += 1
    got = M.report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    want = water({s: words[s] for s in sorted(words, key=lambda s: (s is None, s or ""))})
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == words[source[r.doc_id]]
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert sum(want.values()) == pytest.approx(sum(words.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3.5                           # half of the largest document


def test_whole_table_equals_sql(spark):
    assert compare(catalogue.QUERIES["op6_mix_sources"](spark, SF_DIR).toPandas(), connection().execute(M.SQL).df()) == ""


def check_takes(got, source, share=None):
    """No document that one more copy may be taken of fits into a source's gap; ``share``: of the target, the largest miss."""
    taken, target, more = Counter(), {}, {}
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        assert r.size == 0 or len([p for p in (r.positions or "").split(",") if p]) == r.taken // r.size
    for r in got:
        s = source[r.doc_id]
        if r.size and r.taken // r.size == min(x.taken // x.size for x in got if x.size and source[x.doc_id] == s) and r.taken < 3 * r.size:
            more.setdefault(s, []).append(r.size)
    for s, t in target.items():
        gap = t - taken[s]
        assert gap < min(more.get(s, [float("inf")])), (s, gap)
        assert share is None or abs(gap) <= share * t + 1, (s, gap, t)


def test_takes_go_past_a_very_long_document(spark):
    # the long ones fit into no gap, wherever they stand
    rows = [(i, "w " * 1000, "a") for i in range(120)] + [(1000 + i, "w " * 90_000, "a") for i in range(2)] + [(2000 + i, "w " * (1 + i % 37), "b") for i in range(900)]
    rows += [(4000 + i, "w " * (50 + i % 7), None) for i in range(200)]
    check_takes(M.report(frame(spark, rows)).collect(), {i: s for i, _, s in rows})


def test_given_tables_come_near_their_targets(spark):
    for sf, share in (("/root/testdata/sf0.001", 0.05), (SF_DIR, 0.005)):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        check_takes(M.report(docs).collect(), {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}, share)


def test_fixture_equals_sql(spark):
    import duckdb
    import pandas as pd
    rng = random.Random(4)
    rows = [(i // 2 if i % 5 == 0 else i, None if i % 31 == 0 else "w " * rng.choice([0, 1, 2, 3, 5, 8, 400, 401, 5000]), rng.choice(["a", "b", "c", "d", None])) for i in range(500)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    assert compare(M.report(frame(spark, rows)).toPandas(), con.execute(M.SQL).df()) == ""


def test_positions_invert_the_integrated_schedule(spark):
    shares = [i / 50 for i in range(51)]
    for weight, knots in M.CURRICULUM.items():
        col = M.position(F.col("s"), F.lit(weight))
        got = [r.t for r in spark.createDataFrame([(s,) for s in shares], "s double").select(col.alias("t")).collect()]
        def due(t, knots=knots):
            done = 0.0
            for (t0, a), (t1, b) in zip(knots, knots[1:]):
                x = min(max(t - t0, 0), t1 - t0)
                done += a * x + (b - a) / (t1 - t0) * x * x / 2
            return done
        for s, t in zip(shares, got, strict=True):
            assert 0 <= t <= 1 and math.isclose(due(t) / due(1.0), s, abs_tol=1e-9)


def test_mix_emits_copies_in_training_order(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(300)]
    docs = frame(spark, rows)
    out = M.mix(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: r.taken // max(1, r.size) for r in M.report(docs).collect()}
    assert copies == Counter({k: v for k, v in want.items() if v})
    order = [r.source for r in out.collect()]
    first, last = Counter(order[:80]), Counter(order[-80:])
    assert first["a"] > last["a"] and first["c"] < last["c"]       # a is weighted towards the start, c towards the end


def test_repeats_and_empty_table(spark):
    rows = [(1, "a b", None)] * 4 + [(None, "c", "x"), (None, None, None)]
    out = M.report(frame(spark, rows)).collect()
    assert len(out) == 6 and sum(r.taken for r in out) <= 30
    assert M.report(frame(spark, [])).count() == 0 and M.mix(frame(spark, [])).count() == 0
    assert M.mix(frame(spark, rows)).count() == sum(r.taken // max(1, r.size) for r in out if r.size) + sum(
        1 for r in M.mix(frame(spark, rows)).collect() if not (r.text or "").strip())
