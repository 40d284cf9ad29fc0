import random
import re

import numpy as np
import pandas as pd
import pytest
from checktool import SF_DIR
from hypothesis import given, settings, strategies as st

from crosstide.llm import catalogue, signature_tree as J

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, n string, component_id string, digest int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Component of every id, from all pairs."""
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def variants(seed, words, copies, edits):
    """Near copies, each made from the one before it: a chain whose ends need not be similar."""
    rng, out = random.Random(seed), [words]
    for _ in range(copies):
        w = list(out[-1])
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(w)
    return [" ".join(w) for w in out]


def corpus():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(12):
        base = [f"d{k}w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 150, 400]))]
        texts += variants(k, base + (passage if k % 3 == 0 else []), rng.randrange(8), rng.choice([0, 1, 2]))
    texts += ["", None, "  \n", "One", "one", "one two", "ONE Two", "one two three", "É x y z", "é x y z"]
    return list(enumerate(texts))


def compare(spark, rows):
    got = J.classes(spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)).toPandas()
    want = brute(rows)
    for r in got.itertuples():
        if pd.isna(r.doc_id):
            assert pd.isna(r.component_id)
        else:
            assert r.component_id == want[int(r.doc_id)]
    assert sorted(got.n_shingles) == sorted(len(shingles(t)) for _, t in rows)


def test_classes_equal_brute_force(spark):
    compare(spark, corpus())


def test_small_blocks_and_cross_block_trees(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", 3)
    compare(spark, [(i, t) for i, t in enumerate(variants(1, [f"w{i}" for i in range(120)], 25, 1))] + [(None, "a b c d"), (None, None)])


def test_repeated_ids_and_rows(spark):
    a, b = "a b c d e", "v w x y z"
    got = {(r.doc_id, r.n_shingles): r.component_id for r in J.classes(spark.createDataFrame(
        [(4, a, "", "", 0), (4, b, "", "", 0), (2, a, "", "", 0), (9, b, "", "", 0), (9, b, "", "", 0)], SCHEMA)).collect()}
    assert set(got.values()) == {2}


def test_very_long_text_and_empty_table(spark):
    long = [f"w{i * i % 50021}" for i in range(40_000)]
    compare(spark, [(1, " ".join(long)), (2, " ".join(long[:-500])), (3, " ".join(long[9000:]))])
    empty = spark.createDataFrame([], SCHEMA)
    assert J.classes(empty).count() == 0 and J.keep_one(empty).count() == 0


def test_keep_one(spark):
    rows = [(1, "a b c d", "x", "y", 1), (1, "a b c d", "x", "y", 1), (5, "A b c d", "x", "y", 1), (6, "", "x", "y", 1), (7, None, "x", "y", 1), (None, "a b c d", "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 6), (False, 7), (True, 0)]


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").toPandas()
    got = catalogue.QUERIES["op7_ngram_join"](spark, SF_DIR).toPandas()
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)))
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want


@given(st.integers(3, 600), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10 ** 6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_meet_in_the_forest(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    y = np.union1d(x[min(drop, len(x) - 1):] if seed % 2 else rng.permutation(x)[min(drop, len(x) - 1):], rng.integers(0, 1 << 63, add, dtype=np.uint64))
    same = len(np.intersect1d(x, y))
    if 100 * same >= 90 * (len(x) + len(y) - same) and len(np.setxor1d(x, y)):
        assert set(J.forest_keys(x).tolist()) & set(J.forest_keys(y).tolist())


@given(st.integers(0, 10 ** 6), st.integers(2, 90), st.booleans())
@settings(max_examples=60, deadline=None)
def test_tree_connects_what_all_pairs_connect(seed, count, labelled):
    rng = np.random.default_rng(seed)
    pool = [np.unique(rng.integers(0, 1 << 62, int(rng.integers(5, 200)), dtype=np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(count):
        base = pool[int(rng.integers(4))]
        sets.append(np.union1d(base[rng.random(len(base)) > 0.03], rng.integers(0, 1 << 62, int(rng.integers(0, 4)), dtype=np.uint64)))
    labels = rng.integers(0, 3, count) if labelled else np.arange(count)

    def classes(pairs):
        label = {i: int(v) for i, v in enumerate(labels)}
        for a, b in pairs:
            p, q = label[a], label[b]
            label = {k: (p if v == q else v) for k, v in label.items()}
        groups = {}
        for k, v in label.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    everything = []
    for a in range(count):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            if 100 * same >= 90 * (len(sets[a]) + len(sets[b]) - same):
                everything.append((a, b))
    found = J.links(sets, labels)
    assert set(map(frozenset, found)) <= set(map(frozenset, everything))
    assert classes(found) == classes(everything)


def test_a_bound_never_hides_a_link():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
    sets = [base, base[5:], base[:-9], rng.integers(0, 1 << 62, 300, dtype=np.uint64)] + [base[k:] for k in range(40)]
    tree = J.Tree(sets, np.zeros(len(sets), int))
    for a in tree.nodes:
        for b in tree.nodes:
            pairs = [(x, y) for x in range(*a) for y in range(*b)]
            near = any(10 * len(np.intersect1d(tree.sets[x], tree.sets[y])) >= 9 * len(np.union1d(tree.sets[x], tree.sets[y])) for x, y in pairs)
            assert tree.may_link(a, b) or not near


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 300), (300, 200), (200, 100), (7, 7)]
    got = {r.doc: r.label for r in J.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


@given(st.integers(1, 10 ** 6), st.integers(0, 10 ** 6))
@settings(max_examples=300, deadline=None)
def test_partners_share_a_cut_for_their_difference(n, more):
    m = min(n + more, n * 10 // 9)
    shared = set(J.classes_of(n)) & set(J.classes_of(m))
    own = J.classes_of(m)[0]
    assert own in shared and len(J.classes_of(n)) <= 2
    slack, inner = J.cut(own)
    differ = (n + m) // 19
    assert differ == 0 or len(inner) + 1 >= differ + 1 + slack


def test_heavy_keys_find_their_hubs_too(spark, monkeypatch):
    # near copies whose keys every slice repeats, besides texts of their own; exact copies enter once per slice
    near = variants(3, [f"w{i}" for i in range(90)], 30, 1)
    other = [" ".join(f"o{k}x{i}" for i in range(60)) for k in range(20)]
    rows = list(enumerate(near + other + near[:1] * 25 + other[:3]))
    entered = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").coalesce(1).mapInArrow(
        J._enter(3, 90), "doc_id long, n long, digest binary, set_id long, keys array<array<long>>, needs array<int>, heavy array<long>").toPandas()
    assert sum(len(h) for h in entered.heavy if h is not None) > 0 and (entered["keys"].map(len) > 0).sum() == 51
    compare(spark, rows)
    monkeypatch.setattr(J, "HEAVY", 10 ** 9)            # and with every key in the window
    compare(spark, rows)


def test_strays_meet_every_block(spark):
    pairs = spark.createDataFrame([(7, d) for d in range(60)], "hub long, doc long")
    sizes = spark.createDataFrame([(7, 99, 60, 6), (8, 98, 5, 1)], "hub long, centre long, count long, blocks int")
    labels = spark.createDataFrame([(d, 0) for d in range(50)] + [(51, 50), (50, 50)], "doc long, label long")
    rows = J._still_split(pairs, sizes, labels).toPandas()
    groups = {k: set(g.doc) for k, g in rows.groupby(["left", "right"])}
    for a in range(50, 60):
        for b in range(60):
            assert a == b or any({a, b} <= g for g in groups.values())
    assert (rows[rows.doc < 50].groupby("doc").size() == 1).all()        # one block of strays: the others are sent once


def test_two_sides_are_compared_across_only():
    rng = np.random.default_rng(9)
    a, b = (np.unique(rng.integers(0, 1 << 62, 100, dtype=np.uint64)) for _ in range(2))
    sets, sides = [a, a[1:], b, b[1:], a[2:], b[2:]], np.array([0, 0, 0, 0, 4, 4])
    found = J.links(sets, np.arange(6), sides)
    assert {frozenset(p) for p in found} <= {frozenset(p) for p in [(0, 4), (1, 4), (2, 5), (3, 5)]} and len(found) == 4


@given(st.integers(5, 600), st.integers(0, 120), st.integers(0, 120), st.integers(0, 10 ** 6))
@settings(max_examples=300, deadline=None)
def test_linked_sets_meet_in_the_forest_at_80_percent(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    y = np.union1d(rng.permutation(x)[min(drop, len(x) - 1):], rng.integers(0, 1 << 63, add, dtype=np.uint64))
    same = len(np.intersect1d(x, y))
    if 100 * same >= 80 * (len(x) + len(y) - same) and len(np.setxor1d(x, y)):
        assert set(J.forest_keys(x, 80).tolist()) & set(J.forest_keys(y, 80).tolist())
    # few sets leave more segments empty than the slack: an empty segment would bring all of its class together
    assert all(len(J.cut(c, 80)[1]) < n for c in J.classes_of(n, 80))


@given(st.sampled_from([80, 90]), st.integers(3, 600), st.integers(0, 120), st.integers(0, 120), st.integers(0, 10 ** 6))
@settings(max_examples=400, deadline=None)
def test_linked_sets_share_as_many_keys_as_both_need(percent, n, drop, add, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    y = np.union1d(rng.permutation(x)[min(drop, len(x) - 1):], rng.integers(0, 1 << 63, add, dtype=np.uint64))
    same = len(np.intersect1d(x, y))
    if 100 * same >= percent * (len(x) + len(y) - same) and len(np.setxor1d(x, y)):
        a, b = J.forest(x, percent), J.forest(y, percent)
        shared = [(len(set(k.tolist()) & set(m.tolist())), need, want) for k, need in a for m, want in b]
        assert any(s >= need and s >= want and s > 0 for s, need, want in shared)


def test_shingles_of_five_words():
    a, b, c = J.shingle_sets(["a b c d e f", "A b c d e g", "a b c d"], 5)
    assert (len(a), len(b), len(c), len(np.intersect1d(a, b))) == (2, 2, 1, 1)


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Whatever the caller's limit, the driver makes hash tables of small files only; the ids of the kept documents are merged."""
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in corpus()], SCHEMA)
    before, seen, stage = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], J.stage
    monkeypatch.setattr(J, "stage", lambda df: (seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")), stage(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = J.keep_one(docs)
        assert set(seen) == {str(J.BROADCAST)} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10m"
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == sorted({c for c in brute(corpus()).values()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sieve_passes_every_wanted_row(spark):
    docs = spark.createDataFrame([(i if i % 50 else None, str(i)) for i in range(5000)], "doc_id long, text string")
    ids = docs.where("doc_id % 7 = 3").select("doc_id")
    got = {r.doc_id for r in J.sifted(docs, ids).collect()}
    assert {r.doc_id for r in ids.collect()} <= got and len(got) < 900
