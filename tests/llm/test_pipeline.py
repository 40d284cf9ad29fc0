import re
import zlib
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from crosstide.llm import packing, quality_classifier, quality_rules
from crosstide.session import stage

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, step in P.STAGES:
        out.append((name, docs, stage(step(spark, docs, SMALL))))         # written before the next stage is called
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_effects(steps):
    names = [n for n, _ in P.STAGES]
    for n in names[:-1]:
        before, after = steps[n]
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() > 0
    for n in names[:3]:
        before, after = steps[n]
        assert not ids(after) - ids(before) and sum(ids(after).values()) <= sum(ids(before).values())


def test_rules_and_classifier_stages(spark, steps):
    before, after = steps["quality_rules"]
    assert ids(after) == Counter(r.doc_id for r in quality_rules.report(before).filter("kept").collect())
    before, after = steps["quality_classifier"]
    w = quality_classifier.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(after) == Counter(r.doc_id for r in before.collect() if quality_classifier.score(w, r.text) >= 0.5)


def test_mix_and_pack_stages(steps):
    before, after = steps["mix_sources"]
    assert max(ids(after).values()) <= 3 and not set(ids(after)) - set(ids(before))
    docs, pieces = steps["pack"]
    got = pieces.toPandas()
    assert Counter(got[got.start == 0].doc_id) == ids(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    encode = packing.encoder(__import__("public_tokenizers").path(packing.RANKS), __import__("public_tokenizers").PATTERN).batch
    for r in got.head(50).itertuples():
        assert r.ids_crc32 == zlib.crc32(encode([texts[r.doc_id]])[0][r.start:r.start + r.length].tobytes())


def test_run(spark, steps):
    total = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()))
    assert total(P.run(spark, SMALL)) == total(steps["pack"][1])


def test_extra_columns_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"_score": F.lit("x"), "kept": F.lit(1), "size": F.lit(None).cast("int"), "position": F.lit(2)})
    nothing = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes]).limit(2)
    for _, step in P.STAGES[:-1]:
        out = step(spark, docs.unionByName(nothing), SMALL)
        assert out.columns == docs.columns and out.count() > 0
        assert step(spark, docs.limit(0), SMALL).count() == 0
    assert P.pack(spark, docs.limit(0), SMALL).count() == 0


def test_pack_stage_keeps_the_training_order(spark, tmp_path):
    rows = [(i, f"w{i} " * (1 if i < 200 else 400), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")     # the larger files are written last
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        got = P.pack(spark, spark.read.parquet(f"{tmp_path}/docs"), SMALL).filter("start = 0").collect()
    finally:
        spark.conf.set(key, was)
    task = {r.doc_id: r.sequence_id >> 40 for r in got}
    assert len(task) == 400 and len(set(task.values())) > 1
    assert [task[i] for i in range(400)] == sorted(task.values())


def near_copies():
    """Texts whose copies lie on both sides of 0.8 on five words; 0.87 there is below 0.9 on three."""
    base = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    return [base, base + [f"x{i}" for i in range(60)], other, other + [f"y{i}" for i in range(98)], other + [f"z{i}" for i in range(110)],
            base[:200] + ["q"] + base[201:] + ["q"] * 9, [f"u{i}" for i in range(4)], [f"u{i}" for i in range(4)] + ["t"]]


def test_join_stage_takes_five_words_and_four_fifths(spark, steps):
    before, after = steps["ngram_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    made = [(10 ** 9 + i, " ".join(w)) for i, w in enumerate(near_copies())]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], before.schema)
    sets = {}
    for i, t in rows + made:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((label[a], label[b]))
                label = {k: p if v == q else v for k, v in label.items()}
    got = set(ids(P.near_duplicates(spark, before.unionByName(extra), SMALL)))
    assert got == set(label.values()) and 10 ** 9 in got and 10 ** 9 + 1 not in got
    assert set(ids(after)) == {v for v in label.values() if v < 10 ** 9}
