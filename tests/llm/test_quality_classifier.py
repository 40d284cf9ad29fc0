import math
import zlib

import numpy as np
from checktool import SF_DIR

from crosstide.llm import catalogue, quality_classifier as C


def test_updates_equal_the_plain_formulas():
    rng = np.random.default_rng(1)
    model, z, n = C.Leader.empty(), {}, {}
    for _ in range(60):
        i = np.append(np.sort(rng.choice(50, 8, replace=False)), C.BINS)
        x, y = np.append(rng.random(8), 1.0), float(rng.integers(2))
        model.learn(i, x, y)
        w = {}
        for k in i.tolist():
            a, b = z.get(k, 0.0), n.get(k, 0.0)
            w[k] = 0.0 if abs(a) <= C.L1 else -(a - math.copysign(C.L1, a)) / ((C.BETA + math.sqrt(b)) / C.ALPHA + C.L2)
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(i.tolist(), x))))
        for k, v in zip(i.tolist(), x.tolist()):
            g = (p - y) * v
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / C.ALPHA * w[k]
            n[k] = n.get(k, 0.0) + g * g
    keys = np.array(sorted(z))
    assert np.allclose(model.z[keys], [z[k] for k in keys]) and np.allclose(model.n[keys], [n[k] for k in keys])


def test_score_is_the_sparse_dot_product():
    w = np.random.default_rng(2).normal(size=C.BINS + 1)
    for text in ("a b c a b", "one", "", None, "  \n ", "x " * 30_000, "Ünï ÇÖ 漢字 12 a1!"):
        i, x = C.sparse(text)
        assert math.isclose(C.score(w, text), 1 / (1 + math.exp(-float(np.clip(w[i] @ x, -35, 35)))), rel_tol=1e-9)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in catalogue.QUERIES["op10_quality_classifier"](spark, SF_DIR).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.96
    good, bad = [got[i].score for i in held if labels[i]], [got[i].score for i in held if not labels[i]]
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_only_learnable_rows_and_repeats(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1][:4]
    rest = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:120]
    docs = [(i, ("good words here " if k % 2 else "BAD!! LOUD!! ") * 5) for k, i in enumerate(rest)] + [(i, "held") for i in ids]
    docs += [(rest[0], "another text of the same id"), (None, None), (9999, "")]
    labels = [(i, k % 2) for k, i in enumerate(rest)] + [(i, 0) for i in ids] + [(None, 1), (rest[2], None), (rest[1], 1)]
    d = spark.createDataFrame([(*x, "s", 3) for x in docs], "doc_id long, text string, _score string, score int")
    lab = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int")
    chosen = C.labelled(d, lab).collect()
    assert {r.doc_id for r in chosen} == set(rest) and not {r.doc_id for r in chosen} & set(ids)
    assert len({r.doc_id for r in C.labelled(d, lab, rows=20).collect()}) == 20
    flipped = lab.selectExpr("doc_id", f"case when doc_id in ({','.join(map(str, ids))}) then 1 - quality else quality end as quality", "toxic")
    assert np.array_equal(C.fit(d, lab), C.fit(d, flipped))
    kept = C.keep_good(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.report(d, none).collect()} == {0.5}
    assert C.report(d.limit(0), none).count() == 0 and C.keep_good(d.limit(0), none).count() == 0
