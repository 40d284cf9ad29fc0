"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's features are its words and pairs of neighbouring words, once as written and once as shapes (runs of
small letters, capitals and digits each become one mark), and the pair of a word with itself. All are
hashed into ``BINS`` bins; a text's vector holds counts divided by their number, so its score does not grow with its
length. Texts are scored as sparse dot products.

The fit takes at most ``FIT_ROWS`` labelled texts: of each class the half with the smallest hashes
of their ids. These go to ``SHARDS`` groups; each runs the per-coordinate proximal updates over its texts in hash
order, ``EPOCHS`` times, and the weights are averaged. Everything else covers all rows: scoring is one pass
without a shuffle.

Defined cases: a null or blank text has no features and scores the bias, i.e. what an
average labelled text would get. Labels that are null, or belong to several rows of one id, count once
per id (the largest). Without any usable label every score is 0.5. Repeated rows score alike. An empty
table gives an empty result. Input columns are kept by ``scored``; its two results take names
that no input column has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crosstide.llm.common import fresh
from crosstide.session import stage

BINS = 1 << 18
FIT_ROWS = 8000
SHARDS = 4
EPOCHS = 3
SCALE = 16.0            # a text's features sum to this
CACHED_WORDS = 200_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-5


class _Words(dict):
    """Word -> (hash, hash of its shape); emptied when full, so its memory is bounded."""
    SHAPES = {**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{str(d): "0" for d in range(10)}}

    def __missing__(self, word: str) -> int:
        marks = [self.SHAPES.get(c) or ("a" if c.islower() else "A" if c.isupper() else c) for c in word]
        shape = "".join(m for i, m in enumerate(marks) if i == 0 or marks[i - 1] != m)
        if len(self) >= CACHED_WORDS:
            self.clear()
        pair = (xxhash.xxh32_intdigest(word) << 32) | xxhash.xxh32_intdigest(shape, 7)
        self[word] = pair
        return pair


_WORDS = _Words()


def bins(text: str | None) -> np.ndarray:
    """The bins of a text's features, one entry per occurrence."""
    found = (text or "").split()
    if not found:
        return np.zeros(0, np.int64)
    pair = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    out = []
    for salt, h in ((1, pair >> np.uint64(32)), (2, pair & np.uint64(0xFFFFFFFF))):
        h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        out += [h >> np.uint64(46), ((h[:-1] ^ (h[1:] * np.uint64(3))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)]
        if salt == 1:
            out.append(np.full(int((h[1:] == h[:-1]).sum()), 1, np.uint64))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Leader:
    """Per-coordinate follow-the-regularised-leader for logistic loss; the last coordinate is the bias."""
    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Leader:
        return cls(np.zeros(BINS + 1), np.zeros(BINS + 1))

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        step = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - step * w
        self.n[i] += g * g


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins with their values, the bias last."""
    i, c = np.unique(bins(text), return_counts=True)
    return np.append(i, BINS), np.append(SCALE * c / max(1, c.sum()), 1.0)


def _fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "doc_id"])
    examples = [(*sparse(t), float(y)) for t, y in zip(rows["text"], rows["label"], strict=True)]
    model = Leader.empty()
    for _ in range(EPOCHS):
        for i, x, y in examples:
            model.learn(i, x, y)
    used = np.flatnonzero(model.n)
    return pd.DataFrame({"bin": used, "weight": model.weights(used)})


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, half of each class, by the hash of their ids.

    The chosen ids are written first: a table of known, bounded size, which Spark then joins
    without moving the texts.
    """
    one = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    one = one.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("h", F.xxhash64("doc_id"))
    half = [one.filter(F.col("label") == y).orderBy("h", "doc_id").limit(rows // 2) for y in (0, 1)]
    ids = stage(half[0].unionByName(half[1]))
    return docs.select("doc_id", "text").join(ids, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Averaged weights of the shards, bias last; at most BINS + 1 numbers reach the driver."""
    chosen = labelled(docs, labels, rows)
    # one text per id, whichever of an id's copies sorts first
    chosen = chosen.groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).withColumn("shard", F.pmod("h", F.lit(SHARDS)))
    parts = chosen.groupBy("shard").applyInPandas(lambda part: _fit_shard(part), "bin long, weight double")
    out = np.zeros(BINS + 1)
    for row in parts.groupBy("bin").agg(F.sum("weight").alias("w")).collect():
        out[row["bin"]] = row["w"] / SHARDS
    return out


def score(weights: np.ndarray, text: str | None) -> float:
    i = bins(text)
    s = weights[BINS] + (SCALE * weights[i].sum() / len(i) if len(i) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(s, -35, 35))))


def scored(docs: DataFrame, weights: np.ndarray) -> tuple[DataFrame, str]:
    """``docs`` with a score column (a fresh name), in one pass over Arrow batches."""
    name = fresh(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            values = pa.array([score(w, t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` double"), name


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with the columns they came with."""
    out, name = scored(docs, fit(docs, labels))
    return out.filter(F.col(name) >= least).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document; held-out rows are never learned from."""
    narrow = docs.select("doc_id", "text")
    out, name = scored(narrow, fit(narrow, labels))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), F.col(name).alias("score"),
                      (F.col(name) >= 0.5).cast("int").alias("predicted"))
