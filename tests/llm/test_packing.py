import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from checktool import SF_DIR
from hypothesis import given, settings, strategies as st

from crosstide.llm import packing

ODD = ["a  b \n\n c", "  x", " y ", "\n\tq  ", " ", "", "a\xa0b\x1cc  d", "<|endoftext|> hi", "don't  it's a's", "a.\nb,c.. d,.", None, "\n",
       "a\x1cb c d", "x\n", "é. ß, 1. 2,", "'s. he's. 'll,", "á. b", "x ", "a b ", "q\n", "漢字 かな", "tab\there", " x y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def ours(texts):
    return packing.encoder(public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN).batch(texts)


def test_ids_are_those_of_the_tokenizers_library(spark, library):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").limit(300).collect()]
    for text, ids in zip(texts, ours(texts), strict=True):
        assert ids.tolist() == library(text), text


@given(st.lists(st.lists(st.sampled_from([*"ab.,'s1 \n\té\xa0漢", "<|endoftext|>"]), max_size=30).map("".join), max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_of_any_text(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    test_ids_of_any_text.t = t
    for text, ids in zip(texts, ours(texts), strict=True):
        assert ids.tolist()[:-1] == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 5000), max_size=60))
@settings(max_examples=150, deadline=None)
def test_places_hold_every_token_once(lengths):
    sequences = packing.place(lengths)
    seen = {d: [] for d in range(len(lengths))}
    for s in sequences:
        assert 0 < sum(p[2] for p in s) <= packing.LENGTH
        for d, start, n in s:
            assert n > 0
            seen[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at
            at += k
        assert at == n
    rests = sum(n % packing.LENGTH for n in lengths)
    assert len(sequences) == sum(n // packing.LENGTH for n in lengths) + -(-rests // packing.LENGTH)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(50, 1500, 2000).tolist()
    costs = [sum(packing.cost(p[2]) for p in s) for s in packing.place(lengths)]
    greedy, room = [], 0
    for n in lengths:                                      # sequences filled in the given order
        if room < n:
            greedy.append(0.0)
            room = packing.LENGTH
        greedy[-1] += packing.cost(n)
        room -= n
    assert np.std(costs) < np.std(greedy) and len(costs) < len(greedy)


def packed(spark, rows, schema="doc_id long, text string, lang string, length long", **kw):
    return packing.pack(spark.createDataFrame(rows, schema), **kw).toPandas()


def test_pieces_of_a_table(spark, library):
    texts = [*ODD, "word " * 30_000, "word " * 30_000, "word"]
    got = packed(spark, [(i, t, None, 5) for i, t in enumerate(texts)], window=20_000)
    for i, text in enumerate(texts):
        ids = np.array(library(text), "<u4")
        mine = got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum()[:-1]] and mine.length.sum() == len(ids)
        assert (mine.doc_tokens == len(ids)).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= packing.LENGTH


def test_null_ids_repeats_and_empty_table(spark):
    got = packed(spark, [(None, "a b", "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1), (None, None, None, None)])
    assert got.length.sum() == 3 + 3 + 3 + 1 and got.doc_id.isna().sum() == 2
    assert len(packed(spark, [])) == 0


def test_little_padding_over_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = packing.pack(docs).toPandas()
    assert got.length.sum() / (packing.LENGTH * got.sequence_id.nunique()) > 0.995
    assert pd.Index(got.doc_id).nunique() == docs.count()
