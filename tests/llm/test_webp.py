import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from checktool import SF_DIR
from hypothesis import given, settings, strategies as st

from crosstide.llm import catalogue, webp as W

sys.path.insert(0, str(Path(__file__).resolve().parent))
import webp_writer as writer  # noqa: E402

SCHEMA = "doc_id long, text string, media string, n_bytes string"


def picture(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (height, width))]
    y, x = np.mgrid[:height, :width]
    smooth = np.stack([3 * x + y, 2 * y, x * y // 4, 255 - x], axis=2)
    return ((smooth + rng.integers(0, 3, smooth.shape)) % 256).astype(np.uint8)


def same(pixels, **how):
    assert np.array_equal(W.decode(writer.encode(pixels, **how)), pixels)


@pytest.mark.parametrize("how", [{}, {"references": False}, {"cache_bits": 4}, {"cache_bits": 11, "references": False}, {"tile_bits": 2}, {"tile_bits": 3, "cache_bits": 6}, {"green": True}])
def test_codes_references_and_cache(how):
    same(picture(1, 13, 17), **how)
    same(np.tile(picture(2, 4, 6, 5), (4, 5, 1)), **how)
    same(np.zeros((1, 1, 4), np.uint8), **how)
    same(np.full((30, 200, 4), 7, np.uint8), **how)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    same(picture(mode, 9, 11), predictor=(2, np.full((3, 3), mode)))


def test_prediction_rules_by_hand():
    n = lambda *v: np.array(v)
    l, t, r, c = n(10, 20, 30, 40), n(13, 250, 0, 41), n(1, 2, 3, 4), n(200, 100, 5, 40)
    want = {0: [255, 0, 0, 0], 1: [10, 20, 30, 40], 2: [13, 250, 0, 41], 3: [1, 2, 3, 4], 4: [200, 100, 5, 40],
            5: [(5 + 13) // 2, (11 + 250) // 2, (16 + 0) // 2, (22 + 41) // 2], 6: [105, 60, 17, 40], 7: [11, 135, 15, 40], 8: [106, 175, 2, 40],
            9: [7, 126, 1, 22], 10: [(105 + 7) // 2, (60 + 126) // 2, (17 + 1) // 2, (40 + 22) // 2],
            12: [0, 170, 25, 41], 13: [0, 152, 20, 40]}
    for mode, v in want.items():
        assert W.predict(mode, l, t, r, c).tolist() == v, mode
    assert W.predict(11, l, t, r, c).tolist() == t.tolist()                  # 187+150+5+1 against 190+80+25+0


def test_transforms_together():
    p = picture(3, 12, 15)
    rng = np.random.default_rng(4)
    cross = (3, rng.integers(0, 256, (2, 2, 4), dtype=np.uint8))
    modes = (2, rng.integers(0, 14, (3, 4)))
    same(p, cross=cross)
    same(p, predictor=modes, cross=cross, green=True, cache_bits=5, tile_bits=2)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    p = picture(colours, 11, 13, colours)
    same(p, palette=True)
    same(p, palette=True, cache_bits=3)
    wide = -(-13 // (1 << W.packing_bits(colours)))
    same(p, palette=True, predictor=(2, np.full((3, -(-wide // 4)), 11)))


def test_near_distances_are_those_of_the_format():
    assert W.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(W.NEAR) == 120 and W.NEAR[-1] == (8, 7) and W.NEAR.index((8, 0)) < W.NEAR.index((4, 7)) < W.NEAR.index((8, 1)) < W.NEAR.index((8, 2))


@given(st.binary(max_size=3000))
@settings(max_examples=120, deadline=None)
def test_any_content_comes_back(content):
    back = b"".join(i.tobytes() for i in W.load(W.store(content)))
    assert back.startswith(content) and len(back) % 64 == 0 and not back[len(content):].strip(b"\0")


def test_the_two_readers_agree(monkeypatch):
    for content in (b"", b"abc" * 50, bytes(range(256)) * 4, "text é\n".encode() * 90):
        media = W.store(content)
        quick = W.load(media)
        with monkeypatch.context() as m:
            m.setattr(W, "_read_flat", lambda bits, codes, total: W._read_symbols(bits, [codes], 1, total, 0, 0, None))
            assert all(np.array_equal(a, b) for a, b in zip(quick, W.load(media), strict=True))


def walk(seed, rows, **steps):
    rng = np.random.default_rng(seed)
    green = rng.integers(-6, 7, (rows, 16))
    parts = {"green": green, "half": green * 16 >> 5, "same": green, "noise": rng.integers(0, 2, green.shape)}
    return np.stack([np.cumsum(parts[steps[c]].ravel()).reshape(rows, 16) % 256 for c in ("red", "green", "blue", "alpha")], axis=2).astype(np.uint8)


def test_the_writer_uses_every_part_of_the_method(monkeypatch):
    used = set()

    def spy(name, of=lambda *a: True):
        whole = getattr(W, name)
        monkeypatch.setattr(W, name, lambda *a, **k: (used.add(name) if of(*a) else None, whole(*a, **k))[1])
    spy("put_pixels", lambda out, argb, *a: len(W.references(argb)))
    for name in ("undo_predictor", "undo_cross_colour", "undo_subtract_green", "undo_indexing"):
        spy(name)
    spy("_read_group", lambda bits, codes, width, total, cache_bits: cache_bits)

    def parts(content):
        used.clear()
        assert b"".join(i.tobytes() for i in W.load(W.store(content)))[:len(content)] == content
        return set(used)

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, 4 * n, dtype=np.uint8)) for n in (1, 1, 2, 3, 4) for _ in range(12)]
    text = b"".join(words[i] for i in rng.integers(0, len(words), 600))
    assert parts(text) >= {"put_pixels", "_read_group"} and len(W.store(text)) < 0.5 * len(text)
    assert parts(walk(1, 60, red="half", green="green", blue="half", alpha="noise").tobytes()) >= {"undo_predictor", "undo_cross_colour"}
    assert parts(walk(2, 60, red="same", green="green", blue="same", alpha="noise").tobytes()) >= {"undo_predictor"}
    same = rng.integers(0, 256, (60, 16, 1), dtype=np.uint8).repeat(4, axis=2)
    assert "undo_subtract_green" in parts(same.tobytes())
    assert "undo_indexing" in parts(b"abcdefgh" * 40)


def test_code_lengths_follow_the_counts():
    out = W.Out()
    _, lengths = W.put_code(out, np.array([100, 1, 1, 20, 0, 5]))
    assert lengths[0] == 1 < lengths[3] < lengths[5] <= lengths[1] and not lengths[4]
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    limited = np.array(W.lengths_of(fibonacci, W.LONGEST))
    assert limited.max() <= W.LONGEST and (2.0 ** -limited).sum() == 1


@given(st.lists(st.sampled_from([b"abcd", b"efgh", b"ijkl", b"x", b"\0\0\0\0", bytes(range(40)), bytes(range(64)) * 3]), max_size=400))
@settings(max_examples=80, deadline=None)
def test_repeating_contents_come_back(parts):
    content = b"".join(parts)
    back = b"".join(i.tobytes() for i in W.load(W.store(content)))
    assert back[:len(content)] == content and not back[len(content):].strip(b"\0")


@given(st.integers(0, 10 ** 6), st.integers(1, 40))
@settings(max_examples=40, deadline=None)
def test_smooth_contents_come_back(seed, rows):
    pixels = walk(seed, rows, red="half", green="green", blue="same", alpha="noise")
    assert np.array_equal(W.decode(W.encode(pixels)), pixels)


def test_the_group_reader_agrees_with_the_plain_one(monkeypatch):
    contents = [b"some words and some words again " * 9 + bytes(range(256)) * 5, walk(3, 40, red="half", green="green", blue="same", alpha="noise").tobytes()]
    for media in map(W.store, contents):
        quick = W.load(media)
        with monkeypatch.context() as m:
            m.setattr(W, "_read_group", lambda b, codes, width, total, cache: W._read_symbols(b, [codes], width, total, cache, 0, None))
            assert all(np.array_equal(x, y) for x, y in zip(quick, W.load(media), strict=True))


def test_broken_streams_are_refused():
    media = writer.encode(picture(1, 8, 8))
    for bad in (b"", b"RIFF", media[:40], media[:12] + b"VP8 " + media[16:], media[:20] + b"\x2e" + media[21:]):
        with pytest.raises((W.Corrupt, IndexError, ValueError)):
            W.decode(bad)


def test_contents_over_one_image(spark):
    content = (b"0123456789abcdef" * 70_000)[:1_100_001]
    images = W.load(W.store(content))
    assert len(images) == 2 and b"".join(i.tobytes() for i in images)[:len(content)] == content


def test_report(spark):
    rows = [(1, "héllo " * 100, "m", "n"), (1, "héllo " * 100, "m", "n"), (2, None, None, None), (3, "", "", ""), (None, "x" * 64, "", ""), (5, "y" * 2_000_000, "", "")]
    got = W.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sorted(got, key=str)[0][1:] == sorted(got, key=str)[1][1:]
    for r in got:
        text = next((t for i, t, *_ in rows if i == r.doc_id), None) or ""
        raw = text.encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_sha256 == hashlib.sha256(W.store(raw)).hexdigest()
    assert W.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pixel_arrays(spark):
    docs = spark.createDataFrame([(1, "some text", "", "")], SCHEMA)
    row = W.pixels(W.stored(docs)).collect()[0]
    assert [(i.width, i.height, bytes(i.pixels)) for i in row.images] == [(16, 1, b"some text".ljust(64, b"\0"))]


def test_whole_table(spark):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in catalogue.QUERIES["op4_webp"](spark, SF_DIR).collect():
        raw = docs[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))).hexdigest()
