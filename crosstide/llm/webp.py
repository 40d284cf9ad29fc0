"""Lossless WebP: stores bytes as pixels and reads them back.

The reader handles the whole lossless format: prefix codes (simple and normal, with groups per tile), literals,
back-references with two-dimensional distance codes, the colour cache, and the inverse
predictor, cross-colour, subtract-green and palette transforms (with packed indexes). Streams with
one group of codes read a literal's four symbols in one step; those whose codes all have one length are unpacked by array operations.

The writer turns each 4 bytes into a pixel (red, green, blue, alpha), 16 pixels a row. Images of at most 16 colours get a
palette. Others get the transforms that leave the fewest bits by estimated entropy: none, or the best of the 14 prediction rules for each block with or without
cross-colour factors, either with or without subtracting green. Runs of pixels that stood there before become back-references, the colour cache is used where
it pays, and every alphabet gets a prefix code of unequal lengths (at most 10 bits; red, blue and alpha share theirs where separate ones would save little). One image holds at most 1 MiB; longer contents become several images in a row.

Defined cases: null content is empty content; it is padded like any other. Contents of any length
work, in bounded pieces. Equal contents give equal images. An empty table gives an empty result. Other
input columns are not used.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
WIDTH, MAX_SIDE = 16, 16384
PALETTE = 16
# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = range(4)
LENGTHS, DISTANCES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
# The writer's choices: longest code, rows and columns of a predictor's block as a power of two, steps of its colour factors.
LONGEST, TILE, FACTORS = 10, 4, (0, 8, -8, 16, -16, 32, -32)
# The writer shares a code if separate ones save less than one bit in so many.
SHARE = 32
# Short distances by how near the pixel is: above or to the left, within 7 rows and 8 columns.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Corrupt(ValueError):
    """The stream is not a lossless WebP image."""


# -- bits and prefix codes ----------------------------------------------------------------------

class Bits:
    """Reads bits, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first:first + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise Corrupt("the stream ends early")
        return value & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first:first + (n >> 3) + 2], "little") >> (self.at & 7) & ((1 << n) - 1)

    def array(self, n: int) -> np.ndarray:
        """The next ``n`` bits."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise Corrupt("the stream ends early")
        out = np.unpackbits(np.frombuffer(self.data, np.uint8, last - first, first), bitorder="little")
        out = out[self.at & 7:(self.at & 7) + n]
        self.at += n
        return out


class Code:
    """A canonical prefix code, given by the length of each symbol (0: unused)."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Corrupt("a code without symbols")
        self.bits = int(lengths[used].max()) if len(used) > 1 else 0
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        if len(used) > 1 and int((1 << (self.bits - n)).sum()) != 1 << self.bits:
            raise Corrupt("an incomplete code")
        self.symbols, self.lengths = order, n
        #: every symbol has the same length, so that the code of a symbol is its rank
        self.flat = len(used) == 1 or int(n[0]) == self.bits
        self.table: list[int] | None = None
        self.plain: np.ndarray | None = None

    def packed(self) -> np.ndarray:
        """16 * symbol + length by the next ``bits`` bits; a code's first bit is its highest."""
        return np.repeat(self.symbols * 16 + (self.lengths if self.bits else 0), 1 << (self.bits - self.lengths) if self.bits else 1)[turned(self.bits)]

    def parts(self, shift: int) -> tuple[list[int], int]:
        """64 * (symbol << shift) + length by the next bits, and the mask of these; -1 - (16 * symbol + length) for symbols from 256."""
        if self.plain is None:
            self.plain = self.packed()
        found = self.plain
        entry = ((found >> 4) << (shift + 6)) + (found & 15)
        return (np.where(found < 4096, entry, -1 - found) if self.symbols.max() > 255 else entry).tolist(), len(found) - 1

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        if self.table is None:
            self.table = self.packed().tolist()
        first = bits.at >> 3
        window = int.from_bytes(bits.data[first:first + 3], "little") >> (bits.at & 7)
        found = self.table[window & ((1 << self.bits) - 1)]
        bits.at += found & 15
        if bits.at > 8 * len(bits.data):
            raise Corrupt("the stream ends early")
        return found >> 4


@lru_cache(maxsize=16)
def turned(n: int) -> np.ndarray:
    """All numbers of ``n`` bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for i in range(n):
        out = np.concatenate([out, out + (1 << (n - 1 - i))])
    return out


def ranks_from(rows: np.ndarray) -> np.ndarray:
    """Whole numbers from rows of at most 16 bits, highest first."""
    n = rows.shape[1]
    if n == 1:
        return rows[:, 0]
    wide = np.zeros((len(rows), 8 if n <= 8 else 16), np.uint8)
    wide[:, wide.shape[1] - n:] = rows
    packed = np.packbits(wide, axis=1)
    return packed[:, 0] if n <= 8 else packed[:, 0].astype(np.int64) * 256 + packed[:, 1]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Corrupt("a symbol beyond the alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for i in CODE_LENGTH_ORDER[:4 + bits.read(4)]:
        own[i] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if code.flat and code.symbols.max() < 16 and left >= alphabet:
        lengths[:] = code.symbols[ranks_from(bits.array(alphabet * code.bits).reshape(alphabet, code.bits))] if code.bits else code.symbols[0]
        return Code(lengths)
    sizes, last, data, place = [], 8, bits.data, bits.at
    table, mask = code.packed().tolist(), (1 << code.bits) - 1
    while len(sizes) < alphabet and left:
        left -= 1
        window = int.from_bytes(data[place >> 3:(place >> 3) + 4], "little") >> (place & 7)
        found = table[window & mask]
        s, n = found >> 4, found & 15
        if s < 16:
            sizes.append(s)
            last = s or last
        elif s == 16:
            sizes += [last] * (3 + (window >> n & 3))
            n += 2
        elif s == 17:
            sizes += [0] * (3 + (window >> n & 7))
            n += 3
        else:
            sizes += [0] * (11 + (window >> n & 127))
            n += 7
        place += n
    bits.at = place
    if place > 8 * len(data):
        raise Corrupt("the stream ends early")
    if len(sizes) > alphabet:
        raise Corrupt("code lengths run over")
    lengths[:len(sizes)] = sizes
    return Code(lengths)


def read_codes(bits: Bits, alphabets: tuple[int, ...]) -> list[Code]:
    """A code for each alphabet; one whose header is that of the code before it is the same."""
    out: list[Code] = []
    header = size = 0
    for i, alphabet in enumerate(alphabets):
        if i and alphabet == alphabets[i - 1] and bits.at + size <= 8 * len(bits.data) and bits.peek(size) == header:
            out.append(out[-1])
            bits.at += size
            continue
        start = bits.at
        out.append(read_code(bits, alphabet))
        size, bits.at = bits.at - start, start
        header = bits.peek(size)
        bits.at += size
    return out


# -- reading ------------------------------------------------------------------------------------

def read_count(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Corrupt("a colour cache that is too large")
    tile_bits, tiles, groups = 0, None, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles_x = -(-width // (1 << tile_bits))
        tiles = (read_pixels(bits, tiles_x, -(-height // (1 << tile_bits)), False) >> 8) & 0xFFFF
        groups = int(tiles.max()) + 1
    alphabets = (256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [read_codes(bits, alphabets) for _ in range(groups)]
    total = width * height
    if groups == 1 and all(c.flat for c in codes[0][:4]) and codes[0][0].symbols.max() < 256:
        return _read_flat(bits, codes[0], total)
    if groups == 1:
        return _read_group(bits, codes[0], width, total, cache_bits)
    return _read_symbols(bits, codes, width, total, cache_bits, tile_bits, tiles)


def _read_flat(bits: Bits, codes: list[Code], total: int) -> np.ndarray:
    sizes = [c.bits for c in codes[:4]]
    rows = bits.array(total * sum(sizes)).reshape(total, sum(sizes))
    out, at = np.zeros(total, np.uint32), 0
    for c, n, shift in zip(codes, sizes, (8, 16, 0, 24), strict=False):       # green, red, blue, alpha
        symbols = c.symbols.astype(np.uint32)
        out |= (symbols[ranks_from(rows[:, at:at + n])] if n else symbols[:1]) << np.uint32(shift)
        at += n
    return out


def _read_group(bits: Bits, codes: list[Code], width: int, total: int, cache_bits: int) -> np.ndarray:
    """One group of codes: the entries of a literal's four symbols hold their part of the colour and their length, so that they add up."""
    (green, mask_g), (red, mask_r), (blue, mask_b), (alpha, mask_a) = [c.parts(shift) for c, shift in zip(codes, (8, 16, 0, 24), strict=False)]
    data, at, end = bits.data, bits.at, 8 * len(bits.data)
    out: list[int] = []
    put, number = out.append, int.from_bytes
    far, mask_f = codes[4].packed().tolist(), (1 << codes[4].bits) - 1
    cache, cached, shift, count, factor = [0] * (1 << cache_bits), 0, 32 - cache_bits, 0, CACHE_FACTOR
    while count < total:
        window = number(data[at >> 3:(at >> 3) + 9], "little") >> (at & 7)
        found = green[window & mask_g]
        if found >= 0:
            window >>= found & 63
            more = red[window & mask_r]
            window >>= more & 63
            found += more
            more = blue[window & mask_b]
            window >>= more & 63
            found += more + alpha[window & mask_a]
            at += found & 63
            put(found >> 6)
            count += 1
            continue
        if at > end:
            break
        found = -1 - found
        s, n = found >> 4, found & 15
        window >>= n
        at += n
        if s >= 256 + LENGTHS:
            for p in out[cached:]:
                cache[(factor * p & 0xFFFFFFFF) >> shift] = p
            cached = count
            put(cache[s - 256 - LENGTHS])
            count += 1
            continue
        s -= 256
        n = s + 1
        if s > 3:
            s, n = (s - 2) >> 1, 2 + (s & 1)
            n = (n << s) + (window & ((1 << s) - 1)) + 1
            window >>= s
            at += s
        found = far[window & mask_f]
        s, d = found >> 4, found & 15
        window >>= d
        at += d
        d = s + 1
        if s > 3:
            s, d = (s - 2) >> 1, 2 + (s & 1)
            d = (d << s) + (window & ((1 << s) - 1)) + 1
            at += s
        if d <= 120:
            x, y = NEAR[d - 1]
            d = max(1, y * width + x)
        else:
            d -= 120
        if d > count or count + n > total:
            raise Corrupt("a back-reference outside the image")
        if d >= n:
            out += out[count - d:count - d + n]
        else:
            out += (out[-d:] * (-(-n // d)))[:n]
        count += n
    bits.at = at
    if at > end:
        raise Corrupt("the stream ends early")
    return np.array(out, np.uint32)


def _read_symbols(bits: Bits, codes: list[list[Code]], width: int, total: int, cache_bits: int, tile_bits: int,
                  tiles: np.ndarray | None) -> np.ndarray:
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    per_row = -(-width // (1 << tile_bits)) if tiles is not None else 0
    cached = at = 0
    while at < total:
        group = codes[0] if tiles is None else codes[int(tiles[(at // width >> tile_bits) * per_row + (at % width >> tile_bits)])]
        s = group[0].read(bits)
        if s < 256:
            red, blue = group[1].read(bits), group[2].read(bits)
            out[at] = (group[3].read(bits) << 24) | (red << 16) | (s << 8) | blue
            at += 1
        elif s < 256 + LENGTHS:
            n = read_count(bits, s - 256)
            d = read_count(bits, group[4].read(bits))
            if d <= len(NEAR):
                x, y = NEAR[d - 1]
                d = max(1, y * width + x)
            else:
                d -= len(NEAR)
            if d > at or at + n > total:
                raise Corrupt("a back-reference outside the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            for p in out[cached:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = at
            out[at] = cache[s - 256 - LENGTHS]
            at += 1
        if cache_bits and at - cached > 4096:
            for p in out[cached:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = at
    return np.array(out, np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue along the last axis."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def joined(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts).view(">u4").reshape(parts.shape[:-1]).astype(np.uint32)


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds to each pixel what its block's rule predicts from pixels before it."""
    height, width = argb.shape
    rest = channels(argb).astype(np.int64)
    out = np.zeros((height, width, 4), np.int64)
    out[0] = np.cumsum(rest[0], axis=0) & 255
    out[0, :, 0] = (out[0, :, 0] + 255) & 255
    for y in range(1, height):
        rules = set(modes[y >> bits].tolist())
        if len(rules) == 1 and rules <= {0, 1, 2, 4, 8, 14, 15}:           # nothing of the row itself, or sums along it
            rule = rules.pop()
            out[y, 0] = (rest[y, 0] + out[y - 1, 0]) & 255
            if rule == 1:
                out[y] = np.cumsum(np.concatenate([out[y, :1], rest[y, 1:]]), axis=0) & 255
            else:
                out[y, 1:] = (rest[y, 1:] + predict(rule, out[y, :-1], out[y - 1, 1:], out[y - 1, 1:], out[y - 1, :-1])) & 255
            continue
        for x in range(width):
            if x == 0:
                p = out[y - 1, 0]
            else:
                beyond = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                p = predict(int(modes[y >> bits, x >> bits]), out[y, x - 1], out[y - 1, x], beyond, out[y - 1, x - 1])
            out[y, x] = (rest[y, x] + p) & 255
    return joined(out.astype(np.uint8))


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """One of the 14 prediction rules; ``right`` is above to the right, ``corner`` above to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        return np.where(np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        return np.clip(mean + np.fix((mean - corner) / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def undo_cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """Adds the parts of green to red and blue, and of red to blue, that were taken off."""
    height, width = argb.shape
    f = channels(factors).view(np.int8).astype(np.int64)
    f = np.repeat(np.repeat(f, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    c = channels(argb).copy()
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(c[..., 2])
    red = c[..., 1] + (f[..., 3] * green >> 5)
    c[..., 3] = (c[..., 3] + (f[..., 2] * green >> 5) + (f[..., 1] * signed(red & 255) >> 5)) & 255
    c[..., 1] = red & 255
    return joined(c)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = channels(argb).copy()
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return joined(c)


def packing_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_indexing(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Replaces indexes, several of which may share a pixel, by the palette's colours."""
    green = (argb >> 8) & 255
    pack = packing_bits(len(palette))
    if pack:
        each = 8 >> pack
        green = ((green[..., None] >> (each * np.arange(1 << pack))) & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[:len(palette)] = palette
    return table[green]


def decode(image: bytes) -> np.ndarray:
    """The pixels of one file as an array (height, width, red-green-blue-alpha)."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L" or image[20:21] != b"\x2f":
        raise Corrupt("not a lossless image")
    bits = Bits(image[21:20 + struct.unpack("<I", image[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    opaque = not bits.read(1)
    if bits.read(3):
        raise Corrupt("an unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Corrupt("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, h = -(-inner // (1 << size)), -(-height // (1 << size))
            undo.append((kind, read_pixels(bits, w, h, False).reshape(h, w), size))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0))
        else:
            n = bits.read(8) + 1
            steps = channels(read_pixels(bits, n, 1, False))
            undo.append((kind, joined(np.cumsum(steps, axis=0, dtype=np.uint8)), inner))
            inner = -(-inner // (1 << packing_bits(n)))
    argb = read_pixels(bits, inner, height, True).reshape(height, inner)
    for kind, data, size in reversed(undo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, (data >> 8) & 15, size)
        elif kind == CROSS_COLOUR:
            argb = undo_cross_colour(argb, data, size)
        elif kind == SUBTRACT_GREEN:
            argb = undo_subtract_green(argb)
        else:
            argb = undo_indexing(argb, data, size)
    out = channels(argb)[..., [1, 2, 3, 0]]
    if opaque:
        out[..., 3] = 255
    return out


# -- writing ------------------------------------------------------------------------------------

class Out:
    """Collects numbers and their widths in bits, lowest bit first."""

    def __init__(self):
        self.values, self.widths, self.parts = [], [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.widths.append(n)

    def put_all(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.parts += [(np.array(self.values, np.int64), np.array(self.widths, np.int64)), (values, widths)]
        self.values, self.widths = [], []

    def data(self) -> bytes:
        self.put_all(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, widths = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        values, widths = values[widths > 0].astype(np.uint64), widths[widths > 0]
        ends = np.cumsum(widths)
        word, at = (ends - widths) >> 6, ((ends - widths) & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, "<u8")
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << at, first)
        over = np.flatnonzero((ends - 1) >> 6 > word)                       # at most one number crosses into each word
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - at[over])
        return out.tobytes()[:(int(ends[-1]) + 7) >> 3]


def lengths_of(counts: list[int], most: int) -> list[int]:
    """Code lengths of two or more symbols by joining the rarest; counts are flattened until the longest fits."""
    n = len(counts)
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        single = [counts[i] for i in order] + [math.inf]
        joint, i, j, parent = [math.inf] * n, 0, 0, [0] * (2 * n - 1)       # both stand in rising order
        for new in range(n - 1):
            total = 0
            for _ in (0, 1):
                if single[i] <= joint[j]:
                    total += single[i]
                    parent[i] = new + n
                    i += 1
                else:
                    total += joint[j]
                    parent[j + n] = new + n
                    j += 1
            joint[new] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= most:
            out = [0] * n
            for i, d in zip(order, depth, strict=False):
                out[i] = d
            return out
        counts = [c // 2 + 1 for c in counts]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n, longest = lengths[order], int(lengths.max())
    steps = np.int64(1) << (longest - n)
    out[order] = turned(longest)[np.cumsum(steps) - steps]
    return out


def put_code(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the header of a prefix code for symbols that occur so often; returns each symbol's code and length."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        used = np.zeros(1, np.int64)
    if len(used) <= 2 and used[-1] < 256:
        wide = int(used[0] > 1)
        out.put(1 | (len(used) - 1) << 1 | wide << 2, 3)
        out.put(int(used[0]), 8 if wide else 1)
        if len(used) == 2:
            out.put(int(used[1]), 8)
            lengths[used] = 1
        return codes_of(lengths) if len(used) == 2 else lengths, lengths
    lengths[used] = lengths_of(counts[used].tolist(), LONGEST)
    ends = np.append(np.flatnonzero(np.diff(lengths[:used[-1] + 1])), used[-1]) + 1
    runs, before, start = [], 8, 0
    for value, end in zip(lengths[ends - 1].tolist(), ends.tolist(), strict=True):
        n, start = end - start, end
        if value and value != before:
            runs.append((value, 0, 0))
            before, n = value, n - 1
        while n > 2:
            step = min(n, 6 if value else 138)
            runs.append((16, step - 3, 2) if value else (17, step - 3, 3) if step < 11 else (18, step - 11, 7))
            n -= step
        runs += [(value, 0, 0)] * n
    own = np.bincount([r[0] for r in runs], minlength=19)
    if np.count_nonzero(own) == 1:
        own[0 if not own[0] else 1] = 1
    own_lengths, kinds = np.zeros(19, np.int64), np.flatnonzero(own)
    own_lengths[kinds] = lengths_of(own[kinds].tolist(), 7)
    last = max(4, 1 + max(CODE_LENGTH_ORDER.index(k) for k in kinds.tolist()))
    out.put((last - 4) << 1, 5)
    sizes, own_codes = own_lengths.tolist(), codes_of(own_lengths).tolist()
    out.values += [sizes[k] for k in CODE_LENGTH_ORDER[:last]]
    out.widths += [3] * last
    size = max(2, (max(0, len(runs) - 2)).bit_length())
    size += size % 2
    out.put(1 | (size - 2) // 2 << 1, 4)                                    # as many code lengths as there are runs
    out.put(len(runs) - 2, size)
    out.values += [own_codes[s] | extra << sizes[s] for s, extra, _ in runs]
    out.widths += [sizes[s] + n for s, _, n in runs]
    return codes_of(lengths), lengths


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distances."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), v & ((np.int64(1) << n) - 1), n


@lru_cache(maxsize=64)
def near_codes(width: int) -> np.ndarray:
    """Distance codes of the pixels nearby by distance, 0 where there is none."""
    out = np.zeros(8 * width + 9, np.int64)
    for i in range(len(NEAR) - 1, -1, -1):
        out[max(1, NEAR[i][1] * width + NEAR[i][0])] = i + 1
    return out


def previous(keys: np.ndarray) -> np.ndarray:
    """The last place before each place with the same key, -1 where there is none."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def references(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies (start, pixels, distance): from the left, runs of two or more pixels that stand at the last place of their first two."""
    if len(argb) < 3:
        return []
    wide = argb.astype(np.uint64)
    source = previous(wide[:-1] << np.uint64(32) | wide[1:])
    starts = np.flatnonzero(source >= 0)
    if not len(starts):
        return []
    far = np.where(source >= 0, np.arange(len(source)) - source, 0)
    ends = np.append(np.flatnonzero(np.diff(far)), len(far) - 1)
    lengths = np.minimum(ends[np.searchsorted(ends, starts)] - starts + 2, 4096)
    out, at = [], 0
    for start, n, d in zip(starts.tolist(), lengths.tolist(), far[starts].tolist(), strict=True):
        if start >= at:
            out.append((start, n, d))
            at = start + n
    return out


def put_pixels(out: Out, argb: np.ndarray, width: int, main: bool) -> None:
    """An entropy-coded image: back-references, a colour cache if it pays, and a prefix code each for green with lengths and
    cached colours, red, blue, alpha and distances."""
    copies = np.array(references(argb), np.int64).reshape(-1, 3)
    covered = np.zeros(len(argb) + 1, np.int64)
    np.add.at(covered, copies[:, 0], 1)
    np.add.at(covered, copies[:, 0] + copies[:, 1], -1)
    token = np.cumsum(covered[:-1]) == 0
    literal = token.copy()
    token[copies[:, 0]] = True
    cache_bits = min(10, max(1, len(argb).bit_length() - 2))
    slot = ((argb.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits))
    before = previous(slot)
    hit = literal & (before >= 0) & (argb[before] == argb)
    # a cached colour saves about half of its literal; a symbol more costs some bits of the header
    if 9 * np.count_nonzero(hit) <= 4 * len(np.unique(slot[hit])) + 24:
        cache_bits, hit = 0, np.zeros(len(argb), bool)
    literal &= ~hit
    out.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(0, 1)
    c = channels(argb).astype(np.int64)
    green = np.where(hit, 256 + LENGTHS + slot, c[:, 2])
    kind, length_extra, length_bits = prefixes(copies[:, 1])
    green[copies[:, 0]] = 256 + kind
    nearby = near_codes(width)
    code = np.where(copies[:, 2] < len(nearby), nearby[np.minimum(copies[:, 2], len(nearby) - 1)], 0)
    far, far_extra, far_bits = prefixes(np.where(code > 0, code, copies[:, 2] + len(NEAR)))
    codes, lengths = put_code(out, np.bincount(green[token], minlength=256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0)))
    values, widths = codes[green], lengths[green]
    rest = [c[literal, k] for k in (1, 3, 0)]
    counts = np.stack([np.bincount(r, minlength=256) for r in rest])
    pooled = counts.sum(0)
    alone, together = (-(n * np.log2(np.maximum(n, 1))).sum() for n in (counts, pooled))
    together += pooled.sum() * np.log2(3)                                    # each takes a third of the total
    share = np.count_nonzero(pooled) > 2 and (together - alone) * SHARE <= -alone + pooled.sum() * np.log2(max(1, pooled.sum() / 3))
    for k, (symbols, own) in enumerate(zip(rest, counts, strict=True)):
        if not share or not k:
            begin = len(out.values)
            codes, lengths = put_code(out, pooled if share else own)
        else:
            out.values += head[0]
            out.widths += head[1]
        head = out.values[begin:], out.widths[begin:]
        begin = len(out.values)
        values[literal] |= codes[symbols] << widths[literal]
        widths[literal] += lengths[symbols]
    codes, lengths = put_code(out, np.bincount(far, minlength=DISTANCES))
    for value, n in ((length_extra, length_bits), (codes[far], lengths[far]), (far_extra, far_bits)):
        values[copies[:, 0]] |= value << widths[copies[:, 0]]
        widths[copies[:, 0]] += n
    out.put_all(values[token], widths[token])


def costs(c: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """About how many bits the bytes of each group and channel take: their entropy, and a header of 3 bits a symbol."""
    wide = c.shape[-1]
    key = c + (np.arange(wide) << 8)
    many = 1
    if groups is not None:
        many = int(groups.max()) + 1
        key += (groups * wide << 8)[..., None]
    n = np.bincount(key.ravel(), minlength=many * wide << 8).reshape(many, wide, 256)
    total = n.sum(2)
    return total * np.log2(np.maximum(total, 1)) - (n * np.log2(np.maximum(n, 1))).sum(2) + 3 * np.count_nonzero(n, axis=2)


def without_prediction(c: np.ndarray, mode: int) -> np.ndarray:
    """What a prediction rule leaves of the channels."""
    out = c.copy()
    out[0, 0, 0] -= 255
    out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    right = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)
    out[1:, 1:] -= predict(mode, c[1:, :-1], c[:-1, 1:], right, c[:-1, :-1])
    return (out & 255).astype(np.uint8)


def without_green(c: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[..., [1, 3]] -= c[..., 2:3]
    return out & 255


def blocks_of(height: int, width: int) -> tuple[np.ndarray, tuple[int, int]]:
    shape = (-(-height // (1 << TILE)), -(-width // (1 << TILE)))
    return (np.arange(height)[:, None] >> TILE) * shape[1] + (np.arange(width) >> TILE), shape


def take_prediction(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rests by the best rule of each block, and the rules."""
    block, shape = blocks_of(*c.shape[:2])
    rests = np.stack([without_prediction(c, mode) for mode in range(14)])
    modes = np.argmin([costs(r, block).sum(1) for r in rests], axis=0)
    return np.take_along_axis(rests, modes[block][None, ..., None], axis=0)[0].astype(np.int64), modes.reshape(shape)


def take_cross_colour(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue less the best parts of green, blue less that of red, by block, and the factors as (alpha, red to blue, green to blue, green to red)."""
    block, shape = blocks_of(*c.shape[:2])
    signed = lambda v: (v + 128 & 255) - 128
    out, factors = c.copy(), np.zeros((shape[0] * shape[1], 4), np.int64)
    for to, by, at in ((1, 2, 3), (3, 2, 2), (3, 1, 1)):
        ways = np.stack([out[..., to] - (f * signed(c[..., by]) >> 5) & 255 for f in FACTORS])
        best = np.argmin([costs(w[..., None], block)[:, 0] + 8 * (f != 0) for w, f in zip(ways, FACTORS, strict=True)], axis=0)
        out[..., to] = np.take_along_axis(ways, best[block][None], axis=0)[0]
        factors[:, at] = np.array(FACTORS)[best]
    return out, (factors & 255).astype(np.uint8).reshape(*shape, 4)


def encode(pixels: np.ndarray) -> bytes:
    """A file for an array (height, width, red-green-blue-alpha). Few colours become a palette; otherwise the transforms are those
    that leave the fewest bits by estimate: none, prediction with or without cross-colour, each with or without subtracting green."""
    height, width = pixels.shape[:2]
    argb = joined(pixels[..., [3, 0, 1, 2]])
    out = Out()
    out.put(width - 1 | (height - 1) << 14 | 1 << 28, 32)
    colours, index = np.unique(argb, return_inverse=True)
    if len(colours) <= PALETTE:
        steps = channels(colours).copy()
        steps[1:] -= channels(colours)[:-1]
        pack = packing_bits(len(colours))
        each, wide = 8 >> pack, -(-width // (1 << pack)) << pack
        rows = np.zeros((height, wide), np.uint32)
        rows[:, :width] = index.reshape(height, width)
        packed = (rows.reshape(height, -1, 1 << pack) << (each * np.arange(1 << pack, dtype=np.uint32))).sum(2).astype(np.uint32)
        out.put(1 | INDEXING << 1 | len(colours) - 1 << 3, 11)
        put_pixels(out, joined(steps), len(colours), False)
        argb, width = packed << np.uint32(8), packed.shape[1]
    else:
        c = channels(argb).astype(np.int64)
        ways = np.concatenate([c, c, c, c], axis=2)                         # as it is, less the left, less the top, less green
        ways[:, 1:, 4:8] -= c[:, :-1]
        ways[1:, :, 8:12] -= c[:-1]
        ways[..., [13, 15]] -= c[..., 2:3]
        plain, left, top, less = costs(ways & 255).reshape(4, 4).sum(1)
        if min(left, top) + 64 < plain:
            rest, modes = take_prediction(c)
            out.put(1 | PREDICTOR << 1 | TILE - 2 << 3, 6)
            put_pixels(out, (modes.astype(np.uint32) << np.uint32(8)).ravel(), modes.shape[1], False)
            c, factors = take_cross_colour(rest)
            if factors.any() and costs(c).sum() + 64 < costs(rest).sum():
                out.put(1 | CROSS_COLOUR << 1 | TILE - 2 << 3, 6)
                put_pixels(out, joined(factors).ravel(), factors.shape[1], False)
            else:
                c = rest
            plain, less = costs(c).sum(), costs(without_green(c)).sum()
        if less < plain:
            out.put(1 | SUBTRACT_GREEN << 1, 3)
            c = without_green(c)
        argb = joined(c.astype(np.uint8))
    out.put(0, 1)
    put_pixels(out, argb.ravel(), width, True)
    return wrap(out.data())


def wrap(stream: bytes) -> bytes:
    body = b"\x2f" + stream
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def store(content: bytes) -> bytes:
    """The padded content as one or more files."""
    content += b"\0" * (-len(content) % UNIT or (0 if content else UNIT))
    most = 4 * WIDTH * MAX_SIDE
    return b"".join(encode(np.frombuffer(content[i:i + most], np.uint8).reshape(-1, WIDTH, 4)) for i in range(0, len(content), most))


def load(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of files that stand in a row."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack("<I", media[at + 4:at + 8])[0]
        out.append(decode(media[at:end]))
        at = end
    return out


def feature(images: list[np.ndarray]) -> str:
    """Size and mean of each channel over all images."""
    total = sum(i.size // 4 for i in images)
    sums = sum(i.reshape(-1, 4).sum(0, dtype=np.int64) for i in images)
    return f"{sum(i.shape[0] for i in images)}x{images[0].shape[1]}:" + ",".join(f"{1000 * int(s) // total}" for s in sums)


# -- columns ------------------------------------------------------------------------------------

def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) with the text's bytes as lossless images."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array([store(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, images): images is an array of (width, height, pixels), four bytes a pixel."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))
        for batch in batches:
            for part in pieces(batch):
                images = [[{"width": i.shape[1], "height": i.shape[0], "pixels": i.tobytes()} for i in load(m)] for m in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(images, kind)], [*part.schema.names, "images"])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, media binary, images array<struct<width:int, height:int, pixels:binary>>")


def report(docs: DataFrame) -> DataFrame:
    """Digests of what was stored and of what was read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for media in part.column(2).to_pylist():
                    images = load(media)
                    back = b"".join(i.tobytes() for i in images)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media),
                                 hashlib.sha256(media).hexdigest(), feature(images)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                        "media_bytes long, media_sha256 string, feature string")
