"""A writer of lossless streams that uses every part of the format; only the tests need it."""

import heapq
from collections import Counter

import numpy as np

from crosstide.llm import webp as W


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def code(self, table, symbol):
        n, value = table[symbol]
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]          # a code's first bit is its highest

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def lengths_of(counts, most):
    """Code lengths by joining the rarest; counts are flattened until the longest fits."""
    while True:
        heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        depth = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            return dict(depth)
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def table_of(depth):
    table, code, last = {}, 0, 0
    for s, n in sorted(depth.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        table[s], last = (n, code), n
        code += 1
    return table


def put_code(out, symbols, alphabet):
    """Writes the header of a code for these symbols and returns its table."""
    counts = Counter(symbols) or Counter([0])
    if len(counts) <= 2 and max(counts) < 256:
        found = sorted(counts)
        out.put(1, 1)
        out.put(len(found) - 1, 1)
        wide = found[0] > 1
        out.put(wide, 1)
        out.put(found[0], 8 if wide else 1)
        if len(found) == 2:
            out.put(found[1], 8)
            return {found[0]: (1, 0), found[1]: (1, 1)}
        return {found[0]: (0, 0)}
    if len(counts) == 1:
        depth, table = {next(iter(counts)): 1}, {next(iter(counts)): (0, 0)}
    else:
        depth = lengths_of(counts, 15)
        table = table_of(depth)
    row = [depth.get(s, 0) for s in range(max(depth) + 1)]
    runs, i, before = [], 0, 8
    while i < len(row):
        n = 1
        while i + n < len(row) and row[i + n] == row[i]:
            n += 1
        if row[i] == 0 and n >= 11:
            n = min(n, 138)
            runs.append((18, n - 11, 7))
        elif row[i] == 0 and n >= 3:
            n = min(n, 10)
            runs.append((17, n - 3, 3))
        elif row[i] == before and n >= 3:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n = 1
            runs.append((row[i], 0, 0))
            before = row[i] or before
        i += n
    used = Counter(r[0] for r in runs)
    if len(used) == 1:
        used[(next(iter(used)) + 1) % 16] = 1
    own = lengths_of(used, 7)
    out.put(0, 1)
    order = W.CODE_LENGTH_ORDER
    last = max(4, 1 + max(order.index(s) for s in own))
    out.put(last - 4, 4)
    for s in order[:last]:
        out.put(own.get(s, 0), 3)
    out.put(1, 1)                                                            # as many code lengths as there are runs
    size = max(2, (len(runs) - 2).bit_length())
    size += size % 2
    out.put((size - 2) // 2, 3)
    out.put(max(0, len(runs) - 2), size)
    if len(runs) < 2:
        runs.append((0, 0, 0))
    own_table = table_of(own)
    for s, extra, n in runs:
        out.code(own_table, s)
        out.put(extra, n)
    return table


def prefix_of(value):
    """Prefix, number of extra bits and extra bits of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    second = (v >> (n - 1)) & 1
    return 2 * n + second, n - 1, v & ((1 << (n - 1)) - 1)


def put_pixels(out, argb, width, main, cache_bits=0, tile_bits=0, references=True):
    pixels = [int(p) for p in argb]
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(pixels) // width
    tiles = None
    if main:
        out.put(tile_bits > 0, 1)
        if tile_bits:
            out.put(tile_bits - 2, 3)
            w, h = -(-width // (1 << tile_bits)), -(-height // (1 << tile_bits))
            tiles = [(x + y) % 3 for y in range(h) for x in range(w)]
            put_pixels(out, [t << 8 for t in tiles], w, False, references=False)
    cache, at, steps, seen = {}, 0, [], {}
    near = {max(1, y * width + x): i + 1 for i, (x, y) in reversed(list(enumerate(W.NEAR)))}
    while at < len(pixels):
        group = 0 if tiles is None else tiles[(at // width >> tile_bits) * w + (at % width >> tile_bits)]
        best, source = 0, 0
        for start in seen.get(tuple(pixels[at:at + 2]), [])[-8:] if references else []:
            n = 0
            while at + n < len(pixels) and n < 4096 and pixels[start + n] == pixels[at + n]:
                n += 1
            if n > best:
                best, source = n, start
        slot = (W.CACHE_FACTOR * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best >= 2:
            n, d = best, at - source
            code = near.get(d, d + len(W.NEAR))
            steps.append((group, "copy", n, code))
        elif cache_bits and cache.get(slot) == pixels[at]:
            n = 1
            steps.append((group, "cache", slot, 0))
        else:
            n = 1
            steps.append((group, "pixel", pixels[at], 0))
        for i in range(at, at + n):
            if i + 1 < len(pixels):
                seen.setdefault(tuple(pixels[i:i + 2]), []).append(i)
            if cache_bits:
                cache[(W.CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
        at += n
    groups = 1 if tiles is None else max(tiles) + 1
    tables = []
    for g in range(groups):
        use = [[], [], [], [], []]
        for k, kind, a, b in steps:
            if k != g:
                continue
            if kind == "pixel":
                for u, v in zip(use, ((a >> 8) & 255, (a >> 16) & 255, a & 255, a >> 24), strict=False):
                    u.append(v)
            elif kind == "copy":
                use[0].append(256 + prefix_of(a)[0])
                use[4].append(prefix_of(b)[0])
            else:
                use[0].append(280 + a)
        alphabets = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        tables.append([put_code(out, u, n) for u, n in zip(use, alphabets, strict=True)])
    for k, kind, a, b in steps:
        t = tables[k]
        if kind == "pixel":
            for table, v in zip(t, ((a >> 8) & 255, (a >> 16) & 255, a & 255, a >> 24), strict=False):
                out.code(table, v)
        elif kind == "copy":
            for table, value, base in ((t[0], a, 256), (t[4], b, 0)):
                p, n, extra = prefix_of(value)
                out.code(table, base + p)
                out.put(extra, n)
        else:
            out.code(t[0], 280 + a)


def encode(pixels, predictor=None, cross=None, green=False, palette=False, **how):
    """``predictor`` and ``cross`` are (block bits, numbers by block) images."""
    height, width = pixels.shape[:2]
    argb = W.joined(pixels[..., [3, 0, 1, 2]])
    out = Out()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        steps = W.channels(colours).copy()
        steps[1:] -= W.channels(colours)[:-1]
        out.put(1 | W.INDEXING << 1, 3)
        out.put(len(colours) - 1, 8)
        put_pixels(out, W.joined(steps), len(colours), False)
        pack = W.packing_bits(len(colours))
        rows = np.zeros((height, -(-width // (1 << pack)) << pack), np.uint32)
        rows[:, :width] = index.reshape(height, width)
        argb = ((rows.reshape(height, -1, 1 << pack) << ((8 >> pack) * np.arange(1 << pack, dtype=np.uint32))).sum(2).astype(np.uint32)) << np.uint32(8)
        width = argb.shape[1]
    if predictor:
        bits, modes = predictor
        out.put(1 | W.PREDICTOR << 1, 3)
        out.put(bits - 2, 3)
        put_pixels(out, (np.asarray(modes, np.uint32) << np.uint32(8)).ravel(), modes.shape[1], False)
        c, rest = W.channels(argb).astype(int), np.zeros((*argb.shape, 4), int)
        for y in range(height):
            for x in range(width):
                if not y:
                    p = c[0, x - 1] if x else np.array([255, 0, 0, 0])
                elif not x:
                    p = c[y - 1, 0]
                else:
                    p = W.predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], c[y - 1, x + 1] if x + 1 < width else c[y, 0], c[y - 1, x - 1])
                rest[y, x] = (c[y, x] - p) & 255
        argb = W.joined(rest.astype(np.uint8))
    if cross:
        bits, factors = cross                                                # bytes (alpha, red to blue, green to blue, green to red)
        out.put(1 | W.CROSS_COLOUR << 1, 3)
        out.put(bits - 2, 3)
        put_pixels(out, W.joined(factors).ravel(), factors.shape[1], False)
        c, s = W.channels(argb).copy(), lambda v: (int(v) + 128) % 256 - 128
        for y in range(height):
            for x in range(width):
                f, (_, r, g, b) = factors[y >> bits, x >> bits], map(int, c[y, x])
                c[y, x, 1] = (r - (s(f[3]) * s(g) >> 5)) & 255
                c[y, x, 3] = (b - (s(f[2]) * s(g) >> 5) - (s(f[1]) * s(r) >> 5)) & 255
        argb = W.joined(c)
    if green:
        out.put(1 | W.SUBTRACT_GREEN << 1, 3)
        c = W.channels(argb).copy()
        c[..., 1] -= c[..., 2]
        c[..., 3] -= c[..., 2]
        argb = W.joined(c)
    out.put(0, 1)
    put_pixels(out, argb.ravel(), width, True, **how)
    return W.wrap(out.data())
