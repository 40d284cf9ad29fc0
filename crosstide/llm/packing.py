"""Cost-balanced packing of documents into fixed-length training sequences.

A document's tokens are cut into full sequences and a rest. A piece costs ``LINEAR * n + QUADRATIC * n * n``: the
feed-forward part grows with its tokens, attention inside the piece with their square. In a window
of documents the rests, longest first, go to the sequence of lowest cost that has room; a rest
that fits nowhere is cut along the free room of the cheapest sequences, so all but the
last sequence of a window are full.

Tasks pack what they read: no shuffle. A window closes after ``WINDOW_TOKENS`` tokens, which bounds a
task's memory. A sequence is named by the partition and a running number. A task that is
run again on the same partition makes the same sequences.

Token ids are those of the public byte-level vocabulary, read from its rank file (the tests hold them
against the ``tokenizers`` library and its file). The splitting pattern never joins two words across a
single space or line end, so the distinct words of a slice of texts are encoded once and laid out by
array look-ups; texts with runs of white space are encoded whole. So are texts with an added token of the vocabulary's
file: as in the library's defaults, it is cut out first and keeps its own id.

Defined cases: a null text is empty and yields only the closing id. Repeated rows are packed each.
An empty table gives an empty result. Of the input only doc_id and text are used.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from crosstide.llm.common import fresh

LENGTH = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
WINDOW_TOKENS = 4_000_000
RANKS = "byte_bpe_50k.tiktoken"
# Added tokens of the vocabulary's file and their ids: fixed values.
ADDED = {"<|endoftext|>": 50256}
SLICE_CHARS = 12_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, sequence_cost double")
# Two characters in a row that Unicode, or Python, counts as white space.
TWO_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
WHOLE = "|".join([TWO_BLANKS, *map(re.escape, ADDED)])


class Encoder:
    """Token ids of a slice of texts, by the ids of its distinct words.

    A line end before each text, dropped again afterwards, makes every word begin with the space or line
    end before it. The distinct words are encoded in one go; their tokens' byte lengths
    tell where each word's tokens begin, as no token reaches over a word's end.
    """

    def __init__(self, ranks: str, pattern: str):
        import tiktoken
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=ADDED)
        self.encode, self.whole = encoding.encode_ordinary, partial(encoding.encode, allowed_special="all")
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        self.lengths[list(table.values())] = [len(t) for t in table]

    def _words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all words, and where each word's begin and end."""
        spaced = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(
            pa.scalar("", distinct.type), distinct, pa.scalar(" ", distinct.type)))
        tokens = np.array(self.encode("".join(spaced.to_pylist())), np.uint32)
        ends = np.searchsorted(np.cumsum(self.lengths[tokens]), np.cumsum(pc.binary_length(spaced).to_numpy())) + 1
        return tokens, np.append(0, ends[:-1]), ends

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the closing id last."""
        odd = pc.match_substring_regex(pa.array(["\n" + (t or "") for t in texts], pa.large_string()), WHOLE).to_pylist()
        plain = [d for d, o in enumerate(odd) if not o]
        out: list = [np.array([*self.whole(t or ""), END_ID], "<u4") if o else None for t, o in zip(texts, odd, strict=True)]
        split = pc.split_pattern(pa.array(["\n" + (texts[d] or "").replace("\n", " \n") for d in plain], pa.large_string()), " ")
        code = split.flatten().dictionary_encode()
        if not len(code):
            return out
        flat, starts, ends = self._words(code.dictionary)
        index = code.indices.to_numpy()
        n = (ends - starts)[index]
        upto = np.cumsum(n)
        tokens = flat[np.repeat(starts[index] - (upto - n), n) + np.arange(upto[-1])]
        bounds = np.append(0, upto)[split.offsets.to_numpy()]
        end = np.array([END_ID], "<u4")
        for k, d in enumerate(plain):
            out[d] = np.concatenate([tokens[bounds[k] + 1:bounds[k + 1]], end]).astype("<u4", copy=False)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(ranks: str, pattern: str) -> Encoder:
    if (ranks, pattern) not in _ENCODERS:
        _ENCODERS[ranks, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[ranks, pattern]


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def place(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, tokens) for documents of the given lengths.

    The number of sequences is the least that can hold everything. Sequences are kept in a heap
    by cost; those without room for the piece at hand are set aside by their room and come back for pieces that fit.
    """
    full: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        whole = n - n % length
        full += [[(d, s, length)] for s in range(0, whole, length)]
        if n > whole:
            rests.append((n - whole, d, whole))
    rests.sort(key=lambda r: (-r[0], r[1]))
    count = -(-sum(r[0] for r in rests) // length)
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    room, load = [length] * count, [0.0] * count
    heap = [(0.0, b) for b in range(count)]
    aside: list[list[int]] = [[] for _ in range(length + 1)]
    back = length
    left = []
    for n, d, s in rests:
        while back >= n:
            for b in aside[back]:
                heapq.heappush(heap, (load[b], b))
            aside[back], back = [], back - 1
        while heap and room[heap[0][1]] < n:
            b = heapq.heappop(heap)[1]
            aside[room[b]].append(b)
        if not heap:
            left.append((n, d, s))
            continue
        b = heap[0][1]
        bins[b].append((d, s, n))
        room[b] -= n
        load[b] += cost(n)
        heapq.heapreplace(heap, (load[b], b))
    heap = [(load[b], b) for b in range(count) if room[b]]
    heapq.heapify(heap)
    for n, d, s in left:
        while n:
            c, b = heapq.heappop(heap)
            k = min(n, room[b])
            bins[b].append((d, s, k))
            room[b] -= k
            n, s = n - k, s + k
            if room[b]:
                heapq.heappush(heap, (c + cost(k), b))
    return full + bins


def pack_window(ids: list, doc_ids: list, first: int, length: int = LENGTH) -> tuple[list[list], int]:
    """Result columns for one window, whose sequences are numbered from ``first``."""
    cols: list[list] = [[] for _ in range(9)]
    sequences = place([len(i) for i in ids], length)
    for number, pieces in enumerate(sequences, first):
        total, price, offset = sum(p[2] for p in pieces), sum(cost(p[2]) for p in pieces), 0
        for d, s, n in pieces:
            part = ids[d][s:s + n]
            for c, v in zip(cols, (doc_ids[d], s, n, zlib.crc32(part.tobytes()), len(ids[d]), number, offset, total, price), strict=True):
                c.append(v)
            offset += n
    return cols, first + len(sequences)


def pack(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH,
         window: int = WINDOW_TOKENS) -> DataFrame:
    """The pieces of all documents with their places. ``ranks`` is the path of a rank file, which
    every executor must have, ``pattern`` its splitting pattern."""
    import public_tokenizers
    return docs.select("doc_id", "text").mapInArrow(
        _packer(ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN, length, window), SCHEMA)


def written_order(docs: DataFrame) -> DataFrame:
    """doc_id and text of rows read from files, range-sorted as they were written: by number and name of the file, then by
    row. Spark's scan orders files by size. Rows that come from no file stay as they are."""
    number, name, row = (fresh(docs, x) for x in ("number", "file", "row"))
    try:
        at = docs.metadataColumn("_metadata")
        rows = docs.select("doc_id", "text", F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("long").alias(number),
                           at["file_name"].alias(name), at["row_index"].alias(row))
    except AnalysisException:
        return docs.select("doc_id", "text")
    return rows.repartitionByRange(number, name, row).sortWithinPartitions(number, name, row).select("doc_id", "text")


def _slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[slice]:
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= most:
            yield slice(first, i + 1)
            first, chars = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _packer(ranks: str, pattern: str, length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern).batch
        number = TaskContext.get().partitionId() << 40
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.float64() if f.endswith("double") else pa.int64() for f in SCHEMA.split(", ")]

        def close(ids: list, doc_ids: list, number: int) -> tuple[pa.RecordBatch, int]:
            cols, after = pack_window(ids, doc_ids, number, length)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names), after

        ids, doc_ids, tokens = [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _slices(texts):
                for d, i in zip(keys[part], encode(texts[part]), strict=True):
                    ids.append(i)
                    doc_ids.append(d)
                    tokens += len(i)
                if tokens >= window:
                    out, number = close(ids, doc_ids, number)
                    ids, doc_ids, tokens = [], [], 0
                    yield out
        if ids:
            yield close(ids, doc_ids, number)[0]
    return run
