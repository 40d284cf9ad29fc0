"""Exact top-k search by inner product, exhaustive and term at a time.

A vector is a sparse row: a term per component that is not 0, weighted floor(scale * component). Queries are the rows
whose id is divisible by ``EVERY``; candidates are all rows but the query's own.

1. Rows are staged under a number of their own and dealt by its hash to candidate blocks; queries also to query
   blocks. Both kinds of block have bounded sizes, and each pair of a query block and a candidate block is one group:
   no task holds more than the two.
2. In a group the candidates become postings (per term the candidates that have it, with their weights). For a chunk
   of queries, each term's weights are scattered over its postings into dense score arrays, one per query.
3. Partition selection takes each query's k best of the block, ties to the smaller id; the bests of all blocks are
   merged by a ranked window, which Spark cuts to k per query before its shuffle as well.

The work is queries times candidates, as the search is exhaustive. What is shuffled is each candidate once per query
block and each query once per candidate block.

Defined cases: vectors that are null or hold null or non-finite components take no part. Vectors of different lengths
agree on the terms that both have; a vector of zeros or without components scores 0. Rows that repeat an id are rows
of their own, each with its own results; only the query's own row is left out. A candidate with a null id comes after
equal scores that have one. Fewer than k candidates are all returned. An empty table gives no rows. A score beyond 2^63 - 1
either way counts as that. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from crosstide.llm.vectors import exact, finite, floors
from crosstide.session import stage

SCALE, EVERY, K = 1024, 100, 10
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 8_192
SCORES = 1 << 20


def _sparse(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, offsets, entries = finite(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            term = np.arange(offsets[0], offsets[-1]) - offsets[row]
            weight = floors(np.nan_to_num(entries[offsets[0]:offsets[-1]]), scale)
            on = usable[row] & (weight != 0)
            at = np.append(0, np.cumsum(np.bincount(row[on], minlength=batch.num_rows)[usable])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(pa.array(usable)), pa.ListArray.from_arrays(at, pa.array(term[on].astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(weight[on]))], ["vec_id", "terms", "weights"])
    return run


class Cells:
    """The non-zero cells of sparse rows, in the order of their terms."""

    def __init__(self, rows: pa.Table):
        terms = rows["terms"].combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        term = terms.flatten().to_numpy(zero_copy_only=False)
        weight = rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        by = np.argsort(term, kind="stable")
        self.rows, self.weights = row[by], weight[by]
        self.largest = float(np.abs(weight.astype(float)).max(initial=0.0))
        names, first = np.unique(term[by], return_index=True)
        self.span = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True), strict=True))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span[term]
        return self.rows[a:b], self.weights[a:b]


def scores(queries: Cells, n_queries: int, postings: Cells, n_candidates: int) -> np.ndarray:
    """Inner products, term at a time."""
    largest = queries.largest * postings.largest * max(1, len(postings.span))
    out = exact(np.zeros((n_queries, n_candidates), np.int64), largest)
    for term in queries.span.keys() & postings.span.keys():
        q, w = queries.of(term)
        c, v = postings.of(term)
        gain = exact(w, largest)[:, None] * exact(v, largest)[None, :]
        if len(c) == n_candidates:
            out[q] += gain
        else:
            out[np.ix_(q, c)] += gain
    return out if out.dtype != object else np.clip(out, 1 - 2 ** 63, 2 ** 63 - 1).astype(np.int64)


def select(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest entries, the largest first, the earlier place of equal ones first."""
    if k < len(row):
        least = np.partition(row, len(row) - k)[len(row) - k]
        above, equal = np.flatnonzero(row > least), np.flatnonzero(row == least)
        places = np.concatenate([above, equal[:k - len(above)]])
    else:
        places = np.arange(len(row))
    return places[np.lexsort([places, -row[places]])]


def _bests(k: int) -> Callable[[pa.Table], pa.Table]:
    """The k best candidates of the group's block for each of its queries."""
    columns = {"query": pa.int64(), "query_id": pa.int64(), "number": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}

    def run(group: pa.Table) -> pa.Table:
        queries = group.filter(group["is_query"])
        rows = group.filter(pc.invert(group["is_query"])).sort_by([("vec_id", "ascending"), ("number", "ascending")])     # nulls last
        postings = Cells(rows)
        number = rows["number"].to_numpy()
        parts = []
        step = max(1, SCORES // max(1, rows.num_rows))
        for first in range(0, queries.num_rows if rows.num_rows else 0, step):
            chunk = queries.slice(first, step)
            found = scores(Cells(chunk), chunk.num_rows, postings, rows.num_rows)
            own = chunk["number"].to_numpy()
            for i in range(chunk.num_rows):
                best = select(found[i], k + 1)
                best = best[number[best] != own[i]][:k]
                parts.append((np.full(len(best), first + i), best, found[i][best]))
        if not parts:
            return pa.schema(list(columns.items())).empty_table()
        q, c, score = (np.concatenate(p) for p in zip(*parts, strict=True))
        asked, given = queries.take(pa.array(q)), rows.take(pa.array(c))
        return pa.table([asked["number"], asked["vec_id"], given["number"], given["vec_id"], pa.array(score)], names=list(columns))
    return run


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE,
           query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), vector).mapInArrow(_sparse(scale), "vec_id long, terms array<int>, weights array<bigint>")
    rows = stage(rows.withColumn("number", F.monotonically_increasing_id()))
    asked = F.col("vec_id") % every == 0
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(asked).alias("queries")).first()
    across, down = (max(1, -(-n // size)) for n, size in ((counts.queries, query_block), (counts.rows, candidate_block)))

    def block(n: int, name: str):
        return F.pmod(F.xxhash64("number"), F.lit(n)).cast("int").alias(name)

    def all_blocks(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    plain = ["number", "vec_id", "terms", "weights"]
    candidates = rows.select(*plain, F.lit(False).alias("is_query"), block(down, "down"), all_blocks(across, "across"))
    queries = rows.filter(asked).select(*plain, F.lit(True).alias("is_query"), all_blocks(down, "down"), block(across, "across"))
    bests = candidates.unionByName(queries).groupBy("down", "across").applyInArrow(
        _bests(k), "query long, query_id long, number long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "number")
    return bests.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(df: DataFrame) -> DataFrame:
    return search(df)


SQL = f"""with whole as (select vec_id, row_number() over () as number, list_transform(embedding, lambda e: cast(floor({SCALE} * cast(e as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = len(embedding)),
scored as (select q.number, q.vec_id as query_id, c.number as other, c.vec_id,
  coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) as score
  from whole q join whole c on q.number <> c.number where q.vec_id % {EVERY} = 0),
ranked as (select *, row_number() over (partition by number order by score desc, vec_id nulls last, other) as rank from scored)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= {K}"""
