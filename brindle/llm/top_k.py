"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components are dealt to `SLICES` slices; a score is the sum of its slices' partial scores.

1. Each task lists, for each query and slice, its local entries with the highest partial scores, scores
   them fully and hands on the k best. The k-th highest over all tasks is a cutoff that no answer is below.
2. The cutoffs are broadcast. An entry whose partial scores all lie below cutoff / SLICES has a
   score below the cutoff, so the entries with a partial score at or above it are sufficient.
3. The missing partial scores of those entries are resolved exactly, each task keeps the k best of what
   reaches the cutoff, and those are ranked, ties to the smaller id.

A pass over the vectors answers as many queries as fit into `PASS_BYTES`, which is what is broadcast at once;
inside a task they meet the vectors in blocks of `QUERIES` by `VECTORS`. So both phases scan the table once for each
`PASS_BYTES` of queries, beside a number of products that grows with queries times vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._common import stored

SCALE = 1024
SLICES = 2
#: Bytes of the queries of one pass, as whole numbers of 8 bytes.
PASS_BYTES = 32 << 20
QUERIES = 1024
VECTORS = 2048
#: Scores lie between minus and plus this, or are refused.
LIMIT = 2**62


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v), v = floor(1024 * x) of each component; rows with a null or non-finite part are left out."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as int64 of one width: shorter vectors end in zeros, longer ones meet only zeros and are cut."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every sum fits 53 bits, else in whole numbers of any size.

    A product outside `LIMIT` raises OverflowError: a score is a 64-bit number and is never rounded or cut.
    """
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    bound = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(x.astype(np.float64)).max()) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    if exact.size and (exact.max() >= LIMIT or exact.min() <= -LIMIT):
        raise OverflowError("an inner product doesn't fit 62 bits")
    return exact.astype(np.int64)


def _slices(width: int) -> list[slice]:
    cuts = np.linspace(0, width, SLICES + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _best(row: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, score, vec) the k best of each row, ties to the smaller id."""
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[place < k], score[place < k], vec[place < k]


def _highest(partial: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest entries of each row, or of all, that aren't a query's own."""
    # An own entry sorts behind all others, so it takes no place of theirs; products lie inside LIMIT, so none wraps.
    order = np.where(own, np.iinfo(np.int64).max, -partial)
    n = min(k, order.shape[1])
    cols = np.argpartition(order, n - 1, axis=1)[:, :n] if n < order.shape[1] else np.broadcast_to(np.arange(n), order.shape)
    rows = np.repeat(np.arange(len(order)), n)
    cols = cols.ravel()
    other = ~own[rows, cols]
    return rows[other], cols[other]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for m in range(0, batch.num_rows, VECTORS):
            part = batch.slice(m, VECTORS)
            if part.num_rows:
                yield part.column(0).to_numpy(), _matrix(part.column(1), width)


def _local_lists(ids: np.ndarray, q: np.ndarray, k: int):  # noqa: ANN202
    """Phase 1: of each task and query, the k highest scores among its entries with the k highest partial scores of any slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _slices(q.shape[1])
        # By block of queries and slice: (row, partial score, id, score), k entries a query at most.
        lists: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        at = 0
        for vec, x in _blocks(batches, q.shape[1]):
            place = at + np.arange(len(vec))  # tells rows that repeat an id apart
            at += len(vec)
            for start in range(0, len(ids), QUERIES):
                some = slice(start, start + QUERIES)
                partial = [_products(q[some, s], x[:, s]) for s in parts]
                own = ids[some, None] == vec[None, :]
                for n, p in enumerate(partial):
                    row, col = _highest(p, own, k)
                    new = (row, p[row, col], place[col], sum(p[row, col] for p in partial))
                    if (old := lists.get((start, n))) is not None:
                        new = tuple(np.concatenate([a, b]) for a, b in zip(old, new, strict=True))
                        order = np.lexsort((-new[1], new[0]))
                        first = np.searchsorted(new[0][order], np.arange(len(own)))
                        order = order[np.arange(len(order)) - first[new[0][order]] < k]
                        new = tuple(a[order] for a in new)
                    lists[start, n] = new
        for start in range(0, len(ids), QUERIES):
            found = [lists[start, n] for n in range(len(parts)) if (start, n) in lists]
            if found:
                # An entry may be in the lists of several slices: it counts once.
                row, _, place, score = (np.concatenate([f[n] for f in found]) for n in range(4))
                _, once = np.unique(np.stack([row, place]), axis=1, return_index=True)
                row, score, _ = _best(row[once], score[once], place[once], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + row]), pa.array(score)], names=["query_id", "score"])

    return run


def _answers(ids: np.ndarray, q: np.ndarray, cutoffs: np.ndarray, k: int):  # noqa: ANN202
    """Phases 2 and 3: of each task and query, the k best of the entries that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _slices(q.shape[1])
        # Below the cutoff for sure where every partial score times the number of slices is below it.
        least = -((-cutoffs) // SLICES)
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for vec, x in _blocks(batches, q.shape[1]):
            for start in range(0, len(ids), QUERIES):
                some = slice(start, start + QUERIES)
                partial = [_products(q[some, s], x[:, s]) for s in parts]
                enough = np.zeros(partial[0].shape, dtype=bool)
                for p in partial:
                    enough |= p >= least[some, None]
                row, col = np.nonzero(enough & (ids[some, None] != vec[None, :]))
                score = sum(p[row, col] for p in partial)
                keep = score >= cutoffs[some][row]
                new = (row[keep], score[keep], vec[col[keep]])
                if len(new[0]):
                    old = best.get(start, tuple(a[:0] for a in new))
                    best[start] = _best(*(np.concatenate([a, b]) for a, b in zip(old, new, strict=True)), k)
        for start, (row, score, vec) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids[start + row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100) -> DataFrame:
    """Out: query_id, rank (from 1), vec_id, score. Queries: rows whose vec_id is divisible by `every`.

    A query's own id is no candidate. Rows that repeat a query's id are one query, with the smallest of their
    vectors; as candidates of others each row counts. Vectors of other lengths than a query's are compared
    over the components that both have. Fewer than k candidates give as many rows; an empty table gives none.
    Scores beyond 62 bits raise OverflowError.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    passes = -(-size["n"] * max(1, size["width"] or 0) * 8 // PASS_BYTES)
    schema = "query_id long, vec_id long, score long"
    answers = spark.createDataFrame([], schema)
    for b in range(passes):
        block = queries.where(F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(passes)) == b).orderBy("vec_id").toArrow()
        ids = block.column("vec_id").to_numpy()
        if not len(ids):
            continue
        q = _matrix(block.column("v"), int(np.diff(block.column("v").combine_chunks().offsets.to_numpy()).max()))
        found = rows.mapInArrow(_local_lists(ids, q, k), "query_id long, score long")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        cut = found.withColumn("place", place).where(F.col("place") == k).select("query_id", "score").toArrow()
        # A query with fewer than k candidates takes them all.
        cutoffs = np.full(len(ids), -LIMIT, np.int64)
        cutoffs[np.searchsorted(ids, cut.column("query_id").to_numpy())] = cut.column("score").to_numpy()
        found = rows.mapInArrow(_answers(ids, q, cutoffs, k), schema)
        answers = answers.union(stored(found) if passes > 1 else found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
