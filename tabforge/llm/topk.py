"""Operator 2, exact top-k search: distributed histogram selection.

Every query scores every candidate, more than once but never keeping the scores: round by round the range in which a
query's k-th score lies is cut into `BINS` bins, each task counts its candidates per bin, the counts are summed over the
cluster, and the bin that holds the k-th score becomes the next range. Once bins are one score wide the k-th value is
known; a last pass keeps what reaches it, and equal scores are ranked by id.

A task hands on only the highest bins that hold k of its own candidates between them: lower bins cannot hold the
k-th score of all. So a task sends at most k rows a query and round, whatever it read. Queries are taken in chunks of
`CHUNK_BYTES` at most, each broadcast; the number of chunks follows from their count, and each chunk's result is written.

Components become floor(256 * x); scores are inner products, in doubles where all partial sums stay below 2**53 (one
aggregate proves it) and in Python integers otherwise.

Defined cases: vectors that are null or hold null or non-finite components take no part; a shorter vector counts as padded
with zeros; every row is a candidate of its own, and a query of its own where it is one, also if its id repeats or is null
(null ids come after all others among equal scores); fewer than k candidates give that many rows; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.common import checkpoint, shared_dir

BINS = 1024
CHUNK_BYTES = 8_000_000


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q (longs) and uid (a number for each row) of the rows that take part."""
    x = F.col("embedding")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )
    # checkpointed, so that a row keeps its number
    return checkpoint(usable.select("vec_id", F.transform("embedding", lambda v: F.floor(v * 256)).alias("q"), F.monotonically_increasing_id().alias("uid")))


def _matrix(column: pa.Array, width: int, exact: type) -> np.ndarray:
    out = np.zeros((len(column), width), exact)
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), inner] = flat.astype(exact)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], q_id: np.ndarray, q: np.ndarray, rows: int = 1024):
    """Scores of blocks of queries by blocks of candidates, with a mask of what counts (not the query itself)."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            part = batch.slice(a, rows)
            ids = np.asarray(part.column(2))
            right = _matrix(part.column(1), q.shape[1], q.dtype.type).T
            for b in range(0, len(q), rows):
                score = q[b : b + rows] @ right
                yield b, part, score, q_id[b : b + rows, None] != ids[None, :]


def _counted(batches, q_id, q, low, width, k):
    """Per query the counts of the highest bins of [low, low + BINS * width) that hold k candidates between them; bin BINS is what lies above."""
    counts = np.zeros((len(q), BINS + 1), np.int64)
    for b, _, score, counts_too in _blocks(batches, q_id, q):
        at = np.minimum((score - low[b : b + len(score), None]) // width, BINS)
        use = counts_too & (at >= 0)
        flat = (np.arange(len(score))[:, None] * (BINS + 1) + at)[use].astype(np.int64)
        counts[b : b + len(score)] += np.bincount(flat, minlength=len(score) * (BINS + 1)).reshape(-1, BINS + 1)
    above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    keep = (counts > 0) & (above - counts < k)
    query, bin_ = np.nonzero(keep)
    yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[query, bin_])], ["query", "bin", "n"])


def _reached(batches, q_id, q, least, k):
    """Candidates at or above the k-th score; of one block no more than k a query are handed on, the best by score and id."""
    for b, part, score, counts_too in _blocks(batches, q_id, q):
        row, col = np.nonzero(counts_too & (score >= least[b : b + len(score), None]))
        if len(row):
            ids, none = np.asarray(part.column(0).fill_null(0)), np.asarray(part.column(0).is_null())
            value = score[row, col].astype(np.int64)
            order = np.lexsort((ids[col], none[col], -value, row))
            row, col, value = row[order], col[order], value[order]
            first = np.searchsorted(row, row)
            top = np.arange(len(row)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(q_id[b + row[top]]), part.column(0).take(pa.array(col[top])), pa.array(value[top])], ["uid", "vec_id", "score"])


def _chunk(candidates: DataFrame, q_id: np.ndarray, names: pa.Array, q: np.ndarray, bound: int, k: int) -> DataFrame:
    """Top k of one chunk of queries: numbers, ids and vectors of them."""
    spark = candidates.sparkSession
    send = spark.sparkContext.broadcast((q_id, q))
    exact = q.dtype.type
    low, width = np.full(len(q), -bound).astype(exact), max(1, -(-2 * bound // BINS) + 1)
    above = np.zeros(len(q), np.int64)
    while True:
        def count(batches, low=low, width=width):
            yield from _counted(batches, *send.value, low, width, k)

        # at most k bins a query and task come back from the map side, and BINS + 1 sums a query in all
        rows = candidates.mapInArrow(count, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        highest = Window.partitionBy("query").orderBy(F.desc("bin"))
        found = rows.withColumn("above", F.sum("n").over(highest)).where(F.col("above") - F.col("n") < k)
        found = found.groupBy("query").agg(F.min("bin").alias("bin"), F.max("above").alias("above")).collect()
        at = np.zeros(len(q), np.int64)
        for r in found:
            at[r["query"]] = r["bin"]
            above[r["query"]] = r["above"]
        low = low + at.astype(exact) * width
        if width == 1:
            break
        width = -(-width // BINS)
    # with fewer than k candidates the lowest bin that holds any is found, so the bound is met by all of them

    def reach(batches, least=low):
        yield from _reached(batches, *send.value, least, k)

    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = candidates.mapInArrow(reach, "uid long, vec_id long, score long").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    named = spark.createDataFrame(pa.table({"uid": q_id, "query_id": names}))  # of this chunk alone
    return best.join(F.broadcast(named), "uid").select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest scores of every query: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    n, width, peak = rows.select(F.count_if(is_query), F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v))).first()
    width, bound = width or 0, int(peak or 0) + 1  # Cauchy-Schwarz: no score beyond the largest squared length
    exact = np.float64 if bound * max(1, width) < 2**52 else object
    chunks = max(1, -(-n * max(1, width) * 8 // (CHUNK_BYTES // 2)))
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    for c in range(chunks if n else 0):
        own = rows.where(is_query & (F.pmod(F.xxhash64("uid"), F.lit(chunks)) == c)).toArrow().combine_chunks()
        if not len(own):
            continue
        names, q, q_id = (own.column(i).combine_chunks() for i in range(3))
        part = _chunk(rows, np.asarray(q_id).astype(np.int64), names, _matrix(q, width, exact), bound, k)
        if chunks == 1:
            return part
        # one plan a chunk: their number grows with the queries
        part.write.parquet(f"{folder}/chunk={c}")
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(folder).select("query_id", "rank", "vec_id", "score") if n else spark.createDataFrame([], schema)


def fiftieth(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.pmod("vec_id", F.lit(50)) == 0)


ORACLE = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
