"""Every query meets every row of its group, in blocks that are read over and over instead of being sent.

Points are packed in blocks where they are read, as 32-bit floats where these hold the same numbers. The rows' blocks are
written once to the shared folder. A task owns some blocks of queries and reads all blocks of rows one after another (Spark's
cartesian product of two RDDs, which streams and keeps nothing), so what is written grows with the points, not with the pairs,
and memory is that of two blocks. A product of matrices sifts the pairs; the few that it leaves are measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.sources.tables import checkpointed

#: Points of a block, least points of a block of queries, and blocks of queries for each core, if there are enough points.
BLOCK, LEAST, EACH = 4096, 256, 3
#: Pairs that are sifted, and numbers that are subtracted, at once.
SIFTED, EXACT = 1 << 22, 1 << 22
#: Results of a packed row.
SENT = 256
#: What rounding may add to a squared distance, as a share of the squares, and how many digits of a distance count.
SHARE, DIGITS = 1e-12, 9

Block = dict[str, tuple[np.ndarray, np.ndarray]]


def _packed(points: DataFrame, size: int) -> DataFrame:
    """Blocks of the points (id, x and g). Points that are not finite are at no distance from any other and take no part."""

    def block(batch: pa.RecordBatch) -> list:
        width = np.asarray(batch.column(1).value_lengths())
        if (width != width[0]).any():
            raise ValueError(f"points of unequal length: one has {width[0]} numbers, another {width[width != width[0]][0]}")
        ids, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width[0])
        codes = batch.column(2).dictionary_encode()
        names, group = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, group))
        order = order[np.isfinite(x[order]).all(1)]
        x, group = x[order], group[order]
        with np.errstate(over="ignore"):
            narrow = x.astype(np.float32)
        x = narrow if (narrow == x).all() else x
        return [ids[order].tobytes(), x.tobytes(), x.itemsize, int(width[0]), names, np.searchsorted(group, np.arange(len(names) + 1)).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def ended() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block(table), (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())))], names)

        for batch in batches:
            while len(batch):
                part, batch = batch.slice(0, size - n), batch.slice(size - n)
                held.append(part)
                n += len(part)
                if n == size:
                    yield ended()
                    held, n = [], 0
        if n:
            yield ended()

    names = ["ids", "x", "bytes", "width", "names", "cut"]
    return points.select("id", "x", "g").mapInArrow(run, "ids binary, x binary, bytes int, width int, names array<string>, cut array<long>")


def _unpacked(row) -> Block:
    """ids, ascending, and points by group."""
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["x"], np.float32 if row["bytes"] == 4 else np.float64).reshape(len(ids), row["width"]).astype(np.float64)
    return {g: (ids[a:b], x[a:b]) for g, a, b in zip(row["names"], row["cut"], row["cut"][1:]) if b > a}


def _product(queries: DataFrame, rows: DataFrame):
    """An RDD of all pairs of a numbered block of queries and a block of rows."""
    n, m = queries.count(), rows.count()
    size = min(BLOCK, max(LEAST, -(-n // (EACH * queries.sparkSession.sparkContext.defaultParallelism))))
    few = lambda df, count, size: df.coalesce(max(1, -(-count // size)))
    left = _packed(few(queries, n, BLOCK), size).repartition(max(1, -(-n // size))).withColumn("no", F.monotonically_increasing_id())
    return left.rdd.cartesian(checkpointed(_packed(few(rows, m, BLOCK), BLOCK)).coalesce(1).rdd)


def _exact(q: np.ndarray, r: np.ndarray, row: np.ndarray, col: np.ndarray, p: int) -> np.ndarray:
    """Distances of the pairs row, col of two matrices, some at a time."""
    out, some = np.empty(len(row)), max(1, EXACT // max(1, q.shape[1]))
    for a in range(0, len(row), some):
        gap = q[row[a : a + some]] - r[col[a : a + some]]
        out[a : a + some] = np.abs(gap).sum(1) if p == 1 else np.sqrt((gap * gap).sum(1))
    return np.round(out, DIGITS)


def _sifted(q: np.ndarray, r: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """Powers (p) of all distances of two matrices, and what rounding may have added to one."""
    if p == 2:
        centre = q.mean(0)
        q0, r0 = q - centre, r - centre
        q2, r2 = (q0 * q0).sum(1), (r0 * r0).sum(1)
        error = SHARE * (1.0 + q2.max() + r2.max())
        if np.isfinite(error):
            out = q0 @ r0.T
            out *= -2.0
            out += q2[:, None]
            out += r2[None, :]
            return out, error
    out, some = np.empty((len(q), len(r))), max(1, EXACT // max(1, r.size))
    for a in range(0, len(q), some):
        gap = q[a : a + some, None, :] - r[None, :, :]
        out[a : a + some] = np.abs(gap).sum(2) if p == 1 else (gap * gap).sum(2)
    return out, SHARE * (1.0 + float(out.max(initial=0.0)))


def _pairs(qs: Block, rs: Block) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, place of the first query in it, and the points of both sides, some queries at a time."""
    for g in qs.keys() & rs.keys():
        (qi, qx), (ri, rx) = qs[g], rs[g]
        if qx.shape[1] != rx.shape[1]:
            raise ValueError(f"points of unequal length: row {qi[0]} has {qx.shape[1]} numbers, row {ri[0]} has {rx.shape[1]}")
        some = max(1, SIFTED // len(ri))
        for a in range(0, len(qi), some):
            yield g, a, qi[a : a + some], qx[a : a + some], ri, rx


def _table(spark, rdd, names: list[str]) -> DataFrame:
    """Rows (id, neighbour, distance) of an RDD of packed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [np.frombuffer(b"".join(c.to_pylist()), t) for c, t in zip(batch.columns, (np.int64, np.int64, np.float64))]
            for a in range(0, len(flat[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + (1 << 16)]) for v in flat], names)

    packed = spark.createDataFrame(rdd, ", ".join(f"{c} binary" for c in names), verifySchema=False)
    return packed.mapInArrow(run, "id long, neighbour long, distance double")


_NAMES = ["id", "neighbour", "distance"]


def _sent(*columns: np.ndarray) -> Iterator[tuple]:
    """Packed rows of `SENT` results, few enough that a batch of them (10,000 rows by Spark's default) stays at some 60 MB."""
    for a in range(0, len(columns[0]), SENT):
        yield tuple(v[a : a + SENT].tobytes() for v in columns)


def _better(best: tuple[np.ndarray, np.ndarray], a: int, qi: np.ndarray, qx: np.ndarray, ri: np.ndarray, rx: np.ndarray, k: int, exclude_self: bool, p: int) -> None:
    """Takes rows among the k best (distances and ids) of some queries, whose places begin at a."""
    d, ids = best[0][a : a + len(qi)], best[1][a : a + len(qi)]
    far, error = _sifted(qx, rx, p)
    if exclude_self and len(own := np.flatnonzero(np.isin(qi, ri))):
        far[own] = np.where(qi[own, None] == ri[None, :], np.inf, far[own])
    least = d[:, -1]
    bound = (least + 2 * 10.0**-DIGITS) ** p + error
    if np.isinf(least).any() and far.shape[1] > k:
        kth = np.sqrt(np.maximum(np.partition(far, k - 1, axis=1)[:, k - 1] + error, 0.0)) if p == 2 else np.partition(far, k - 1, axis=1)[:, k - 1] + error
        bound = np.minimum(bound, (kth + 2 * 10.0**-DIGITS) ** p + error)
    row, col = np.nonzero((far <= bound[:, None]) & np.isfinite(far))
    if not len(row):
        return
    now = _exact(qx, rx, row, col, p)
    keep = np.isfinite(now)
    row, col, now = row[keep], col[keep], now[keep]
    met = np.unique(row)
    rows, dist, near = np.concatenate([np.repeat(met, k), row]), np.concatenate([d[met].ravel(), now]), np.concatenate([ids[met].ravel(), ri[col]])
    order = np.lexsort((near, dist, rows))
    rows = rows[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = order[rank < k]
    d[met], ids[met] = dist[top].reshape(-1, k), near[top].reshape(-1, k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = True, p: int = 2) -> DataFrame:
    """id, neighbour and distance of the k nearest rows of the group of each query. Columns: id (long), x (array of double) and g (string)."""

    def run(pairs) -> Iterator[tuple]:
        best, last, qs = {}, None, {}
        for left, right in pairs:
            if left["no"] != last:
                last, qs = left["no"], _unpacked(left)
                if last not in best:
                    best[last] = {g: (np.repeat(qi, k).tobytes(), np.full((len(qi), k), np.inf), np.full((len(qi), k), np.iinfo(np.int64).max)) for g, (qi, _) in qs.items()}
            for g, a, *points in _pairs(qs, _unpacked(right)):
                _better(best[last][g][1:], a, *points, k, exclude_self, p)
        for groups in best.values():
            for own, d, ids in groups.values():
                there = np.isfinite(d).ravel()
                yield from _sent(np.frombuffer(own, np.int64)[there], ids.ravel()[there], d.ravel()[there])

    return _table(queries.sparkSession, _product(queries, rows).mapPartitions(run), _NAMES)


def within(queries: DataFrame, rows: DataFrame, radius: float, p: int = 2) -> DataFrame:
    """id, neighbour and distance of all pairs of one group at the radius or less, with other ids. Columns as `nearest` takes them."""

    def run(pairs) -> Iterator[tuple]:
        last, qs = None, {}
        for left, right in pairs:
            if left["no"] != last:
                last, qs = left["no"], _unpacked(left)
            for _, _, qi, qx, ri, rx in _pairs(qs, _unpacked(right)):
                far, error = _sifted(qx, rx, p)
                row, col = np.nonzero(far <= (radius + 10.0**-DIGITS) ** p + error)
                other = qi[row] != ri[col]
                row, col = row[other], col[other]
                d = _exact(qx, rx, row, col, p)
                near = d <= radius
                yield from _sent(qi[row[near]], ri[col[near]], d[near])

    return _table(queries.sparkSession, _product(queries, rows).mapPartitions(run), _NAMES)
