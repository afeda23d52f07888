"""Exact nearest neighbours, in cells around pivots.

Pivots are rows drawn by a hash, about one for `CELL` rows; every row belongs to the cell of its nearest pivot. Of each cell
(and group) the number of rows, the radius and the distance of the k-th row from the pivot are known. A query whose distances
to the pivots are d has k rows within the least d + k-th distance, so by the triangle inequality only cells with
d - radius within this bound can hold a nearer one, and it is sent to these alone. Rounding errors widen the bound.

Cells are cut into blocks of a bounded number of rows, each of which goes to one task and stays there; queries are packed for
each of their cells where they are read (an equality join on cell and block, the only shuffle of them). A pair of blocks is
scored in numpy on the flat Arrow arrays and hands on the k best of its rows for each query; they meet in one window per
query, which is cut to k before it is shuffled. Memory is that of two blocks.

Where cells do not part the points, as in many dimensions, every query meets every row, as an exact search then must. To send
queries to their cells would copy each of them for every cell, so `SENT` numbers a query at most are sent (they are counted
first); beyond that `blocks` reads all rows for each block of queries, and sends none. `work` tells how many pairs the cells leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators import blocks as every

BLOCK, CELL, MOST_PIVOTS = 8192, 256, 2048
#: Points whose distances to all pivots a task holds at once; numbers that are sent for a query, on average (two copies are always few).
SLICE, SENT = 1024, 64
#: Cells of all groups at most; their numbers go to every task.
MOST_CELLS = 1 << 17
DIGITS = 9
#: What rounding may add to a distance, as a share and as such.
SLACK = 1e-6


def _points(column: pa.Array, width: int) -> np.ndarray:
    size = np.asarray(column.value_lengths())
    if (size != width).any():
        raise ValueError(f"points of unequal length: one has {size[(size != width).argmax()]} numbers, another {width}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


class Cells:
    """Pivots, and by group the cells' numbers, radii, distances of the k-th row (infinite, if there are fewer) and blocks."""

    def __init__(self, pivots: np.ndarray, p: int):
        self.pivots, self.p, self.groups = pivots, p, {}

    def distances(self, x: np.ndarray) -> np.ndarray:
        if self.p == 1:
            return np.stack([np.abs(x - one).sum(1) for one in self.pivots], axis=1)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots * self.pivots).sum(1)[None, :], 0.0))

    def slack(self, x: np.ndarray) -> float:
        return SLACK * (1.0 + max(np.abs(x).max(initial=0.0), np.abs(self.pivots).max(initial=0.0)) * x.shape[1])

    def wanted(self, far: np.ndarray, group: str, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of a group, their blocks, and which of them each query needs."""
        cell, radius, kth, blocks, _ = self.groups[group]
        own = far[:, cell]
        bound = (own + kth[None, :]).min(1) + slack
        return cell, blocks, own - radius[None, :] <= bound[:, None] + slack


def _cells(rows: DataFrame, k: int, p: int, within: bool) -> tuple[Cells, DataFrame]:
    """Cells of rows (id, x, g), and the rows with cell c and block b."""
    n, groups = rows.count(), rows.select("g").distinct().count() if within else 1
    most = max(1, min(-(-n // CELL), MOST_PIVOTS, MOST_CELLS // max(groups, 1)))
    pivots = [r["x"] for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").select("x").limit(most).collect()] or [[0.0]]
    width = len(pivots[0])
    if any(len(v) != width for v in pivots):
        raise ValueError(f"points of unequal length: one has {next(len(v) for v in pivots if len(v) != width)} numbers, another {width}")
    cells = Cells(np.array(pivots, float), p)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), SLICE):
                part = batch.slice(a, SLICE)
                far = cells.distances(_points(part.column(1), width))
                c = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c.astype(np.int32)), pa.array(far[np.arange(len(c)), c])], ["id", "x", "g", "c", "r"])

    placed = rows.mapInArrow(own, "id long, x array<double>, g string, c int, r double")
    ranked = placed.select("g", "c", "r", F.row_number().over(Window.partitionBy("g", "c").orderBy("r")).alias("n")).where(F.col("n") <= k)
    kth = ranked.groupBy("g", "c").agg(F.max(F.when(F.col("n") == k, F.col("r"))).alias("kth"))
    found = placed.groupBy("g", "c").agg(F.count("*").alias("n"), F.max("r").alias("radius")).join(kth, ["g", "c"]).orderBy("g", "c").collect()
    by: dict[str, list] = {}
    for r in found:
        by.setdefault(r["g"], []).append((r["c"], r["radius"], np.inf if r["kth"] is None else r["kth"], -(-r["n"] // BLOCK), r["n"]))
    cells.groups = {g: tuple(np.array(v) for v in zip(*own)) for g, own in by.items()}
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(r["g"], r["c"], -(-r["n"] // BLOCK)) for r in found], "g string, c int, blocks int")
    block = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    return cells, placed.drop("r").join(blocks, ["g", "c"]).withColumn("b", block).drop("blocks")


def _parted(queries: DataFrame, cells) -> bool:
    """Whether the cells part the points, so that few queries need sending. cells: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, copies = cells.value, 0, 0
        for batch in batches if own.groups else ():
            for a in range(0, len(batch), SLICE):
                part = batch.slice(a, SLICE)
                x, group = _points(part.column(1), own.pivots.shape[1]), np.array(part.column(2).to_pylist(), object)
                far, slack, n = own.distances(x), own.slack(x), n + len(part)
                for g in set(group) & own.groups.keys():
                    _, blocks, needs = own.wanted(far[group == g], g, slack)
                    copies += int((needs.sum(0) * blocks).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([copies], pa.int64())], ["n", "copies"])

    n, copies = queries.mapInArrow(run, "n long, copies long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "copies"))).first()
    return copies <= max(2, SENT / cells.value.pivots.shape[1]) * n


def _routed(queries: DataFrame, cells) -> DataFrame:
    """g, c, blocks, pairs (rows of the cell times queries) and q (packed queries) of each cell that queries of a batch need. cells: broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cells.value
        for batch in batches if own.groups else ():
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x, group = _points(part.column(1), own.pivots.shape[1]), np.array(part.column(2).to_pylist(), object)
                far, slack = own.distances(x), own.slack(x)
                packed = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["id", "x"])
                out = []
                for g in sorted(set(group) & own.groups.keys()):
                    at = np.flatnonzero(group == g)
                    cell, blocks, needs = own.wanted(far[at], g, slack)
                    out += [(g, int(cell[j]), int(blocks[j]), int(own.groups[g][4][j]), at[needs[:, j]]) for j in np.flatnonzero(needs.any(0))]
                for g, c, blocks, n, at in out:
                    q = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), packed.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([c], pa.int32()), pa.array([blocks], pa.int32()), pa.array([n * len(at)], pa.int64()), q], ["g", "c", "blocks", "pairs", "q"])

    return queries.mapInArrow(run, "g string, c int, blocks int, pairs long, q array<struct<id: long, x: array<double>>>")


def _unpacked(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """ids, ascending, and the matrix of their points."""
    ids, x = rows.values.field("id").to_numpy(), rows.values.field("x").flatten().to_numpy()
    size = np.asarray(rows.values.field("x").value_lengths())
    if (size != size[0]).any():
        raise ValueError(f"points of unequal length: row {ids[0]} has {size[0]} numbers, row {ids[(size != size[0]).argmax()]} has {size[(size != size[0]).argmax()]}")
    order = np.argsort(ids, kind="stable")
    return ids[order], x.reshape(len(ids), -1)[order]


def _distances(q: np.ndarray, r: np.ndarray, p: int) -> np.ndarray:
    if p == 1 or q.shape[1] <= 16:
        gap = q[:, None, :] - r[None, :, :]
        return np.abs(gap).sum(2) if p == 1 else np.sqrt((gap * gap).sum(2))
    return np.stack([np.sqrt(((r - one) ** 2).sum(1)) for one in q])


def _nearest(qi: np.ndarray, qx: np.ndarray, ri: np.ndarray, rx: np.ndarray, k: int, exclude_self: bool, p: int) -> Iterator[tuple]:
    """Query, neighbour and distance of the k best of one block of rows, some queries at a time."""
    some = max(1, min(256, (1 << 22) // max(1, rx.size)))
    for a in range(0, len(qi), some):
        d = np.round(_distances(qx[a : a + some], rx, p), DIGITS)
        if exclude_self:
            d[qi[a : a + some, None] == ri[None, :]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1, None]
        row, col = np.nonzero((d <= kth) & np.isfinite(d))
        order = np.lexsort((col, d[row, col], row))  # columns stand in the order of their ids
        row, col = row[order], col[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield qi[a + row[top]], ri[col[top]], d[row[top], col[top]]


def _clean(df: DataFrame, within: bool) -> DataFrame:
    group = F.col("g").cast("string") if within else F.lit("")
    return df.where("id is not null and x is not null").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), group.alias("g"))


def _plan(queries: DataFrame, rows: DataFrame, k: int, within: bool, exclude_self: bool, p: int) -> tuple[DataFrame, DataFrame, object]:
    """Queries, rows by cell and block, and the cells (broadcast)."""
    cells, placed = _cells(_clean(rows, within), k + int(exclude_self), p, within)
    return _clean(queries, within).where("g is not null"), placed, queries.sparkSession.sparkContext.broadcast(cells)


def work(queries: DataFrame, rows: DataFrame, k: int, within: bool = False, exclude_self: bool = True, p: int = 2) -> int:
    """How many pairs of a query and a row the cells leave."""
    asked, _, cells = _plan(queries, rows, k, within, exclude_self, p)
    return _routed(asked, cells).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def knn(queries: DataFrame, rows: DataFrame, k: int, within: bool = False, exclude_self: bool = True, p: int = 2) -> DataFrame:
    """id, neighbour, distance and rank (from 1) of the k nearest rows of each query.

    queries and rows: id (long) and x (array of double), with within also g, and only rows of the query's group count. Ties
    (distances equal to nine digits) go to the smaller id. Rows with a null id or x take no part. p: 2 Euclidean, 1 Manhattan.
    """
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    ranked = lambda scored: scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked, placed, cells = _plan(queries, rows, k, within, exclude_self, p)
    if not _parted(asked, cells):
        return ranked(every.nearest(asked, _clean(rows, within).where("g is not null"), k, exclude_self, p))
    routed = _routed(asked, cells)
    blocks = placed.groupBy("g", "c", "b").agg(F.collect_list(F.struct("id", "x")).alias("r"))
    grid = routed.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(blocks, ["g", "c", "b"]).select("q", "r")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, r in zip(batch.column(0), batch.column(1)):
                left, right = _unpacked(q), _unpacked(r)
                if left[1].shape[1] != right[1].shape[1]:
                    raise ValueError(f"points of unequal length: row {left[0][0]} has {left[1].shape[1]} numbers, row {right[0][0]} has {right[1].shape[1]}")
                for found in _nearest(*left, *right, k, exclude_self, p):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "neighbour", "distance"])

    return ranked(grid.mapInArrow(best, "id long, neighbour long, distance double"))


def vote(neighbours: DataFrame, labels: DataFrame, weights: str = "uniform") -> DataFrame:
    """id and prediction: the commonest label of the neighbours (ties: the smallest), or the one of most inverse distance. labels: id, label."""
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    counted = neighbours.join(labels.withColumnRenamed("id", "neighbour"), "neighbour").groupBy("id", "label").agg(F.sum(w).alias("w"))
    return counted.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("prediction"))


def approximate(queries: DataFrame, rows: DataFrame, radius: float) -> DataFrame:
    """All pairs within a radius (distances to nine digits), by blocks: id, neighbour and distance. None is missed, and pairs are never shuffled."""
    return every.within(_clean(queries, False), _clean(rows, False), radius)
