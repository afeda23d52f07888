"""Linear classifier by stochastic gradient descent on the hinge loss.

Rows are dealt to fixed shards by a hash, in which they keep the hash's order. Every pass starts all shards from common
weights; a shard takes its rows one by one, and the weights at the ends are averaged by rows. So a fit depends neither on
partitions nor on their order, and a table of one shard is plain descent. The model has the mean of the weights of the last
pass. Features are scaled to mean 0 and deviation 1 first. Steps shrink by the number of rows taken. A pass ends the fit when
the loss has not fallen by TOLERANCE for PATIENCE passes. More than two classes are fitted against the rest
at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.sources.tables import checkpointed

SHARD, TOLERANCE, PATIENCE = 1 << 13, 1e-3, 5


def shards(df: DataFrame, d: int, size: int = SHARD) -> DataFrame:
    """x and y (packed) of each shard (size rows on average) in the order of a hash of the rows."""
    n = max(1, -(-df.count() // size))
    x = vector_to_array("features")
    rows = df.select(x.alias("x"), "label", F.xxhash64(x, "label").alias("u")).withColumn("s", F.pmod("u", F.lit(n)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        ended = lambda: pa.RecordBatch.from_arrays([pa.array([np.concatenate([h[i] for h in held]).tobytes()]) for i in (0, 1)], ["x", "y"])
        for batch in batches:
            s = np.asarray(batch.column(2))
            cut = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(s)] if len(s) else [0]
            for a, b in zip(cut, cut[1:]):
                if s[a] != shard and held:
                    yield ended()
                    held = []
                shard, part = s[a], batch.slice(a, b - a)
                held.append((np.asarray(part.column(0).flatten().cast(pa.float64()).fill_null(0.0)), np.asarray(part.column(1)).astype(np.int64)))
        if held:
            yield ended()

    return checkpointed(rows.repartition(n, "s").sortWithinPartitions("s", "u").select("x", "label", "s").mapInArrow(pack, "x binary, y binary"))


def descend(x: np.ndarray, signs: np.ndarray, w: np.ndarray, alpha: float, taken: int, begin: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (class, feature and offset) at the end of one pass over rows with signs (row, class) of 1 and -1, their mean over the pass, and the sum of the losses met. x ends with a column of ones."""
    w, mean, loss = w.copy(), np.zeros_like(w), 0.0
    for i in range(len(x)):
        step = 1.0 / (alpha * (begin + taken + i))
        margin = signs[i] * (w @ x[i])
        loss += float(np.maximum(0.0, 1.0 - margin).sum())
        w[:, :-1] *= 1.0 - step * alpha
        w += np.where(margin < 1.0, step * signs[i], 0.0)[:, None] * x[i]
        mean += w / len(x)
    return w, mean, loss


def first_step(alpha: float, size: float) -> float:
    """How many rows the step counts as taken at the start: Bottou's rule for alpha, but no step passes a row of the mean squared size."""
    return max(1.0 / (math.sqrt(1.0 / math.sqrt(alpha)) * alpha), size / alpha)


def _signs(y: np.ndarray, classes: int) -> np.ndarray:
    of = np.arange(classes) if classes > 2 else np.array([1])
    return np.where(y[:, None] == of, 1.0, -1.0)


def fit(df: DataFrame, classes: int, alpha: float, max_iter: int) -> tuple[list[list[float]], list[float]]:
    """Weights by class (of class 1 alone, if there are two) and offsets."""
    d, k = len(df.first()["features"]), classes if classes > 2 else 1
    data = shards(df, d, SHARD).rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["y"], np.int64))).persist()
    add = lambda p, q: tuple(a + b for a, b in zip(p, q))
    n, total = data.map(lambda own: (len(own[0]), own[0].sum(0))).treeReduce(add)
    centre = total / n
    width = np.sqrt(data.map(lambda own: ((own[0] - centre) ** 2).sum(0)).treeReduce(np.add) / n)
    width[width == 0] = 1.0
    w, taken, best, waited, begin = np.zeros((k, d + 1)), 0, math.inf, 0, first_step(alpha, d + 1.0)

    def one(own: tuple, w: np.ndarray, taken: int) -> tuple:
        n, scaled = len(own[0]), np.column_stack([(own[0] - centre) / width, np.ones(len(own[0]))])
        end, mean, loss = descend(scaled, _signs(own[1], classes), w, alpha, taken, begin)
        return end * n, mean * n, loss, n

    for _ in range(max_iter):
        # a shard hands on its weights, which are added up as a tree
        end, mean, loss, _ = data.map(lambda own, w=w, taken=taken: one(own, w, taken)).treeReduce(add)
        w, loss, taken = end / n, loss / n, taken + min(n, SHARD)
        waited = 0 if loss < best - TOLERANCE else waited + 1
        best = min(best, loss)
        if waited >= PATIENCE:
            break
    data.unpersist()
    mean = mean / n
    weights = mean[:, :-1] / width
    return weights.tolist(), (mean[:, -1] - weights @ centre).tolist()
