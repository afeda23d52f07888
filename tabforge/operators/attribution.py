"""Exact attributions of forests (Shapley values along the trees' paths): how much each feature moves a row's class shares from
the forest's mean.

For a leaf, only the features on its path matter. A feature that the row follows along the path counts fully, one that it
leaves counts by the share of training rows that would have gone on. A row's part in a leaf depends on which of the path's m
features it follows, so the weighted sums over all subsets are made once for each of the 2**m patterns, for all leaves of a
tree with as many features at once, and rows look theirs up. Rows are scored in Arrow batches where they lie; the forest goes
to the tasks by broadcast, which `MOST_NODES` bounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.sources.tables import scratch_dir

#: Nodes of a forest at most (some 100 bytes each for a few classes), and features on a path.
MOST_NODES, MOST_ON_PATH = 1 << 20, 14


@dataclass
class Tree:
    """Nodes by number, the root first: rows with feature <= threshold go left (feature -1: a leaf); cover is the number of training rows, share the classes' shares among them."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    share: np.ndarray

    def mean(self) -> np.ndarray:
        """Class shares where every split is passed by the training rows' shares."""
        leaf = self.feature < 0
        return (self.cover[leaf, None] * self.share[leaf]).sum(0) / self.cover[0]


def of_forest(model: RandomForestClassificationModel, spark: SparkSession) -> list[Tree]:
    """The trees of a fitted forest, from its stored form."""
    path = f"{scratch_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    threshold = F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))
    rows = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["impurityStats"].alias("stats"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), threshold.alias("threshold"))
    if (found := rows.count()) > MOST_NODES:
        raise ValueError(f"a forest of {found} nodes is beyond {MOST_NODES}")
    by: dict[int, list] = {}
    for r in rows.collect():
        by.setdefault(r["treeID"], []).append(r)
    out = []
    for _, nodes in sorted(by.items()):
        nodes.sort(key=lambda r: r["id"])
        at = {r["id"]: i for i, r in enumerate(nodes)}
        inner = np.array([r["left"] >= 0 for r in nodes])
        stats = np.array([r["stats"] for r in nodes])
        child = lambda c: np.array([at.get(r[c], -1) for r in nodes])  # noqa: E731,B023
        out.append(Tree(np.where(inner, [r["feature"] for r in nodes], -1), np.array([r["threshold"] or 0.0 for r in nodes]), child("left"), child("right"), stats.sum(1), stats / stats.sum(1, keepdims=True)))
    return out


def _paths(tree: Tree) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf with the splits on its path: node and whether it goes left."""
    open_: list[tuple[int, list]] = [(0, [])]
    while open_:
        node, way = open_.pop()
        if tree.feature[node] < 0:
            yield node, way
        else:
            open_ += [(int(tree.left[node]), [*way, (node, True)]), (int(tree.right[node]), [*way, (node, False)])]


def _weights(zero: np.ndarray) -> np.ndarray:
    """By leaf, pattern of followed features and feature: the attribution of a leaf of value 1. zero: by leaf and feature, the share of rows that go on."""
    leaves, m = zero.shape
    pattern = np.arange(1 << m)
    out = np.zeros((leaves, 1 << m, m))
    share = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    for j in range(m):
        # by how many others are in the subset: followed ones may be, and all outside count by their share
        sums = np.zeros((m, leaves, 1 << m))
        sums[0] = 1.0
        for k in (k for k in range(m) if k != j):
            follows = (pattern >> k & 1)[None, :]
            more = sums[:-1] * follows
            sums *= zero[:, k, None]
            sums[1:] += more
        out[:, :, j] = np.tensordot(share, sums, 1) * ((pattern >> j & 1)[None, :] - zero[:, j, None])
    return out


class Forest:
    """Trees with their paths by number of features."""

    def __init__(self, trees: list[Tree]):
        self.trees, self.groups = trees, []
        for tree in trees:
            by: dict[int, list] = {}
            for leaf, way in _paths(tree):
                features = list(dict.fromkeys(int(tree.feature[n]) for n, _ in way))
                if len(features) > MOST_ON_PATH:
                    raise ValueError(f"a path with more than {MOST_ON_PATH} features")
                zero = np.ones(len(features))
                for n, left in way:
                    child = tree.left[n] if left else tree.right[n]
                    zero[features.index(int(tree.feature[n]))] *= tree.cover[child] / tree.cover[n]
                by.setdefault(len(features), []).append((leaf, way, features, zero))
            self.groups.append({m: rows for m, rows in by.items() if m})

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """By class, feature and row."""
        classes = self.trees[0].share.shape[1]
        out = np.zeros((classes, x.shape[1], len(x)))
        for tree, groups in zip(self.trees, self.groups):
            passes = {n: x[:, tree.feature[n]] <= tree.threshold[n] for n in np.flatnonzero(tree.feature >= 0).tolist()}
            for m, rows in groups.items():
                step = max(1, (1 << 20) // (m << m))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    weights = _weights(np.array([zero for *_, zero in part]))
                    for (leaf, way, features, _), own in zip(part, weights):
                        code = np.zeros(len(x), np.int64)
                        for j, f in enumerate(features):
                            follows = np.ones(len(x), bool)
                            for n, left in way:
                                if tree.feature[n] == f:
                                    follows &= passes[n] if left else ~passes[n]
                            code |= follows.astype(np.int64) << j
                        for j, f in enumerate(features):
                            found = own[code, j]
                            for c in np.flatnonzero(tree.share[leaf]).tolist():
                                out[c, f] += found * tree.share[leaf, c]
        return out / len(self.trees)


def attributed(df: DataFrame, model: RandomForestClassificationModel, keep: Sequence[str] = ()) -> DataFrame:
    """keep, and attributions: by class, one number a feature. With the forest's mean they add up to the row's probabilities."""
    send = df.sparkSession.sparkContext.broadcast(Forest(of_forest(model, df.sparkSession)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = send.value.attributions(_matrix(batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.transpose(2, 0, 1).tolist(), pa.list_(pa.list_(pa.float64())))], [*batch.schema.names[:-1], "attributions"])

    rows = df.select(*keep, vector_to_array("features").alias("_x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_x"), "attributions array<array<double>>"])
    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(column), -1)


def importance(df: DataFrame, columns: Sequence[str], model: RandomForestClassificationModel, n: int = 20) -> DataFrame:
    """feature, importance and rank: the mean over all rows and classes of the attribution's size. A task hands on one sum a feature."""
    send, d = df.sparkSession.sparkContext.broadcast(Forest(of_forest(model, df.sparkSession))), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(d), 0
        for batch in batches:
            for a in range(0, len(batch), 2048):
                x = _matrix(batch.column(0).slice(a, 2048))
                total += np.abs(send.value.attributions(x)).mean(0).sum(1)
                rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total), pa.array([rows] * d)], ["feature", "total", "rows"])

    sums = df.select(vector_to_array("features").alias("x")).mapInArrow(run, "feature int, total double, rows long")
    found = sums.groupBy("feature").agg((F.sum("total") / F.sum("rows")).alias("importance")).collect()
    got = sorted(((columns[r["feature"]], r["importance"] or 0.0) for r in found), key=lambda x: (-x[1], x[0]))[: min(n, d)]
    return df.sparkSession.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(got)], "feature string, importance double, rank int")
