"""Extremely randomised trees: each node draws some features and, for each, one threshold between the feature's exact extremes
among the node's rows; the best of these splits is taken.

All trees grow together, two aggregates a level: extremes by tree and node, then classes on the left of each drawn threshold.
Blocks of rows stay in their tasks, where rows are routed through the trees so far; what meets over the cluster is one array a
tree, and what reaches the driver are thresholds and chosen splits, as many as the model has nodes. Draws follow from seed,
tree and the node's path, so a fit can be repeated on any partitions. Nulls go right and count in no extreme. A table of one
block (`ROWS` rows) is fitted by the same steps inside its task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.sources.tables import checkpointed

ROWS = 1 << 14


class Tree:
    """Nodes by number: path (1 for the root, 2p and 2p + 1 below p), feature (-1: a leaf), threshold, left, right, counts by class."""

    def __init__(self, counts: list[float]):
        self.path, self.feature, self.threshold, self.left, self.right, self.counts = [1], [-1], [0.0], [-1], [-1], [counts]

    def split(self, node: int, feature: int, threshold: float, left: list[float]) -> list[int]:
        whole, n = self.counts[node], len(self.path)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, n, n + 1
        for side, counts in ((0, left), (1, [w - x for w, x in zip(whole, left)])):
            for name, value in (("path", 2 * self.path[node] + side), ("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("counts", counts)):
                getattr(self, name).append(value)
        return [n, n + 1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def state(self) -> dict:
        return {k: getattr(self, k) for k in ("feature", "threshold", "left", "right", "counts")}


def _by_node(tree: Tree, nodes: list[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the open nodes, sorted by node, and their places among these."""
    place = np.full(len(tree.path), -1)
    place[nodes] = np.arange(len(nodes))
    at = place[tree.leaves(x)]
    rows = np.argsort(at, kind="stable")
    rows = rows[at[rows] >= 0]
    return rows, at[rows]


def _extremes(block: tuple, trees: list[Tree], open_: list[list[int]]) -> Iterator[tuple]:
    """(tree, extremes by node and feature): least values and greatest ones, negated, so that both meet by minimum."""
    x, _ = block
    for t, (tree, nodes) in enumerate(zip(trees, open_)):
        if nodes:
            out = np.full((len(nodes), 2, x.shape[1]), np.inf)
            rows, at = _by_node(tree, nodes, x)
            if len(rows):
                start = np.flatnonzero(np.diff(at, prepend=-1))
                for side, values in enumerate((x[rows], -x[rows])):
                    out[at[start], side] = np.minimum.reduceat(np.where(np.isnan(values), np.inf, values), start)
            yield t, out


def draw(seed: int, tree: int, path: int, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, float]]:
    """Features that are not constant, in a drawn order, with their thresholds."""
    rng = np.random.default_rng((seed, tree, path))
    order, u = rng.permutation(len(low)), rng.random(len(low))
    out = []
    for f in order.tolist():
        if low[f] < high[f] and len(out) < most:
            threshold = float(low[f] + u[f] * (high[f] - low[f]))
            out.append((f, threshold if threshold < high[f] else float(low[f])))
    return out


def _left_counts(block: tuple, trees: list[Tree], open_: list[list[int]], drawn: list, classes: int) -> Iterator[tuple]:
    """(tree, classes on the left by node and drawn split)."""
    x, y = block
    for t, (tree, nodes) in enumerate(zip(trees, open_)):
        if nodes:
            feature, threshold = drawn[t]
            rows, at = _by_node(tree, nodes, x)
            out = np.zeros((len(nodes), feature.shape[1], classes))
            for s in range(feature.shape[1]):
                f = feature[at, s]
                left = (f >= 0) & (x[rows, f] <= threshold[at, s])
                out[:, s] = np.bincount(at[left] * classes + y[rows[left]], minlength=len(nodes) * classes).reshape(-1, classes)
            yield t, out


def _impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times rows."""
    n = counts.sum(-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    if criterion == "entropy":
        return (-np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1)) * n[..., 0]
    return (1 - (p * p).sum(-1)) * n[..., 0]


def best_splits(left: np.ndarray, whole: np.ndarray, feature: np.ndarray, criterion: str, least: int) -> list[int]:
    """The drawn split of the least impurity by node (the first of equal ones), -1 where none parts the rows."""
    right = whole[:, None, :] - left
    cost = _impurity(left, criterion) + _impurity(right, criterion)
    cost = np.where((feature >= 0) & (left.sum(-1) >= least) & (right.sum(-1) >= least), np.round(cost, 9), np.inf)
    at = cost.argmin(1)
    return np.where(np.isfinite(cost[np.arange(len(at)), at]), at, -1).tolist()


class _Cluster:
    def __init__(self, data: RDD):
        self.data = data.persist()

    def met(self, make: Callable, join: Callable, end: Callable) -> list:
        return self.data.flatMap(make).reduceByKey(join, self.data.getNumPartitions()).map(end).collect()


class _Task:
    def __init__(self, data: list[tuple]):
        self.data = data

    def met(self, make: Callable, join: Callable, end: Callable) -> list:
        out: dict = {}
        for block in self.data:
            for k, v in make(block):
                out[k] = join(out[k], v) if k in out else v
        return [end(x) for x in out.items()]


def _grow(data: _Cluster | _Task, counts: list[float], n_trees: int, max_depth: int, most: int, criterion: str, least: int, seed: int) -> list[dict]:
    trees, classes = [Tree(list(counts)) for _ in range(n_trees)], len(counts)
    mixed = lambda tree, nodes: [n for n in nodes if sum(c > 0 for c in tree.counts[n]) > 1 and sum(tree.counts[n]) >= 2 * least]
    open_ = [mixed(t, [0]) for t in trees]
    for _ in range(max_depth):
        if not any(open_):
            break

        def thresholds(item: tuple, open_=open_) -> tuple:
            t, ends = item
            feature, threshold = np.full((len(ends), most), -1), np.zeros((len(ends), most))
            for i, node in enumerate(open_[t]):
                for s, (f, v) in enumerate(draw(seed, t, trees[t].path[node], ends[i, 0], -ends[i, 1], most)):
                    feature[i, s], threshold[i, s] = f, v
            return t, (feature, threshold)

        drawn = dict(data.met(lambda b, open_=open_: _extremes(b, trees, open_), np.minimum, thresholds))

        def chosen(item: tuple, open_=open_, drawn=drawn) -> tuple:
            t, left = item
            feature, threshold = drawn[t]
            at = best_splits(left, np.array([trees[t].counts[n] for n in open_[t]]), feature, criterion, least)
            return t, [None if s < 0 else (int(feature[i, s]), float(threshold[i, s]), left[i, s].tolist()) for i, s in enumerate(at)]

        found = dict(data.met(lambda b, open_=open_, drawn=drawn: _left_counts(b, trees, open_, drawn, classes), np.add, chosen))
        more = []
        for t, tree in enumerate(trees):
            below = []
            for node, split in zip(open_[t], found.get(t, [])):
                if split:
                    below += tree.split(node, *split)
            more.append(mixed(tree, below))
        open_ = more
    return [t.state() for t in trees]


def fit(df: DataFrame, classes: int, n_estimators: int, max_depth: int, max_features: str = "sqrt", criterion: str = "gini", min_samples_leaf: int = 1, seed: int = 42) -> list[dict]:
    """Trees of a fit on features and label (0 to classes - 1)."""
    found = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
    counts, d = [float(found.get(c, 0)) for c in range(classes)], len(df.first()["features"])
    most = max(1, int(math.sqrt(d)) if max_features == "sqrt" else int(math.log2(d)) if max_features == "log2" else d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                x = np.asarray(part.column(0).flatten().cast(pa.float64()).fill_null(np.nan))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([np.asarray(part.column(1)).astype(np.int64).tobytes()])], ["x", "y"])

    packed = checkpointed(df.select(vector_to_array("features").alias("x"), "label").mapInArrow(pack, "x binary, y binary"))
    data = packed.rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["y"], np.int64)))
    grown = lambda own: _grow(own, counts, n_estimators, max_depth, most, criterion, min_samples_leaf, seed)
    if sum(counts) <= ROWS:
        return data.coalesce(1).mapPartitions(lambda own: [grown(_Task(list(own)))]).collect()[0]
    return grown(_Cluster(data))


def shares(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the classes' shares in each row's leaf."""
    out = 0.0
    for t in trees:
        tree = Tree([])
        tree.path = tree.feature = t["feature"]
        tree.threshold, tree.left, tree.right = t["threshold"], t["left"], t["right"]
        counts = np.array(t["counts"])
        out = out + (counts / counts.sum(1, keepdims=True))[tree.leaves(x)]
    return out / len(trees)


def scored(df: DataFrame, trees: list[dict]) -> DataFrame:
    """df with rawScores and probability (the same shares)."""

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(shares(trees, np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    out = df.withColumn("rawScores", score(vector_to_array("features")))
    return out.withColumn("probability", array_to_vector("rawScores"))
