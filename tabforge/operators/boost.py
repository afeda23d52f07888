"""Boosted trees of three kinds, grown level by level from sums over the cluster.

Features are cut into bins at quantiles (nulls have a bin of their own); rows are packed into blocks of bins, which stay where
they are. One aggregate serves all open nodes of all classes: a task adds up gradient, second derivative and number of its
rows by node, feature and bin; the sums meet by class and group of features, and what is handed on is each group's best split
of each node, so the driver sees a few numbers a node, whatever the rows and bins.

`depth`: every node of a level is split while that lowers the penalised loss; nulls go to the side they lower it more on.
`leaf`: best-first, a queue of leaves by gain up to `num_leaves`. Nodes are looked at one level ahead of the queue, so a tree
needs as many aggregates as it is deep and not as it has leaves, and has the splits that one at a time would have.
`symmetric`: one split for all nodes of a level, that of the greatest gain over all; nulls go left.

With `top_rate` below 1 a tree is grown on the rows of the largest gradients and a share `other_rate` of the others, which
count for all of them. Rows are drawn by a hash of their values and the round, so fits do not depend on partitions.
Categories (`categorical`: places of features) give way to statistics of the target. In training these come from the rows
before in an order by hash, so that no row's own label is among them; in scoring from all training rows.

Scores of the trees so far are recomputed from the bins for `REBASE` rounds, then written with the blocks (checkpoint). A
table of one block (`ROWS` rows) is fitted by the same steps inside its task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.stats import running_before
from tabforge.sources.tables import checkpointed

BINS, MISSING = 256, 255
ROWS, FEATURES, REBASE = 1 << 14, 16, 10
PRIOR_WEIGHT = 1.0


@dataclass
class Growth:
    """How trees are grown."""

    kind: str = "depth"
    max_depth: int = 6
    num_leaves: int = 31
    penalty: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    least_rows: int = 1
    subsample: float = 1.0
    columns: float = 1.0
    top_rate: float = 1.0
    other_rate: float = 0.1


@dataclass
class Tree:
    """Nodes by number, the root first: feature (-1: a leaf), bin (up to which rows go left), null_left, left, right, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, null_left: bool) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.null_left[node] = feature, bin_, null_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for name, empty in (("feature", -1), ("bin", 0), ("null_left", False), ("left", -1), ("right", -1), ("value", 0.0)):
            getattr(self, name).extend([empty, empty])
        return self.left[node], self.right[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        feature, bin_, null_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.null_left, self.left, self.right))
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            b = bins[inner, feature[node]]
            at[inner] = np.where(np.where(b == MISSING, null_left[node], b <= bin_[node]), left[node], right[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


def bin_edges(df: DataFrame) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: quantiles among its values."""
    cells = df.select(F.posexplode(vector_to_array("features")).alias("pos", "v")).where("v is not null and not isnan(v)")
    shares = [i / (BINS - 2) for i in range(1, BINS - 2)]
    found = {r["pos"]: r["q"] for r in cells.groupBy("pos").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()}
    d = len(df.first()["features"])
    return [np.unique(np.array(found.get(i) or [], float)) for i in range(d)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(e, x[:, i]))
    return out


@dataclass
class Block:
    """Rows in a task: bins, class, hash and scores of the rounds before."""

    bins: np.ndarray
    y: np.ndarray
    u: np.ndarray
    raw: np.ndarray

    def gradients(self, trees: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second derivatives of the logarithmic loss by row and class, and the scores, with the trees since the block was written."""
        raw = self.raw.copy()
        for row in trees:
            for k, tree in enumerate(row):
                raw[:, k] += tree.scores(self.bins)
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw))
            return p - self.y[:, None], np.maximum(p * (1 - p), 1e-16), raw
        p = np.exp(raw - raw.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p - (self.y[:, None] == np.arange(raw.shape[1])), np.maximum(p * (1 - p), 1e-16), raw

    def drawn(self, seed: int) -> np.ndarray:
        """A number from 0 to 1 for each row, by its hash and the seed."""
        x = self.u ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2**64

    def weights(self, g: np.ndarray, growth: Growth, round_: int, limit: float) -> np.ndarray:
        """How often each row counts in this round's trees."""
        w = (self.drawn(2 * round_) < growth.subsample).astype(float)
        if growth.top_rate < 1:
            rest = (1 - growth.top_rate) / growth.other_rate
            w *= np.where(np.abs(g).sum(1) >= limit, 1.0, np.where(self.drawn(2 * round_ + 1) < 1 / rest, rest, 0.0))
        return w


def blocks(df: DataFrame, edges: list[np.ndarray], start: list[float]) -> RDD:
    """Blocks of the rows (features, label)."""
    d, k = len(edges), len(start)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                x = np.asarray(part.column(0).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (binned(x, edges), np.asarray(part.column(1)).astype(np.int32), np.asarray(part.column(2)))], ["b", "y", "u"])

    x = vector_to_array("features")
    packed = checkpointed(df.select(x.alias("x"), "label", F.xxhash64(x, "label").alias("u")).mapInArrow(pack, "b binary, y binary, u binary"))

    def unpack(r) -> Block:
        y = np.frombuffer(r["y"], np.int32)
        return Block(np.frombuffer(r["b"], np.uint8).reshape(len(y), d), y, np.frombuffer(r["u"], np.int64).view(np.uint64), np.tile(np.array(start), (len(y), 1)).reshape(len(y), k))

    return packed.rdd.map(unpack)


def _histogram(block: Block, trees: list[list[Tree]], growing: list[Tree], open_: list[list[int]], growth: Growth, round_: int, limit: float) -> Iterator[tuple]:
    """((class, group of features), sums by open node, feature and bin): gradient, second derivative, rows."""
    g, h, _ = block.gradients(trees)
    w = block.weights(g, growth, round_, limit)
    d = block.bins.shape[1]
    for k, (tree, nodes) in enumerate(zip(growing, open_)):
        if not nodes:
            continue
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        at = place[tree.leaves(block.bins)]
        use = np.flatnonzero((at >= 0) & (w > 0))
        cell, of = at[use] * BINS, [w[use] * g[use, k], w[use] * h[use, k], w[use]]
        for a in range(0, d, FEATURES):
            own = range(a, min(a + FEATURES, d))
            yield (k, a), np.stack([np.stack([np.bincount(cell + block.bins[use, f], v, len(nodes) * BINS).reshape(len(nodes), BINS) for v in of], axis=2) for f in own], axis=1)


def _quality(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return np.divide(g * g, h + penalty, out=np.zeros_like(g), where=h + penalty > 0)


def _gains(sums: np.ndarray, growth: Growth) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain of each node, feature, bin and side of the nulls (right, left); the left sums of each; the whole sums of each node."""
    whole = sums[:, :1].sum(2)
    left = np.cumsum(sums[:, :, : MISSING - 1], axis=2)
    left = np.stack([left, left + sums[:, :, MISSING:]], axis=3)
    right = whole[:, :, None, None] - left
    gain = _quality(left[..., 0], left[..., 1], growth.penalty) + _quality(right[..., 0], right[..., 1], growth.penalty) - _quality(whole[..., 0], whole[..., 1], growth.penalty)[:, :, None, None]
    fits = lambda s: (s[..., 1] >= growth.least_hessian) & (s[..., 2] >= growth.least_rows)
    return np.where(fits(left) & fits(right), gain / 2, -np.inf), left, whole[:, 0]


def _best(item: tuple, growth: Growth, allowed: list[np.ndarray]) -> tuple:
    """Class and, for each node of a group of features (for all nodes at once, where trees are symmetric), gain, feature, bin, side of the nulls, left sums and whole sums."""
    (k, first), sums = item
    gain, left, whole = _gains(sums, growth)
    gain[:, ~allowed[k][first : first + gain.shape[1]]] = -np.inf
    if growth.kind == "symmetric":
        # a node that a split does not part neither gains nor loses
        total = np.where(np.isfinite(gain[..., 1]), gain[..., 1], 0.0).sum(0)
        total[~np.isfinite(gain[..., 1]).any(0)] = -np.inf
        f, b = np.unravel_index(int(total.argmax()), total.shape)
        return k, [(float(total[f, b]), first + int(f), int(b), True, left[:, f, b, 1].tolist(), whole.tolist())]
    out = []
    for n in range(len(gain)):
        f, b, side = np.unravel_index(int(gain[n].argmax()), gain[n].shape)
        out.append((float(gain[n, f, b, side]), first + int(f), int(b), bool(side), left[n, f, b, side].tolist(), whole[n].tolist()))
    return k, out


class Spread:
    """Blocks in many tasks: one aggregate of the cluster for each question."""

    def __init__(self, data: RDD, keys: int):
        self.data, self.partitions = data.persist(), max(1, min(data.getNumPartitions(), keys))

    def best(self, trees: list, growing: list[Tree], open_: list[list[int]], growth: Growth, round_: int, limit: float, allowed: list) -> list[tuple]:
        sums = self.data.flatMap(lambda b: _histogram(b, trees, growing, open_, growth, round_, limit)).reduceByKey(np.add, self.partitions)
        return sums.map(lambda item: _best(item, growth, allowed)).collect()

    def sizes(self, trees: list) -> np.ndarray:
        return self.data.map(lambda b: _sizes(b, trees)).treeReduce(np.add)

    def rebase(self, recent: list[list[Tree]]) -> None:
        """Writes blocks with the scores of the recent trees to the shared folder, so that neither lineage nor work grows with the rounds."""
        old, self.data = self.data, self.data.map(lambda b: Block(b.bins, b.y, b.u, b.gradients(recent)[2])).persist()
        self.data.checkpoint()
        self.data.count()
        old.unpersist()


class Held:
    """The one block of a table of ROWS rows at most, inside its task: the same questions without a job each."""

    def __init__(self, data: list[Block]):
        self.data = data

    def best(self, trees: list, growing: list[Tree], open_: list[list[int]], growth: Growth, round_: int, limit: float, allowed: list) -> list[tuple]:
        sums: dict[tuple, np.ndarray] = {}
        for b in self.data:
            for key, v in _histogram(b, trees, growing, open_, growth, round_, limit):
                sums[key] = sums[key] + v if key in sums else v
        return [_best(item, growth, allowed) for item in sums.items()]

    def sizes(self, trees: list) -> np.ndarray:
        return sum(_sizes(b, trees) for b in self.data)

    def rebase(self, recent: list[list[Tree]]) -> None:
        self.data = [Block(b.bins, b.y, b.u, b.gradients(recent)[2]) for b in self.data]


def _sizes(b: Block, trees: list) -> np.ndarray:
    """How many rows have a gradient of each size, in 1024 steps."""
    return np.bincount(np.minimum((np.abs(b.gradients(trees)[0]).sum(1) * 512).astype(int), 1023), minlength=1024)


class Grower:
    """Grows one tree a class and round on blocks that tasks hold."""

    def __init__(self, data: Spread | Held, classes: int, features: int, growth: Growth, rate: float, seed: int):
        self.data, self.k, self.d, self.growth, self.rate, self.seed = data, classes, features, growth, rate, seed

    def rounds(self, n: int) -> list[list[Tree]]:
        trees, recent = [], []
        for r in range(n):
            trees.append(self.grow(recent, r))
            recent = [*recent, trees[-1]]
            if len(recent) == REBASE and r + 1 < n:
                self.data.rebase(recent)
                recent = []
        return trees

    def found(self, trees: list, growing: list[Tree], open_: list[list[int]], round_: int, limit: float, allowed: list) -> list[list[tuple]]:
        """Best splits of the open nodes of each class's tree, from one aggregate."""
        out: list[list[tuple]] = [[] for _ in growing]
        for k, rows in sorted(self.data.best(trees, growing, open_, self.growth, round_, limit, allowed), key=lambda x: x[1][0][1]):
            # ties go to the first feature
            out[k] = rows if not out[k] else [max(a, b, key=lambda x: x[0]) for a, b in zip(out[k], rows)]
        return out

    def value(self, sums: list[float]) -> float:
        return -self.rate * sums[0] / (sums[1] + self.growth.penalty) if sums[1] + self.growth.penalty > 0 else 0.0

    def grow(self, trees: list, round_: int) -> list[Tree]:
        growth, out = self.growth, [Tree() for _ in range(self.k)]
        limit = self._limit(trees) if growth.top_rate < 1 else 0.0
        allowed = []
        for k in range(self.k):
            most = max(1, round(growth.columns * self.d))
            allowed.append(np.isin(np.arange(self.d), np.random.default_rng((self.seed, round_, k)).permutation(self.d)[:most]))
        look = lambda open_: self.found(trees, out, open_, round_, limit, allowed)
        {"depth": self._by_depth, "leaf": self._by_leaf, "symmetric": self._symmetric}[growth.kind](out, look)
        return out

    def _limit(self, trees: list) -> float:
        """The size of gradient that a share top_rate of the rows reaches, to a 1024th of its range."""
        counts = self.data.sizes(trees)
        above = np.cumsum(counts[::-1])
        return (1023 - int(np.searchsorted(above, self.growth.top_rate * above[-1]))) / 512

    def _split(self, tree: Tree, node: int, best: tuple) -> tuple[int, int]:
        _, feature, bin_, null_left, left, whole = best
        pair = tree.split(node, feature, bin_, null_left)
        for child, sums in zip(pair, (left, [w - x for w, x in zip(whole, left)])):
            tree.value[child] = self.value(sums)
        return pair

    def _by_depth(self, out: list[Tree], look) -> None:
        open_ = [[0] for _ in out]
        for level in range(self.growth.max_depth):
            more: list[list[int]] = [[] for _ in out]
            for k, rows in enumerate(look(open_)):
                for node, best in zip(open_[k], rows):
                    if not level:
                        out[k].value[0] = self.value(best[5])
                    if best[0] > self.growth.least_gain:
                        more[k] += self._split(out[k], node, best)
            open_ = more
            if not any(open_):
                return

    def _by_leaf(self, out: list[Tree], look) -> None:
        """out's trees are split ahead of the queue; what the queue does not choose becomes a leaf again."""
        best: list[dict[int, tuple]] = [{} for _ in out]
        depth = [{0: 0} for _ in out]
        open_ = [[0] for _ in out]
        done = [False] * len(out)
        chosen: list[set[int]] = [set() for _ in out]
        while any(open_):
            for k, rows in enumerate(look(open_)):
                for node, found in zip(open_[k], rows):
                    best[k][node] = found
                    if not node:
                        out[k].value[0] = self.value(found[5])
                    deep = self.growth.max_depth > 0 and depth[k][node] >= self.growth.max_depth
                    if found[0] > self.growth.least_gain and not deep:
                        for child in self._split(out[k], node, found):
                            depth[k][child] = depth[k][node] + 1
            open_ = [[] for _ in out]
            for k, tree in enumerate(out):
                if done[k]:
                    continue
                chosen[k], queue, leaves = set(), [(-best[k][0][0], 0)], 1
                while queue and leaves < self.growth.num_leaves:
                    _, node = heapq.heappop(queue)
                    if tree.feature[node] < 0:
                        continue
                    chosen[k].add(node)
                    leaves += 1
                    pair = (tree.left[node], tree.right[node])
                    if any(c not in best[k] for c in pair):
                        # all leaves that wait are looked at, not these two alone
                        waiting = [c for _, n in queue if tree.feature[n] >= 0 for c in (tree.left[n], tree.right[n])]
                        open_[k] = [c for c in [*pair, *waiting] if c not in best[k]]
                        break
                    for c in pair:
                        heapq.heappush(queue, (-best[k][c][0], c))
                done[k] = not open_[k]
        for tree, kept in zip(out, chosen):
            for node in range(len(tree.feature)):
                if node not in kept:
                    tree.feature[node] = tree.left[node] = tree.right[node] = -1

    def _symmetric(self, out: list[Tree], look) -> None:
        open_ = [[0] for _ in out]
        for level in range(self.growth.max_depth):
            more: list[list[int]] = [[] for _ in out]
            for k, rows in enumerate(look(open_)):
                if open_[k]:
                    gain, feature, bin_, null_left, left, whole = rows[0]
                    if not level:
                        out[k].value[0] = self.value(whole[0])
                    if gain > self.growth.least_gain:
                        for node, a, w in zip(open_[k], left, whole):
                            more[k] += self._split(out[k], node, (gain, feature, bin_, null_left, a, w))
            open_ = more
            if not any(open_):
                return


def grow_all(df: DataFrame, classes: int, growth: Growth, rounds: int, rate: float, seed: int, from_share: bool = True) -> dict:
    """edges, start (scores before the first tree) and trees (by round and class) of a fit on features and label (0 to classes - 1)."""
    counts = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
    n, k = sum(counts.values()), 1 if classes == 2 else classes
    share = [min(max(counts.get(c, 0) / max(n, 1), 1e-6), 1 - 1e-6) for c in range(classes)]
    start = [0.0] * k if not from_share else [float(np.log(share[1] / share[0]))] if k == 1 else np.log(share).tolist()
    edges = bin_edges(df)
    data = blocks(df, edges, start)
    if n <= ROWS:
        grow = lambda own: [Grower(Held(list(own)), k, len(edges), growth, rate, seed).rounds(rounds)]
        trees = data.coalesce(1).mapPartitions(grow).collect()[0]
    else:
        trees = Grower(Spread(data, k * -(-len(edges) // FEATURES)), k, len(edges), growth, rate, seed).rounds(rounds)
    return {"edges": [e.tolist() for e in edges], "start": start, "trees": [[vars(t) for t in row] for row in trees], "classes": classes}


def raw_scores(state: dict, x: np.ndarray) -> np.ndarray:
    bins = binned(x, [np.array(e) for e in state["edges"]])
    out = np.tile(np.array(state["start"], float), (len(x), 1))
    for row in state["trees"]:
        for k, tree in enumerate(row):
            out[:, k] += Tree(**tree).scores(bins)
    return out


def scored(df: DataFrame, state: dict) -> DataFrame:
    """df with rawScores (one a class) and probability of features; the trees go to the tasks with the function (some hundred bytes a tree)."""

    @F.pandas_udf("struct<raw: array<double>, p: array<double>>")
    def score(x: pd.Series) -> pd.DataFrame:
        raw = raw_scores(state, np.stack(x.to_numpy())) if len(x) else np.zeros((0, len(state["start"])))
        raw = np.concatenate([-raw, raw], axis=1) / 2 if raw.shape[1] == 1 else raw
        p = np.exp(raw - raw.max(1, keepdims=True))
        return pd.DataFrame({"raw": list(raw), "p": list(p / p.sum(1, keepdims=True))})

    out = df.withColumn("_scored", score(vector_to_array("features")))
    return out.withColumn("rawScores", F.col("_scored.raw")).withColumn("probability", array_to_vector("_scored.p")).drop("_scored")


def _statistics(total: str, n: str, prior: float):
    return (F.col(total) + PRIOR_WEIGHT * prior) / (F.col(n) + PRIOR_WEIGHT)


def ordered_statistics(df: DataFrame, places: list[int], classes: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """df with categories replaced, each row's from the rows of its category before it; the statistics of all rows (place, category, n, one sum a class); the classes' shares."""
    x, targets = vector_to_array("features"), [1] if classes == 2 else list(range(classes))
    shares = list(df.agg(*[F.avg((F.col("label") == c).cast("double")) for c in targets]).first())
    now = df.withColumn("_x", x).withColumn("_key", F.md5(F.concat_ws("|", F.to_json(F.struct("_x")), F.col("label").cast("string"))))
    found = {}
    for i in places:
        now = now.withColumn("_c", F.get("_x", F.lit(i)))
        now = running_before(now, F.lit(1), "_key", "_c", f"_n{i}")
        for j, c in enumerate(targets):
            now = running_before(now, (F.col("label") == c).cast("long"), "_key", "_c", f"_s{i}_{j}")
        found[i] = [_statistics(f"_s{i}_{j}", f"_n{i}", s) for j, s in enumerate(shares)]
    cells = df.select(F.posexplode(x).alias("place", "category"), "label").where(F.col("place").isin(places))
    table = cells.groupBy("place", "category").agg(F.count("*").alias("n"), *[F.sum((F.col("label") == c).cast("long")).alias(f"s{j}") for j, c in enumerate(targets)])
    return now.withColumn("features", _replaced("_x", places, found)).select(*df.columns), table, [float(s) for s in shares]


def _replaced(x: str, places: list[int], found: dict) -> F.Column:
    """The other features, then each category's statistics."""
    rest = F.filter(x, lambda v, i: ~i.isin(places))
    return array_to_vector(F.concat(rest, F.array(*[s.cast("double") for i in places for s in found[i]])))


def with_statistics(df: DataFrame, table: DataFrame, places: list[int], shares: list[float]) -> DataFrame:
    """df with categories replaced by their statistics over all training rows; an unknown category has the classes' shares."""
    now, found = df.withColumn("_x", vector_to_array("features")), {}
    for i in places:
        own = table.where(F.col("place") == i).select(F.col("category").alias("_c"), F.col("n").alias(f"_n{i}"), *[F.col(f"s{j}").alias(f"_s{i}_{j}") for j in range(len(shares))])
        now = now.join(own, F.get("_x", F.lit(i)).eqNullSafe(F.col("_c")), "left").drop("_c").fillna(0, [f"_n{i}", *[f"_s{i}_{j}" for j in range(len(shares))]])
        found[i] = [_statistics(f"_s{i}_{j}", f"_n{i}", s) for j, s in enumerate(shares)]
    return now.withColumn("features", _replaced("_x", places, found)).select(*df.columns)
