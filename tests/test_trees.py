"""Boosted trees, extra trees and attributions against loops."""

import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabforge.operators import attribution, boost, extra, models


def _rows(spark, n=400, d=5, classes=2, seed=3, gaps=0.05):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[:, d - 1] = rng.integers(0, 4, n)
    score = x[:, 0] - x[:, 1] * x[:, 2] + (x[:, d - 1] == 2)
    y = (score > 0.2).astype(int) if classes == 2 else np.digitize(score, [-0.5, 0.8])
    x[rng.random((n, d)) < gaps] = np.nan
    names = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, " + ", ".join(f"{c} double" for c in names) + ", y int")
    return models.assembled(df.repartition(3), names, "y", ["id"]), x, y


class Loop:
    """One tree a round by plain loops over all splits; sums of rows, not of bins."""

    def __init__(self, growth, rate, edges):
        self.g, self.rate, self.edges = growth, rate, edges

    def quality(self, s):
        return s[0] * s[0] / (s[1] + self.g.penalty) if s[1] + self.g.penalty > 0 else 0.0

    def sums(self, rows):
        return [sum(self.w[i] * v[i] for i in rows) for v in (self.grad, self.hess)] + [sum(self.w[i] for i in rows)]

    def parts(self, rows, f, b, side):
        left = [i for i in rows if (side if self.bins[i, f] == 255 else self.bins[i, f] <= b)]
        gone = set(left)
        return left, [i for i in rows if i not in gone]

    def ok(self, s):
        return s[1] >= self.g.least_hessian and s[2] >= self.g.least_rows

    def best(self, rows, allowed):
        out = (-math.inf, None)
        whole = self.quality(self.sums(rows))
        for f in allowed:
            for b in range(len(self.edges[f]) + 1):
                for side in (False, True):
                    a, c = (self.sums(p) for p in self.parts(rows, f, b, side))
                    if self.ok(a) and self.ok(c):
                        gain = (self.quality(a) + self.quality(c) - whole) / 2
                        if gain > out[0] + 1e-9:
                            out = (gain, (f, b, side))
        return out

    def value(self, rows):
        s = self.sums(rows)
        return -self.rate * s[0] / (s[1] + self.g.penalty) if s[1] + self.g.penalty > 0 else 0.0

    def tree(self, allowed):
        """Rows of each leaf."""
        everything = list(range(len(self.bins)))
        if self.g.kind == "depth":
            open_, leaves = [everything], []
            for _ in range(self.g.max_depth):
                more = []
                for rows in open_:
                    gain, at = self.best(rows, allowed)
                    (more.extend(self.parts(rows, *at)) if gain > self.g.least_gain else leaves.append(rows))
                open_ = more
            return leaves + open_
        if self.g.kind == "leaf":
            queue, leaves, n = [(-self.best(everything, allowed)[0], 0, everything)], [], 1
            while queue and len(queue) + len(leaves) < self.g.num_leaves:
                gain, _, rows = heapq.heappop(queue)
                if -gain <= self.g.least_gain:
                    leaves.append(rows)
                    continue
                for part in self.parts(rows, *self.best(rows, allowed)[1]):
                    n += 1
                    heapq.heappush(queue, (-self.best(part, allowed)[0], n, part))
            return leaves + [q[2] for q in queue]
        leaves = [everything]
        for _ in range(self.g.max_depth):
            found = (-math.inf, None)
            for f in allowed:
                for b in range(len(self.edges[f]) + 1):
                    gain = 0.0
                    for rows in leaves:
                        a, c = (self.sums(p) for p in self.parts(rows, f, b, True))
                        gain += (self.quality(a) + self.quality(c) - self.quality(self.sums(rows))) / 2
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, b))
            if found[0] <= self.g.least_gain:
                break
            leaves = [p for rows in leaves for p in self.parts(rows, *found[1], True)]
        return leaves


@pytest.mark.parametrize("growth", [
    boost.Growth("depth", 2, least_hessian=0.5), boost.Growth("leaf", 0, 6, penalty=0.5, least_hessian=0.1, least_rows=4), boost.Growth("symmetric", 2, penalty=3.0, least_hessian=0.0, least_rows=0),
], ids=lambda g: g.kind)
@pytest.mark.parametrize("classes, held", [(2, 1 << 14), (3, 16)])
def test_boosted_trees_by_loops(spark, monkeypatch, growth, classes, held):
    """In one task and over the cluster."""
    monkeypatch.setattr(boost, "REBASE", 1)
    monkeypatch.setattr(boost, "ROWS", held)
    df, x, y = _rows(spark, 60, 3, classes)
    got = boost.grow_all(df, classes, growth, 2, 0.3, 7)
    loop = Loop(growth, 0.3, got["edges"])
    loop.bins = boost.binned(x, [np.array(e) for e in got["edges"]]).astype(int)
    k = 1 if classes == 2 else classes
    raw = np.tile(got["start"], (len(y), 1))
    loop.w = np.ones(len(y))
    for _ in range(2):
        p = 1 / (1 + np.exp(-raw)) if k == 1 else np.exp(raw) / np.exp(raw).sum(1, keepdims=True)
        new = raw.copy()
        for c in range(k):
            loop.grad, loop.hess = p[:, c] - (y == (1 if k == 1 else c)), p[:, c] * (1 - p[:, c])
            for rows in loop.tree(range(3)):
                new[rows, c] += loop.value(rows)
        raw = new
    assert np.allclose(boost.raw_scores(got, x), raw, atol=1e-9)


def test_leaf_wise_trees_have_leaves_of_unequal_depth(spark):
    df, x, _ = _rows(spark, 400)
    state = boost.grow_all(df, 2, boost.Growth("leaf", 0, 31, penalty=0.0, least_hessian=1e-3, least_rows=3), 1, 0.1, 7)
    tree = boost.Tree(**state["trees"][0][0])
    depth = {0: 0}
    for n in range(len(tree.feature)):
        if n in depth and tree.feature[n] >= 0:
            depth[tree.left[n]] = depth[tree.right[n]] = depth[n] + 1
    leaves = [n for n in depth if tree.feature[n] < 0]
    assert len(leaves) == 31 and len({depth[n] for n in leaves}) > 3
    assert set(tree.leaves(boost.binned(x, [np.array(e) for e in state["edges"]])).tolist()) == set(leaves)


def test_symmetric_trees_have_one_split_a_level(spark):
    df, _, _ = _rows(spark, 200)
    tree = boost.Tree(**boost.grow_all(df, 2, boost.Growth("symmetric", 3, penalty=3.0, least_hessian=0.0, least_rows=0), 1, 0.1, 7)["trees"][0][0])
    level, seen = [0], 0
    while tree.feature[level[0]] >= 0:
        assert len({(tree.feature[n], tree.bin[n]) for n in level}) == 1
        level, seen = [c for n in level for c in (tree.left[n], tree.right[n])], seen + 1
    assert seen == 3


def test_rows_of_large_gradients_count_once_and_others_for_all(spark):
    df, _, _ = _rows(spark, 500)
    growth = boost.Growth("leaf", 0, 4, top_rate=0.2, other_rate=0.2)
    edges = boost.bin_edges(df)
    data = boost.blocks(df, edges, [0.0])
    state = boost.grow_all(df, 2, growth, 2, 0.3, 1)
    trees = [[boost.Tree(**t) for t in row] for row in state["trees"][:1]]
    limit = boost.Grower(boost.Spread(data, 1), 1, len(edges), growth, 0.3, 1)._limit(trees)
    found = data.map(lambda b: (np.abs(b.gradients(trees)[0]).sum(1), b.weights(b.gradients(trees)[0], growth, 1, limit))).collect()
    size, weight = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    assert 0.15 < (size >= limit).mean() < 0.3 and (weight[size >= limit] == 1).all()
    assert set(np.unique(weight[size < limit])) == {0.0, 4.0} and abs(weight.sum() / 500 - 1) < 0.2


def test_fits_do_not_depend_on_partitions(spark, monkeypatch):
    df, x, _ = _rows(spark, 300)
    growth = boost.Growth("depth", 3, subsample=0.7, columns=0.6)
    a, b = (boost.raw_scores(boost.grow_all(df.repartition(n), 2, growth, 4, 0.3, 5), x) for n in (1, 7))
    monkeypatch.setattr(boost, "ROWS", 64)
    c = boost.raw_scores(boost.grow_all(df.repartition(5), 2, growth, 4, 0.3, 5), x)
    assert np.allclose(a, b) and np.allclose(a, c)


def test_category_statistics_leave_out_the_own_label(spark):
    """Each row's statistic is that of the rows before it in the order by hash; all training rows in scoring; categories of one row say nothing."""
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(4)), float(i), rng.randrange(2)) for i in range(80)]
    df = models.assembled(spark.createDataFrame(rows, "id long, c double, u double, y int").repartition(3), ["c", "u"], "y", ["id"])
    made, table, shares = boost.ordered_statistics(df, [0, 1], 2)
    got = {r["id"]: list(r["features"]) for r in made.collect()}
    prior = sum(r[3] for r in rows) / 80
    keys = {r["id"]: r["k"] for r in df.select("id", F.md5(F.concat_ws("|", F.to_json(F.struct(vector_to_array("features").alias("_x"))), F.col("label").cast("string"))).alias("k")).collect()}
    for i, c, _, _ in rows:
        before = [r[3] for r in rows if r[1] == c and keys[r[0]] < keys[i]]
        assert got[i][0] == pytest.approx((sum(before) + prior) / (len(before) + 1)) and got[i][1] == pytest.approx(prior)
    whole = {r["id"]: list(r["features"]) for r in boost.with_statistics(df, table, [0, 1], shares).collect()}
    for i, c, _, _ in rows:
        own = [r[3] for r in rows if r[1] == c]
        assert whole[i][0] == pytest.approx((sum(own) + prior) / (len(own) + 1))


def brute_extra(x, y, classes, tree, depth, most, seed, path=1):
    """(rows' places) to the class shares of their leaf, by recursion with the same draws."""
    share = np.bincount(y, minlength=classes) / len(y)
    if depth == 0 or len(set(y.tolist())) < 2:
        return [(i, share) for i in range(len(y))]
    low, high = np.nanmin(np.where(np.isnan(x), np.inf, x), 0), np.nanmax(np.where(np.isnan(x), -np.inf, x), 0)
    gini = lambda v: len(v) * (1 - sum((np.bincount(v, minlength=classes) / max(len(v), 1)) ** 2))
    best = None
    for f, threshold in extra.draw(seed, tree, path, low, high, most):
        left = x[:, f] <= threshold
        if left.any() and not left.all():
            cost = round(gini(y[left]) + gini(y[~left]), 9)
            if best is None or cost < best[0]:
                best = (cost, left)
    if best is None:
        return [(i, share) for i in range(len(y))]
    out = []
    for side, own in ((0, best[1]), (1, ~best[1])):
        at = np.flatnonzero(own)
        out += [(int(at[i]), s) for i, s in brute_extra(x[own], y[own], classes, tree, depth - 1, most, seed, 2 * path + side)]
    return out


@pytest.mark.parametrize("classes, held", [(2, 1 << 14), (3, 32)])
def test_extra_trees_by_recursion(spark, monkeypatch, classes, held):
    monkeypatch.setattr(extra, "ROWS", held)
    df, x, y = _rows(spark, 120, 5, classes)
    trees = extra.fit(df, classes, 4, 4, seed=5)
    want = np.zeros((len(y), classes))
    for t in range(4):
        for i, share in brute_extra(x, y, classes, t, 4, 2, 5):
            want[i] += share / 4
    assert np.allclose(extra.shares(trees, x), want)
    other = extra.fit(df, classes, 4, 4, seed=6)
    assert [t["threshold"] for t in other] != [t["threshold"] for t in trees]


@pytest.mark.parametrize("name", ["xgboost", "lightgbm", "catboost", "extra_trees"])
def test_boosted_models_are_saved_and_scored(spark, tmp_path, name):
    df, _, y = _rows(spark, 300, classes=3 if name == "xgboost" else 2)
    params = {"n_estimators": 12} | ({"categorical": [4]} if name == "catboost" else {})
    model = models.fit(df, name, params)
    again = models.load(spark, models.save(model, spark, str(tmp_path / name)))
    a, b = ({r["id"]: (r["prediction"], list(r["probability"])) for r in models.score(m, df, ["id"]).collect()} for m in (model, again))
    assert a == b and len(a) == 300 and all(abs(sum(p) - 1) < 1e-9 for _, p in a.values())
    assert np.mean([a[i][0] == y[i] for i in a]) > 0.8


def brute_attributions(trees, x):
    """By class and feature, from all subsets of the features: a split on a feature outside the subset is passed by the training rows' shares."""
    def value(tree, node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.share[node]
        a, b = tree.left[node], tree.right[node]
        if f in known:
            return value(tree, a if x[f] <= tree.threshold[node] else b, known)
        return (tree.cover[a] * value(tree, a, known) + tree.cover[b] * value(tree, b, known)) / tree.cover[node]

    d, out = len(x), 0.0
    for tree in trees:
        own = np.zeros((d, tree.share.shape[1]))
        for j in range(d):
            rest = [k for k in range(d) if k != j]
            for size in range(d):
                for subset in itertools.combinations(rest, size):
                    w = math.factorial(size) * math.factorial(d - 1 - size) / math.factorial(d)
                    own[j] += w * (value(tree, 0, {*subset, j}) - value(tree, 0, set(subset)))
        out = out + own / len(trees)
    return out.T


@pytest.mark.parametrize("classes", [2, 3])
def test_attributions_by_all_subsets(spark, classes):
    df, x, _ = _rows(spark, 200, 4, classes, gaps=0.0)
    model = models.fit(df, "random_forest", {"n_estimators": 5, "max_depth": 6})
    trees = attribution.of_forest(model, spark)
    got = {r["id"]: np.array(r["attributions"]) for r in attribution.attributed(df, model, ["id"]).collect()}
    for i in range(0, 200, 17):
        assert np.allclose(got[i], brute_attributions(trees, x[i]), atol=1e-9)
    mean = sum(t.mean() for t in trees) / 5
    scores = {r["id"]: list(r["p"]) for r in model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    assert all(np.allclose(got[i].sum(1) + mean, scores[i]) for i in got)
    ranked = attribution.importance(df, ["a", "b", "c", "d"], model).collect()
    size = np.mean([np.abs(a).mean(0) for a in got.values()], axis=0)
    assert [r["feature"] for r in ranked] == ["abcd"[i] for i in np.argsort(-size)] and [r["rank"] for r in ranked] == [1, 2, 3, 4]
    assert [r["importance"] for r in ranked] == pytest.approx(sorted(size, reverse=True))
