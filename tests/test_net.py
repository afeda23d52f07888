"""The network against finite differences and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import models, net, sgd


def rows(spark, n=500, classes=3, parts=3):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 2)) * [1.0, 300.0] + [0.0, 5000.0]
    y = (np.hypot(x[:, 0], (x[:, 1] - 5000) / 300) > 1.1).astype(int) + (classes > 2) * (x[:, 0] > 1.2)
    df = spark.createDataFrame([(i, *map(float, a), 7.0, int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    return models.assembled(df.repartition(parts), ["a", "b", "c"], "y", ["id"])


def test_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    x, y, layers = rng.normal(size=(9, 4)), rng.integers(0, 3, 9), net.begin([4, 5, 6, 3], 2)
    loss, grads, n = net.gradients(x, y, layers)
    assert n == 9 and loss == pytest.approx(-sum(math.log(net.probabilities(x, layers)[0][i, c]) for i, c in enumerate(y)))
    for (w, b), (gw, gb) in zip(layers, grads):
        for values, slopes in ((w, gw), (b, gb)):
            for at in np.ndindex(values.shape):
                kept, sides = values[at], []
                for step in (1e-6, -1e-6):
                    values[at] = kept + step
                    sides.append(net.gradients(x, y, layers)[0])
                values[at] = kept
                assert slopes[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)


def test_every_row_is_met_once_a_pass():
    x = np.arange(41.0)[:, None]
    for turn in (0, 1):
        met = np.concatenate([net.batch(x, np.arange(41), 5, turn, s, 4)[1] for s in range(4)])
        assert sorted(met) == list(range(41)) and list(met) != list(range(41))


def by_loop(shards, d, classes, hidden, seed, size, alpha, rate, passes):
    """Adam on flat numbers, written apart."""
    whole = np.concatenate([x for x, _ in shards])
    centre, width = whole.mean(0), whole.std(0)
    width[width == 0] = 1
    shards = [((x - centre) / width, y) for x, y in shards]
    flat = [v.copy() for layer in net.begin([d, *hidden, classes], seed) for v in layer]
    m, v, t = [np.zeros_like(z) for z in flat], [np.zeros_like(z) for z in flat], 0
    steps = math.ceil(min(len(whole), size) / net.BATCH)
    for turn in range(passes):
        for step in range(steps):
            parts = [net.batch(x, y, seed, turn, step, steps) for x, y in shards]
            x, y = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            grads = [g for layer in net.gradients(x, y, list(zip(flat[::2], flat[1::2])))[1] for g in layer]
            t += 1
            for i, g in enumerate(grads):
                g = (g + (alpha * flat[i] if i % 2 == 0 else 0)) / len(x)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                flat[i] = flat[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8 / math.sqrt(1 - 0.999**t))
    return [(w, b - (centre / width) @ w if i == 0 else b) for i, (w, b) in enumerate(zip(flat[::2], flat[1::2]))], width


@pytest.mark.parametrize("size", [1 << 14, 250])
def test_fit_equals_a_loop(spark, monkeypatch, size):
    """A table of one shard, and one of several whose gradients meet."""
    monkeypatch.setattr(net, "SHARD", size)
    df = rows(spark).cache()
    shards = [(np.frombuffer(r["x"]).reshape(-1, 3), np.frombuffer(r["y"], np.int64)) for r in sgd.shards(df, 3, size).collect()]
    assert (len(shards) == 1) == (size > 500)
    want, width = by_loop(shards, 3, 3, [6, 4], 9, size, 0.5, 0.01, 8)
    got = net.fit(df, 3, [6, 4], 0.5, 0.01, 8, 9)
    assert np.array(got[0][0]) * width[:, None] == pytest.approx(want[0][0], abs=1e-7)
    for (w, b), (w2, b2) in zip(got, want):
        assert np.array(b) == pytest.approx(b2, abs=1e-6) and np.shape(w) == w2.shape


@pytest.mark.parametrize("held", [1 << 28, 1])
def test_steps_need_no_job_each(spark, monkeypatch, held):
    """Shards that one task holds, and more than that: the same weights; only the second way takes a job a step."""
    monkeypatch.setattr(net, "SHARD", 250)
    monkeypatch.setattr(net, "HELD", held)
    df = rows(spark).cache()
    shards = [(np.frombuffer(r["x"]).reshape(-1, 3), np.frombuffer(r["y"], np.int64)) for r in sgd.shards(df, 3, 250).collect()]
    want, width = by_loop(shards, 3, 3, [6, 4], 9, 250, 0.5, 0.01, 8)
    spark.sparkContext.setJobGroup(f"net-{held}", "")
    got = net.fit(df, 3, [6, 4], 0.5, 0.01, 8, 9)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"net-{held}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(shards) > 1 and (jobs >= 16 if held == 1 else jobs < 16)
    assert np.array(got[0][0]) * width[:, None] == pytest.approx(want[0][0], abs=1e-7)
    assert all(np.array(b) == pytest.approx(b2, abs=1e-6) for (_, b), (_, b2) in zip(got, want))


@pytest.mark.parametrize("classes", [2, 3])
def test_network_parts_rings_whatever_the_partitions(spark, classes):
    """Unscaled features, one of them constant; the fit is the same from 1, 3 and 8 partitions."""
    found = []
    for parts in (1, 3, 8):
        df = rows(spark, classes=classes, parts=parts).cache()
        out = models.score(models.fit(df, "mlp", {"hidden": [32], "learning_rate": 0.01}), df, ["id"])
        found.append(sorted((r["id"], r["prediction"], round(max(r["probability"]), 9)) for r in out.collect()))
        assert out.where("prediction = label").count() > 480
    assert found[0] == found[1] == found[2]


def test_missing_values_and_single_classes(spark):
    df = rows(spark, 30)
    gap = models.assembled(spark.createDataFrame([(1.0, 0), (None, 1)], "a double, y int"), ["a"], "y")
    with pytest.raises(ValueError, match="null or NaN"):
        models.fit(gap, "mlp")
    one = models.fit(df.withColumn("label", F.lit(0.0)), "mlp", {"max_iter": 2})
    assert models.score(one, df).where("prediction = 0").count() == 30
