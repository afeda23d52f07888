"""Feed-forward classifier: rectified units, softmax, Adam in synchronous steps.

Rows are dealt to fixed shards by a hash. A step takes the next batch of every shard: tasks add up the gradients of their
batches, the sums meet, and one update of the common weights follows. Where it happens changes no step, so a fit does not
depend on partitions: shards of `HELD` bytes together go through all steps inside one task, since a job
a step mostly waits; the gradients of more shards meet as a tree, in a job a step. Every pass draws the order of a shard's rows anew from
the seed and the pass. Features are scaled to mean 0 and deviation 1 first, which the first layer's weights take in at the
end. A fit ends when the loss has not fallen by TOLERANCE for PATIENCE passes.

Defined cases: a constant feature has no effect; with one class every row gets it; null or NaN features raise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import sgd

#: Rows of a shard's batch; a shard holds SHARD rows on average, fewer where they would take more than SHARD_BYTES.
BATCH, SHARD, SHARD_BYTES = 200, 1 << 14, 1 << 25
#: Bytes of shards that one task holds through all steps.
HELD = 1 << 28
# Decay of both moments, the least divisor of a step, and when a fit ends.
BETA, EPSILON, TOLERANCE, PATIENCE = (0.9, 0.999), 1e-8, 1e-4, 10

Layers = list[tuple[np.ndarray, np.ndarray]]


def begin(sizes: Sequence[int], seed: int) -> Layers:
    """Uniform weights and offsets within the square root of 6 / (inputs + outputs)."""
    rng = np.random.default_rng(seed)
    bound = [math.sqrt(6.0 / (a + b)) for a, b in zip(sizes, sizes[1:])]
    return [(rng.uniform(-k, k, (a, b)), rng.uniform(-k, k, b)) for k, a, b in zip(bound, sizes, sizes[1:])]


def probabilities(x: np.ndarray, layers: Layers) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class probabilities of rows, and what each layer took in."""
    taken = []
    for i, (w, b) in enumerate(layers):
        taken.append(x)
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(x, 0.0)
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True), taken


def gradients(x: np.ndarray, y: np.ndarray, layers: Layers) -> tuple[float, Layers, int]:
    """Sums over rows of the cross-entropy and of its gradients by layer, and the number of rows."""
    p, taken = probabilities(x, layers)
    at = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[at, y], 1e-300)).sum())
    back, out = p, []
    back[at, y] -= 1.0
    for (w, _), own in zip(reversed(layers), reversed(taken)):
        out.append((own.T @ back, back.sum(0)))
        back = (back @ w.T) * (own > 0)  # what the first layer took in is no unit, but nothing lies behind it
    return loss, out[::-1], len(y)


def _order(n: int, seed: int, turn: int) -> np.ndarray:
    return np.random.default_rng([seed, turn]).permutation(n)


def batch(x: np.ndarray, y: np.ndarray, seed: int, turn: int, step: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's rows of one step: the step-th part of its order in this pass. Every row has one step."""
    rows = _order(len(x), seed, turn)[len(x) * step // steps : len(x) * (step + 1) // steps]
    return x[rows], y[rows]


def _held(shards: list[tuple[np.ndarray, np.ndarray]], seed: int, steps: int) -> Callable[[Layers, int, int], tuple]:
    """Gradients of the batches of all shards here; each pass makes their orders once."""
    now: dict[int, list] = {}

    def sums(layers: Layers, turn: int, step: int) -> tuple[float, Layers, int]:
        if turn not in now:
            now.clear()
            now[turn] = [_order(len(x), seed, turn) for x, _ in shards]
        rows = [o[len(o) * step // steps : len(o) * (step + 1) // steps] for o in now[turn]]
        return gradients(*(np.concatenate([own[i][r] for own, r in zip(shards, rows)]) for i in (0, 1)), layers)

    return sums


def descend(layers: Layers, gradient: Callable[[Layers, int, int], tuple], steps: int, alpha: float, rate: float, max_iter: int) -> Layers:
    """Weights after at most max_iter passes of Adam, each of the given steps; gradient gives the sums of a pass's step."""
    first, second = ([(np.zeros_like(w), np.zeros_like(b)) for w, b in layers] for _ in range(2))
    t, best, waited = 0, math.inf, 0
    for turn in range(max_iter):
        total, seen = 0.0, 0
        for step in range(steps):
            loss, grads, n = gradient(layers, turn, step)
            if not n:
                continue
            t, total, seen = t + 1, total + loss, seen + n
            pace = rate * math.sqrt(1 - BETA[1] ** t) / (1 - BETA[0] ** t)
            moved = []
            for i, ((w, b), (gw, gb)) in enumerate(zip(layers, grads)):
                mean = ((gw + alpha * w) / n, gb / n)
                first[i] = tuple(BETA[0] * m + (1 - BETA[0]) * g for m, g in zip(first[i], mean))
                second[i] = tuple(BETA[1] * v + (1 - BETA[1]) * g * g for v, g in zip(second[i], mean))
                moved.append(tuple(z - pace * m / (np.sqrt(v) + EPSILON) for z, m, v in zip((w, b), first[i], second[i])))
            layers = moved
        loss = total / max(seen, 1)
        waited = 0 if loss < best - TOLERANCE else waited + 1
        best = min(best, loss)
        if waited >= PATIENCE:
            break
    return layers


def _add(p: tuple, q: tuple) -> tuple:
    return p[0] + q[0], [(a + c, b + d) for (a, b), (c, d) in zip(p[1], q[1])], p[2] + q[2]


def fit(df: DataFrame, classes: int, hidden: Sequence[int], alpha: float, rate: float, max_iter: int, seed: int) -> list[list]:
    """Weights (input, unit) and offsets of each layer, for features as they are."""
    if df.where(F.exists(vector_to_array("features"), lambda v: v.isNull() | F.isnan(v))).limit(1).count():
        raise ValueError("a feature is null or NaN: fill it before a network is fitted")
    d = len(df.first()["features"])
    size = max(BATCH, min(SHARD, SHARD_BYTES // (8 * d)))
    data = sgd.shards(df, d, size).rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["y"], np.int64)))
    add = lambda p, q: tuple(a + b for a, b in zip(p, q))
    n, total, shards = data.map(lambda own: (len(own[0]), own[0].sum(0), 1)).treeReduce(add)
    centre = total / n
    width = np.sqrt(data.map(lambda own: ((own[0] - centre) ** 2).sum(0)).treeReduce(np.add) / n)
    width[width == 0] = 1.0
    layers, steps = begin([d, *hidden, classes], seed), -(-min(n, size) // BATCH)
    scaled = data.map(lambda own: ((own[0] - centre) / width, own[1]))
    if shards == 1 or 8 * n * (d + 1) <= HELD:
        layers = scaled.coalesce(1).mapPartitions(lambda own: [descend(layers, _held(list(own), seed, steps), steps, alpha, rate, max_iter)]).first()
    else:
        scaled = scaled.persist()
        sums = lambda now, turn, step: scaled.map(lambda own: gradients(*batch(*own, seed, turn, step, steps), now)).treeReduce(_add)
        layers = descend(layers, sums, steps, alpha, rate, max_iter)
        scaled.unpersist()
    (w, b), *rest = layers
    w = w / width[:, None]
    return [[w.tolist(), (b - centre @ w).tolist()], *[[v.tolist(), c.tolist()] for v, c in rest]]


def scored(df: DataFrame, layers: Sequence[Sequence]) -> DataFrame:
    """df with probability and prediction (the first most probable class); rows that hold NaN have NaN and class 0."""
    held = [(np.array(w), np.array(b)) for w, b in layers]

    @F.pandas_udf("array<double>")
    def classes(x: pd.Series) -> pd.Series:
        return pd.Series(list(probabilities(np.stack(x.to_numpy()), held)[0]) if len(x) else [], dtype=object)

    out = df.withColumn("_p", classes(vector_to_array("features"))).withColumn("probability", array_to_vector("_p"))
    return out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p")
