"""Tuning: grid search with cross-validation, seeded random search on a validation part, and successive halving. Trials run at
once from driver threads. The test table is never seen, and the metric's direction is honoured."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import evaluate, models
from tabforge.sources.tables import checkpointed

_FOREST = {"n_estimators": [50, 100, 200], "max_depth": [10, 20, 30], "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"], "criterion": ["gini", "entropy"]}
_BOOSTING = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "subsample": [0.8, 0.9, 1.0]}
# Search spaces. They depart in that no bound of a tree's depth is 30, Spark's largest, and in that knobs without a twin are left out.
SPACES: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "l1": [0.0, 0.5, 1.0], "max_iter": [100, 200, 500]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "sgd": {"alpha": [0.0001, 0.001, 0.01]},
    "decision_tree": {"max_depth": [10, 20, 30], "min_samples_leaf": [1, 2, 4], "criterion": ["gini", "entropy"]},
    "random_forest": _FOREST,
    "extra_trees": _FOREST,
    "gradient_boosting": _BOOSTING | {"min_samples_leaf": [1, 2, 4]},
    "adaboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]},
    "knn": {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"], "p": [1, 2]},
    "svc": {"kernel": ["linear", "rbf"], "C": [0.1, 1, 10], "gamma": ["scale", "auto"]},
    "mlp": {"hidden": [[50], [100], [50, 50], [100, 50]]},
    "gaussian_nb": {"smoothing": [1e-9, 1e-8, 1e-7, 1e-6]},
    "multinomial_nb": {"alpha": [0.1, 0.5, 1.0, 2.0]},
    "bernoulli_nb": {"alpha": [0.1, 0.5, 1.0, 2.0], "threshold": [0.0, 0.1, 0.5]},
    "lda": {},
    "qda": {"reg_param": [0.0, 0.01, 0.1]},
    "xgboost": _BOOSTING,
    "lightgbm": _BOOSTING,
    "catboost": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [4, 6, 8]},
}
#: Metrics, and whether more is better. roc_auc: binary, or each class against the rest by support.
METRICS = {"accuracy": True, "f1": True, "weightedPrecision": True, "weightedRecall": True, "roc_auc": True, "logLoss": False}


def folds(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """df with fold, by a hash within each label, so that it can be repeated."""
    return df.withColumn("fold", F.pmod(F.xxhash64("label", key), F.lit(n)).cast("int"))


def value(scored: DataFrame, metric: str) -> float:
    """The metric of a model's output. Log loss asks for probabilities; ROC-AUC takes what the model ranks by."""
    if metric == "logLoss" and "probability" not in scored.columns:
        raise ValueError("log loss asks for a model with probabilities")
    if metric != "roc_auc":
        return MulticlassClassificationEvaluator(metricName=metric).evaluate(scored)
    column = next((c for c in ("probability", "rawPrediction", "rawScores") if c in scored.columns), None)
    if column is None:
        raise ValueError("ROC-AUC asks for a model with scores")
    points = scored.select("label", (F.col(column) if column == "rawScores" else vector_to_array(column)).alias("s"))
    n = points.agg(F.max(F.size("s"))).first()[0] or 0
    rows = points.select("label", *[F.get("s", F.lit(c)).alias(f"s{c}") for c in range(n)])
    if n == 2:
        return evaluate.roc_auc(rows, "label", "s1").first()["value"]
    return next(r["value"] for r in evaluate.auc_ovr(rows, "label", {float(c): f"s{c}" for c in range(n)}).collect() if r["metric"] == "roc_auc_ovr_weighted")


def _together(tasks: list[Callable], parallelism: int) -> list:
    """Results of the tasks in order, `parallelism` at a time from driver threads. Each has a pool of its own, so that under spark.scheduler.mode FAIR a long trial does not hold the others up."""
    def run(i: int):
        context = SparkSession.active().sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"trial-{i % parallelism}")
        try:
            return tasks[i]()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    if parallelism < 2 or len(tasks) < 2:
        return [f() for f in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(inheritable_thread_target(run), range(len(tasks)))


def _trial(fit_on: DataFrame, judge_on: DataFrame, name: str, p: dict, metric: str) -> Callable:
    return lambda: value(models.fit(fit_on, name, p).transform(judge_on), metric)


def _points(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, v)) for v in itertools.product(*space.values())]


def grid_search(df: DataFrame, name: str, space: dict[str, list] | None = None, metric: str = "accuracy", cv: int = 5, key: str = "id", parallelism: int = 4):
    """trials (parameters, value, best) and the model refitted with the best ones: all points by all folds, `parallelism` fits at a time, whatever the learner."""
    points = _points(SPACES[name] if space is None else space)
    train = checkpointed(folds(df, cv, key))
    tasks = [_trial(train.where(F.col("fold") != f), train.where(F.col("fold") == f), name, p, metric) for p in points for f in range(cv)]
    found, values = _together(tasks, parallelism), []
    for i, p in enumerate(points):
        parts = [v for v in found[i * cv : (i + 1) * cv] if v is not None]  # ROC-AUC has no value in a fold of one class
        if not parts:
            raise ValueError(f"{metric} has no value in any fold")
        values.append((p, sum(parts) / len(parts)))
    return _finish(df, name, values, METRICS[metric])


def random_search(df: DataFrame, name: str, ranges: dict[str, tuple], n_trials: int = 10, metric: str = "accuracy", seed: int = 42, key: str = "id", parallelism: int = 4):
    """Trials drawn from ranges: (low, high) of integers or floats, on a logarithmic scale where high / low > 100, or a list of choices; judged on a fifth of df, `parallelism` at a time. Without ranges there is one trial, that of the defaults."""
    draw = random.Random(seed)

    def one(v):
        if isinstance(v, list):
            return draw.choice(v)
        low, high = v
        if isinstance(low, int) and isinstance(high, int):
            return draw.randint(low, high)
        return math.exp(draw.uniform(math.log(low), math.log(high))) if low > 0 and high / low > 100 else draw.uniform(low, high)

    train = checkpointed(folds(df, 5, key))
    points = [{k: one(v) for k, v in ranges.items()} for _ in range(n_trials if ranges else 1)]
    found = _together([_trial(train.where("fold <> 0"), train.where("fold = 0"), name, p, metric) for p in points], parallelism)
    return _finish(df, name, list(zip(points, found)), METRICS[metric])


def halving_search(df: DataFrame, name: str, space: dict[str, list] | None = None, metric: str = "accuracy", factor: int = 3, least_rows: int = 100, key: str = "id", parallelism: int = 4):
    """Successive halving: all points on a small share of the training rows, then the best 1 / factor of them on a share factor times as large, until all rows are in.

    The first share has `least_rows` rows at least. Every round is judged on the same fifth of df. trials has each point with
    its value in the last round it was in; the best one was judged on all rows.
    """
    points, up = _points(SPACES[name] if space is None else space), METRICS[metric]
    train = checkpointed(folds(df, 5, key).withColumn("_u", F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 20)) / float(1 << 20)))
    rounds, n = max(0, math.ceil(math.log(max(len(points), 1), factor))), train.count()
    while rounds and n * factor**-rounds < least_rows:
        rounds -= 1
    left, last = list(range(len(points))), {}
    for r in range(rounds, -1, -1):
        part = train.where((F.col("fold") != 0) & (F.col("_u") < float(factor) ** -r))
        found = _together([_trial(part, train.where("fold = 0"), name, points[i], metric) for i in left], parallelism)
        last |= dict(zip(left, found))
        ranked = sorted(left, key=lambda i: (-last[i] if up else last[i], i))
        left = ranked[: max(1, len(ranked) // factor)] if r else ranked
    return _finish(df, name, [(points[i], last[i]) for i in [left[0], *(i for i in range(len(points)) if i != left[0])]], up, 0)


def _finish(df: DataFrame, name: str, values: list, up: bool, best: int | None = None):
    best = best if best is not None else (max if up else min)(range(len(values)), key=lambda i: values[i][1])
    rows = [(str(sorted(p.items())), float(v), i == best) for i, (p, v) in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "params string, value double, best boolean"), models.fit(df, name, values[best][0])


def run(df: DataFrame, name: str, test: DataFrame | None = None, method: str = "grid", metric: str = "accuracy", space: dict | None = None, n_trials: int = 10, optimize: bool = True, key: str = "id"):
    """The stage: trials, the refitted model and, with a test table, its value there; with optimize off the default model is fitted."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if not optimize:
        trials, model = df.sparkSession.createDataFrame([], "params string, value double, best boolean"), models.fit(df, name)
    elif method == "grid":
        trials, model = grid_search(df, name, space, metric, key=key)
    elif method == "halving":
        trials, model = halving_search(df, name, space, metric, key=key)
    elif method == "random":
        trials, model = random_search(df, name, space or SPACES[name], n_trials, metric, key=key)
    else:
        raise ValueError(f"unknown method {method}")
    return trials, model, None if test is None else value(model.transform(test), metric)
