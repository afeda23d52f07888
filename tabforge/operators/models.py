"""Classifiers behind one entry: fit(df, name, params) on a table with features (vector) and label (double from 0).

Boosted trees of three kinds are grown in `boost`, extra trees in `extra`; `net` trains the network. Other learners that Spark lacks are composed: ridge from least squares per class, AdaBoost from weighted stumps, the radial kernel
from whitened landmark features with calibrated margins, descent on the hinge loss in shards, naive Bayes and discriminants from one aggregate, nearest neighbours from
the block search. Binary learners are wrapped in one-vs-rest where there are more classes. Every fitted model can be saved
and loaded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model, Transformer
from pyspark.ml import classification as M
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.operators import bayes, boost, extra, knn, net, sgd
from tabforge.sources.tables import checkpointed, read_json, write_json

SEED = 42
# Default parameters by model. landmarks is this library's own.
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000},
    "ridge": {"alpha": 1.0},
    "sgd": {"alpha": 1e-4, "max_iter": 100},
    "decision_tree": {"max_depth": 10},
    "random_forest": {"n_estimators": 100, "max_depth": 10},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "adaboost": {"n_estimators": 50, "learning_rate": 1.0},
    "extra_trees": {"n_estimators": 100, "max_depth": 10},
    "svc": {"C": 1.0, "landmarks": 100},
    "mlp": {"hidden": 100, "alpha": 1e-4, "learning_rate": 1e-3, "max_iter": 200},
    "xgboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 0.8, "colsample_bytree": 0.8},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 0, "num_leaves": 31, "colsample_bytree": 0.8},
    "catboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "l2_leaf_reg": 3.0},
    "knn": {"k": 5, "weights": "uniform", "p": 2},
    "gaussian_nb": {"smoothing": 1e-9},
    "multinomial_nb": {"alpha": 1.0},
    "bernoulli_nb": {"alpha": 1.0, "threshold": 0.0},
    "lda": {},
    "qda": {"reg_param": 0.0},
}
GENERATIVE = {"gaussian_nb": "gaussian", "multinomial_nb": "multinomial", "bernoulli_nb": "bernoulli", "lda": "lda", "qda": "qda"}


def assembled(df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """keep, features and label (numbers, from 0)."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df).select(*keep, "features", F.col(label).cast("double").alias("label"))


class Rule(Transformer):
    """A fitted composed model: its kind, plain values, fitted Spark models and tables."""

    def __init__(self, kind: str, state: dict, models: Sequence[Model] = (), tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.kind, self.state, self.models, self.tables = kind, state, list(models), tables or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        return _APPLY[self.kind](df, self)


def _dot(weights) -> Column:
    x = vector_to_array("features")
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _argmax(df: DataFrame, scores: Sequence) -> DataFrame:
    """rawScores (array) and prediction (the first largest)."""
    df = df.withColumn("rawScores", F.array(*scores))
    return df.withColumn("prediction", (F.array_position("rawScores", F.array_max("rawScores")) - 1).cast("double"))


def _shared(parts: Column) -> Column:
    """A probability vector from an array of weights."""
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return array_to_vector(F.transform(parts, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0) / F.size(parts))))


def _softmax(scores: str) -> Column:
    """Probabilities from log scores."""
    return _shared(F.transform(scores, lambda v: F.exp(v - F.array_max(scores))))


def _ridge(df: DataFrame, classes: int, p: dict) -> Rule:
    sizes = {int(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
    n = sum(sizes.values())
    fits = []
    for c in range(classes) if classes > 2 else [1]:
        y = df.withColumn("y", F.when(F.col("label") == c, 1.0).otherwise(-1.0))
        share = sizes.get(c, 0) / n
        spread = 2 * math.sqrt(share * (1 - share)) or 1.0  # Spark's penalty is in units of the target's deviation
        m = LinearRegression(labelCol="y", solver="normal", regParam=p["alpha"] / n * spread, standardization=False).fit(y)
        fits.append((m.coefficients.toArray().tolist(), m.intercept))

    return Rule("ridge", {"fits": fits})


def _apply_ridge(df: DataFrame, rule: Rule) -> DataFrame:
    scores = [_dot(w) + F.lit(float(b)) for w, b in rule.state["fits"]]
    return _argmax(df, scores if len(scores) > 1 else [-scores[0], scores[0]])


def _stump(model) -> tuple[int, float, float, float]:
    """Feature, threshold and the classes up to it and above of a fitted tree of one split at most."""
    root = model._java_obj.rootNode()
    if model.numNodes == 1:
        return 0, 0.0, root.prediction(), root.prediction()
    return root.split().featureIndex(), root.split().threshold(), root.leftChild().prediction(), root.rightChild().prediction()


def _folded(stumps: Sequence[tuple], begin: float, step) -> Column:
    """step(value so far, stump's weight, its class) over all stumps (weight, feature, threshold, two classes): one expression, whatever their number."""
    fields = ("weight", "feature", "threshold", "low", "high")
    table = F.array(*[F.struct(*[F.lit(int(v) if n == "feature" else float(v)).alias(n) for n, v in zip(fields, s)]) for s in stumps])
    vote = lambda a, t: F.when(F.get(a["x"], t["feature"]) <= t["threshold"], t["low"]).otherwise(t["high"])
    first = F.struct(vector_to_array("features").alias("x"), F.lit(begin).alias("v"))
    return F.aggregate(table, first, lambda a, t: F.struct(a["x"].alias("x"), step(a["v"], t["weight"], vote(a, t)).alias("v")), lambda a: a["v"])


def _adaboost(df: DataFrame, classes: int, p: dict) -> Rule:
    """SAMME: each stump is fitted on weights that the errors of those before raised. The rows are written once; a row's weight is one expression of the stumps, so no round builds on the plan of another."""
    rows, stumps = checkpointed(df.select("features", "label")), []
    raised = lambda v, weight, vote: F.when(vote != F.col("label"), v * F.exp(F.least(weight, F.lit(50.0)))).otherwise(v)
    for _ in range(p["n_estimators"]):
        now = rows.withColumn("w", _folded(stumps, 1.0, raised) if stumps else F.lit(1.0))
        stump = _stump(M.DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=SEED).fit(now))
        own = _folded([(0.0, *stump)], 0.0, lambda v, weight, vote: vote)
        error = now.agg(F.sum(F.when(own != F.col("label"), F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0]
        if error >= 1 - 1 / classes:
            break
        stumps.append((p["learning_rate"] * (math.log((1 - error) / max(error, 1e-12)) + math.log(classes - 1)), *stump))
        if error <= 1e-12:
            break
    return Rule("adaboost", {"weights": [s[0] for s in stumps], "stumps": stumps, "classes": classes})


def _apply_adaboost(df: DataFrame, rule: Rule) -> DataFrame:
    stumps = rule.state["stumps"]
    if not stumps:
        return _argmax(df, [F.lit(0.0)] * rule.state["classes"])
    return _argmax(df, [_folded(stumps, 0.0, lambda v, weight, vote, c=c: v + F.when(vote == c, weight).otherwise(0.0)) for c in range(rule.state["classes"])])


def landmarks(df: DataFrame, n: int, rounds: int = 5) -> list[list[float]]:
    """Points of df, far from each other: in each round some are drawn with a chance in proportion to their squared distance to those before.

    The draw of a point is a hash of it, so it can be repeated; rounds are passes that hand on n / rounds rows a task at most.
    """
    x, found = vector_to_array("features"), []
    points = checkpointed(df.select(x.alias("x")).distinct().withColumn("u", (F.pmod(F.xxhash64("x"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)))
    while len(found) < n:
        gap = F.lit(1.0)
        if found:
            marks = F.array(*[F.array(*[F.lit(v) for v in m]) for m in found])
            gap = F.array_min(F.transform(marks, lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
        some = min(n - len(found), max(1, -(-n // rounds)) if found else 1)
        drawn = points.withColumn("gap", gap).where("gap > 0").orderBy(-F.log("u") / F.col("gap"), "x").limit(some).collect()
        if not drawn:
            break
        found += [list(r["x"]) for r in drawn]
    return found


def whitening(marks: Sequence[Sequence[float]], gamma: float) -> list[list[float]]:
    """What turns kernel values with the landmarks into features whose products are the kernel's best approximation on them (eigenvectors of the landmarks' kernel matrix)."""
    m = np.array(marks)
    kernel = np.exp(-gamma * ((m[:, None, :] - m[None, :, :]) ** 2).sum(2))
    value, vector = np.linalg.eigh(kernel)
    kept = value > 1e-10 * value.max()
    return (vector[:, kept] / np.sqrt(value[kept])).tolist()


def _svc(df: DataFrame, classes: int, p: dict) -> Rule:
    """Radial kernel on landmarks (Nystroem): whitened kernel values are the features of a linear machine; its margins are calibrated by logistic regression (Platt)."""
    d = len(df.first()["features"])
    x = vector_to_array("features")
    var = df.select(F.posexplode(x)).groupBy("pos").agg(F.avg("col").alias("m"), F.avg(F.col("col") ** 2).alias("q")).agg(F.avg(F.col("q") - F.col("m") ** 2)).first()[0]
    gamma = {"scale": 1 / (d * max(var, 1e-12)), "auto": 1 / d}.get(p.get("gamma", "scale")) or p["gamma"]
    marks = landmarks(df, p["landmarks"]) if p.get("kernel", "rbf") == "rbf" else []
    linear = M.LinearSVC(featuresCol="kernel", regParam=1 / (p["C"] * max(1, df.count())), maxIter=50)
    learner = linear if classes == 2 else M.OneVsRest(classifier=linear, featuresCol="kernel")
    rule = Rule("svc", {"gamma": gamma, "marks": marks, "white": whitening(marks, gamma) if marks else [], "calibration": []})
    mapped = checkpointed(_kernel(df, rule.state))
    rule.models = [learner.fit(mapped)]
    margins = rule.models[0].transform(mapped).select("label", vector_to_array("rawPrediction").alias("margin"))
    for c in range(classes if classes > 2 else 1):
        k = c if classes > 2 else 1
        one = margins.select(array_to_vector(F.array(F.get("margin", F.lit(k)))).alias("features"), (F.col("label") == k).cast("double").alias("label"))
        fitted = M.LogisticRegression(regParam=1e-6, maxIter=50).fit(one)
        rule.state["calibration"].append((float(fitted.coefficients[0]), float(fitted.intercept)))
    return rule


def _kernel(df: DataFrame, state: dict) -> DataFrame:
    """df with kernel: the features of the linear machine."""
    if not state["marks"]:
        return df.withColumn("kernel", F.col("features"))
    marks, white, gamma = np.array(state["marks"]), np.array(state["white"]), float(state["gamma"])

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy())
        gap = (rows * rows).sum(1)[:, None] - 2 * rows @ marks.T + (marks * marks).sum(1)[None, :]
        return pd.Series(list(np.exp(-gamma * np.maximum(gap, 0.0)) @ white))

    return df.withColumn("kernel", array_to_vector(mapped(vector_to_array("features"))))


def _apply_svc(df: DataFrame, rule: Rule) -> DataFrame:
    out, margin = rule.models[0].transform(_kernel(df, rule.state)), vector_to_array("rawPrediction")
    logistic = lambda k, ab: 1 / (1 + F.exp(-(ab[0] * F.get(margin, F.lit(k)) + ab[1])))
    pairs = rule.state["calibration"]
    parts = [logistic(k, ab) for k, ab in enumerate(pairs)] if len(pairs) > 1 else [1 - logistic(1, pairs[0]), logistic(1, pairs[0])]
    return out.withColumn("probability", _shared(F.array(*parts))).drop("kernel")


def _growth(name: str, p: dict) -> boost.Growth:
    """Second-order trees by depth, leaf-wise trees or symmetric ones; max_depth 0 sets no limit to leaf-wise trees."""
    more = {"least_rows": p["min_samples_leaf"]} if "min_samples_leaf" in p else {}
    if name == "xgboost":
        return boost.Growth("depth", p["max_depth"], penalty=p.get("reg_lambda", 1.0), least_gain=p.get("gamma", 0.0), least_hessian=p.get("min_child_weight", 1.0), subsample=p["subsample"], columns=p["colsample_bytree"], **more)
    if name == "lightgbm":
        more = {"least_rows": 20} | more
        return boost.Growth("leaf", p["max_depth"], p["num_leaves"], penalty=p.get("reg_lambda", 0.0), least_hessian=p.get("min_child_weight", 1e-3), columns=p["colsample_bytree"], top_rate=p.get("top_rate", 1.0), other_rate=p.get("other_rate", 0.1), **more)
    return boost.Growth("symmetric", p["max_depth"], penalty=p["l2_leaf_reg"], least_hessian=0.0, subsample=p.get("subsample", 1.0), **({"least_rows": 0} | more))


def _boosted(df: DataFrame, name: str, classes: int, p: dict) -> Rule:
    places, tables, shares = list(p.get("categorical", [])), {}, []
    if places:
        df, table, shares = boost.ordered_statistics(df, places, classes)
        tables["statistics"], df = checkpointed(table), checkpointed(df)
    state = boost.grow_all(df, classes, _growth(name, p), p["n_estimators"], p["learning_rate"], SEED, name != "catboost")
    return Rule("boosted", state | {"categorical": places, "shares": shares}, tables=tables)


def _apply_boosted(df: DataFrame, rule: Rule) -> DataFrame:
    own = df.withColumn("_own", F.col("features"))
    if rule.tables:
        own = boost.with_statistics(own, rule.tables["statistics"], rule.state["categorical"], rule.state["shares"])
    out = boost.scored(own, {k: rule.state[k] for k in ("edges", "start", "trees")}).withColumn("features", F.col("_own")).drop("_own")
    return out.withColumn("prediction", (F.array_position("rawScores", F.array_max("rawScores")) - 1).cast("double"))


def _extra(df: DataFrame, classes: int, p: dict) -> Rule:
    more = {k: p[k] for k in ("max_features", "criterion", "min_samples_leaf") if k in p}
    return Rule("extra", {"trees": extra.fit(df, classes, p["n_estimators"], p["max_depth"], seed=SEED, **more)})


def _apply_extra(df: DataFrame, rule: Rule) -> DataFrame:
    return extra.scored(df, rule.state["trees"]).withColumn("prediction", (F.array_position("rawScores", F.array_max("rawScores")) - 1).cast("double"))


def _apply_network(df: DataFrame, rule: Rule) -> DataFrame:
    return net.scored(df, rule.state["layers"])


def _columns(df: DataFrame, d: int) -> tuple[DataFrame, list[str]]:
    """df with its features as d columns of their own."""
    names = [f"_f{i}" for i in range(d)]
    return df.withColumn("_x", vector_to_array("features")).select(*df.columns, *[F.get("_x", F.lit(i)).alias(n) for i, n in enumerate(names)]), names


def _generative(df: DataFrame, kind: str, p: dict) -> Rule:
    d = len(df.first()["features"])
    wide, names = _columns(df.select("features", "label"), d)
    fitted = bayes.FITS[kind][0](wide, names, "label", **p)
    return Rule("generative", {"kind": kind, "d": d, "classes": [[float(c), v] for c, v in sorted(fitted.items())]})


def _apply_generative(df: DataFrame, rule: Rule) -> DataFrame:
    """Classes that training did not meet have no probability."""
    wide, names = _columns(df, rule.state["d"])
    scores = bayes.FITS[rule.state["kind"]][1](dict(map(tuple, rule.state["classes"])), names)
    top = int(max(scores))
    out = _argmax(wide, [scores.get(float(c), F.lit(-1e300)) for c in range(top + 1)])
    return out.withColumn("probability", _softmax("rawScores")).drop(*names)


def _apply_knn(df: DataFrame, rule: Rule) -> DataFrame:
    """Every row gets a number, which its neighbours are found by; the numbers are written, so they stay."""
    s = rule.state
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    queries = rows.select(F.col("_row").alias("id"), vector_to_array("features").alias("x"))
    train = rule.tables["train"]
    near = knn.knn(queries, train.select("id", "x"), s["k"], exclude_self=False, p=s["p"])
    weight = F.lit(1.0) if s["weights"] == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    votes = near.join(train.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id").agg(*[F.sum(F.when(F.col("label") == c, weight).otherwise(0.0)).alias(f"_v{c}") for c in range(s["classes"])])
    scored = _argmax(votes, [F.col(f"_v{c}") for c in range(s["classes"])]).select(F.col("id").alias("_row"), "rawScores", "prediction")
    return rows.join(scored, "_row", "left").withColumn("probability", _shared(F.col("rawScores"))).drop("_row")


_APPLY = {"ridge": _apply_ridge, "linear": _apply_ridge, "adaboost": _apply_adaboost, "svc": _apply_svc, "generative": _apply_generative, "knn": _apply_knn, "boosted": _apply_boosted, "extra": _apply_extra, "network": _apply_network}


def estimator(name: str, classes: int, n: int, p: dict):
    """The Spark estimator of a model, one-vs-rest where the learner is binary."""
    if name == "logistic_regression":
        return M.LogisticRegression(regParam=1 / (p["C"] * n), elasticNetParam=p.get("l1", 0.0), maxIter=p["max_iter"], standardization=False)
    if name == "decision_tree":
        return M.DecisionTreeClassifier(maxDepth=p["max_depth"], minInstancesPerNode=p.get("min_samples_leaf", 1), impurity=p.get("criterion", "gini"), seed=SEED)
    elif name == "random_forest":
        return M.RandomForestClassifier(numTrees=p["n_estimators"], maxDepth=p["max_depth"], featureSubsetStrategy=p.get("max_features", "sqrt"), minInstancesPerNode=p.get("min_samples_leaf", 1), impurity=p.get("criterion", "gini"), seed=SEED)
    elif name == "gradient_boosting":
        one = M.GBTClassifier(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], subsamplingRate=p.get("subsample", 1.0), minInstancesPerNode=p.get("min_samples_leaf", 1), seed=SEED)
    else:
        raise ValueError(f"unknown model {name}")
    return one if classes == 2 else M.OneVsRest(classifier=one)


def fit(df: DataFrame, name: str, params: dict | None = None) -> Model | Rule:
    """A fitted model whose transform adds prediction. Parameters are those in DEFAULTS; others pass through."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name}")
    p = DEFAULTS[name] | (params or {})
    classes = int(df.agg(F.max("label")).first()[0]) + 1
    if name == "ridge":
        return _ridge(df, classes, p)
    if name == "adaboost":
        return _adaboost(df, classes, p)
    if name == "svc":
        return _svc(df, classes, p)
    if name == "sgd":
        w, b = sgd.fit(df, classes, p["alpha"], p["max_iter"])
        return Rule("linear", {"fits": list(zip(w, b))})
    if name == "extra_trees":
        return _extra(df, classes, p)
    if name in ("xgboost", "lightgbm", "catboost"):
        return _boosted(df, name, classes, p)
    if name == "mlp":
        hidden = p["hidden"] if isinstance(p["hidden"], (list, tuple)) else [p["hidden"]]
        return Rule("network", {"layers": net.fit(df, classes, hidden, p["alpha"], p["learning_rate"], p["max_iter"], SEED)})
    if name in GENERATIVE:
        return _generative(df, GENERATIVE[name], p)
    if name == "knn":
        train = checkpointed(df.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label")))
        return Rule("knn", p | {"classes": classes}, tables={"train": train})
    return estimator(name, classes, df.count(), p).fit(df)


def score(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep, label, prediction and, where the model has them, probabilities; rows are never dropped or merged."""
    out = model.transform(df)
    more = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(*keep, "label", "prediction", *more)


def save(model: Model | Rule, spark: SparkSession, path: str) -> str:
    """Writes a fitted model of any learner: one row of JSON, and its Spark models and tables beside it."""
    if isinstance(model, Rule):
        for i, m in enumerate(model.models):
            m.write().overwrite().save(f"{path}/model-{i}")
        for name, table in model.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/table-{name}")
        state = {"kind": model.kind, "state": model.state, "models": [type(m).__name__ for m in model.models], "tables": sorted(model.tables)}
    else:
        model.write().overwrite().save(f"{path}/model-0")
        state = {"kind": None, "models": [type(model).__name__]}
    write_json(state, spark, f"{path}/state")
    return path


def load(spark: SparkSession, path: str) -> Model | Rule:
    state = read_json(spark, f"{path}/state")
    loaded = [getattr(M, name).load(f"{path}/model-{i}") for i, name in enumerate(state["models"])]
    if state["kind"] is None:
        return loaded[0]
    return Rule(state["kind"], state["state"], loaded, {name: spark.read.parquet(f"{path}/table-{name}") for name in state["tables"]})


def forest_importance(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """feature, importance and rank from a forest of 100 trees."""
    model = fit(df, "random_forest")
    got = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[: min(n, len(columns))]
    return df.sparkSession.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(got)], "feature string, importance double, rank int")


#: Rows of a range in which partners are found.
PARTNERS = 1 << 16


def permutation_importance(df: DataFrame, columns: Sequence[str], model, key: str) -> DataFrame:
    """Loss of accuracy when a feature takes the value of another row: its partner by the order of a hash, found per range of the hash. There are as many ranges as PARTNERS rows ask for."""
    x = vector_to_array("features")
    base, n = model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.count("*")).first()
    ranges = max(1, -(-n // PARTNERS))
    order = Window.partitionBy(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(ranges))).orderBy(F.xxhash64(key, F.lit(2)), key)
    shifted = checkpointed(df.withColumn("_x", x).withColumn("_y", F.coalesce(F.lead("_x").over(order), F.first("_x").over(order))))
    rows = []

    def swapped(i: int):
        return lambda v, k: F.when(k == i, F.get("_y", k)).otherwise(v)

    for i, c in enumerate(columns):
        mixed = shifted.withColumn("features", array_to_vector(F.transform("_x", swapped(i))))
        rows.append((c, base - model.transform(mixed).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]))
    got = sorted(rows, key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(got)], "feature string, importance double, rank int")


def linear_importance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact linear attribution: mean of |weight * (value - mean)| of a logistic regression, by feature."""
    w = fit(df, "logistic_regression").coefficientMatrix.toArray()
    x = vector_to_array("features")
    means = df.select(F.posexplode(x)).groupBy("pos").agg(F.avg("col").alias("m"))
    gap = df.select(F.posexplode(x)).join(F.broadcast(means), "pos").groupBy("pos").agg(F.avg(F.abs(F.col("col") - F.col("m"))).alias("gap"))
    names = df.sparkSession.createDataFrame([(i, c, float(abs(w[:, i]).mean())) for i, c in enumerate(columns)], "pos int, feature string, w double")
    return gap.join(F.broadcast(names), "pos").select("feature", (F.col("gap") * F.col("w")).alias("importance")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
