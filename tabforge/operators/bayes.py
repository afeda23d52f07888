"""Generative classifiers fitted by one aggregate: naive Bayes in three forms, linear and quadratic discriminants.

State is a small table of numbers by class; scoring is an expression over the feature columns, without Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(scores: dict) -> Column:
    """The class of the largest score; ties go to the smallest class."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(None)
    for c, e in sorted(scores.items(), reverse=True):
        out = F.when(e == top, F.lit(c)).otherwise(out)
    return out


def _sum(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def gaussian_nb(df: DataFrame, columns: Sequence[str], label: str, smoothing: float = 1e-9) -> dict:
    """Prior, means and variances by class; a share of the largest variance of any column is added to all."""
    x = [F.col(c).cast("double") for c in columns]
    widest = max(v or 0.0 for v in df.agg(*[F.var_pop(e) for e in x]).first())
    rows = df.groupBy(label).agg(F.count("*"), *[F.avg(e) for e in x], *[F.var_pop(e) for e in x]).collect()
    n, d = sum(r[1] for r in rows), len(columns)
    return {r[0]: {"prior": r[1] / n, "mean": list(r[2 : 2 + d]), "var": [v + smoothing * widest for v in r[2 + d :]]} for r in rows}


def gaussian_scores(state: dict, columns: Sequence[str]) -> dict:
    out = {}
    for c, s in state.items():
        const = math.log(s["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in s["var"])
        out[c] = F.lit(const) - F.lit(0.5) * _sum([F.pow(F.col(k).cast("double") - m, F.lit(2.0)) / v for k, m, v in zip(columns, s["mean"], s["var"])])
    return out


def multinomial_nb(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0) -> dict:
    """Counts by class; a negative one raises an error."""
    least = F.least(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns], F.lit(0.0))
    rows = df.groupBy(label).agg(F.count("*"), *[F.sum(F.col(c).cast("double")) for c in columns], F.min(least).alias("_least")).collect()
    if any(r["_least"] < 0 for r in rows):
        raise ValueError("multinomial naive Bayes takes counts, and some are negative")
    rows = [r[:-1] for r in rows]
    n = sum(r[1] for r in rows)
    return {r[0]: {"prior": r[1] / n, "weight": [math.log((v + alpha) / (sum(r[2:]) + alpha * len(columns))) for v in r[2:]]} for r in rows}


def multinomial_scores(state: dict, columns: Sequence[str]) -> dict:
    return {c: F.lit(math.log(s["prior"])) + _sum([F.col(k).cast("double") * w for k, w in zip(columns, s["weight"])]) for c, s in state.items()}


def bernoulli_nb(df: DataFrame, columns: Sequence[str], label: str, alpha: float = 1.0, threshold: float = 0.0) -> dict:
    rows = df.groupBy(label).agg(F.count("*"), *[F.count_if(F.col(c) > threshold) for c in columns]).collect()
    n = sum(r[1] for r in rows)
    return {r[0]: {"prior": r[1] / n, "p": [(v + alpha) / (r[1] + 2 * alpha) for v in r[2:]], "threshold": threshold} for r in rows}


def bernoulli_scores(state: dict, columns: Sequence[str]) -> dict:
    return {c: F.lit(math.log(s["prior"])) + _sum([F.when(F.col(k) > s["threshold"], F.lit(math.log(p))).otherwise(F.lit(math.log(1 - p))) for k, p in zip(columns, s["p"])]) for c, s in state.items()}


#: Columns up to which every covariance is an aggregate of its own.
FEW_COLUMNS = 8


def _wide_moments(df: DataFrame, columns: Sequence[str], label: str) -> dict:
    """As _moments in two passes of one vector summary each, however many columns: means, then means of products of what is left. Rows with a null are left out."""
    d = len(columns)
    rows = df.select(F.col(label).alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x")).where(F.col("c").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    first = rows.groupBy("c").agg(Summarizer.metrics("count", "mean").summary(array_to_vector("x")).alias("s")).select("c", "s.count", vector_to_array("s.mean").alias("mean"))
    found = {r["c"]: (r["count"], np.array(r["mean"])) for r in first.collect()}
    means = df.sparkSession.createDataFrame([(c, m.tolist()) for c, (_, m) in found.items()], f"c {dict(rows.dtypes)['c']}, mean array<double>")
    gaps = rows.join(F.broadcast(means), "c").select("c", F.zip_with("x", "mean", lambda a, b: a - b).alias("x"))
    products = F.flatten(F.transform("x", lambda v, i: F.transform(F.slice("x", i + 1, F.lit(d)), lambda u: u * v)))
    second = gaps.groupBy("c").agg(Summarizer.mean(array_to_vector(products)).alias("p")).select("c", vector_to_array("p").alias("p")).collect()
    out = {}
    for r in second:
        cov = np.zeros((d, d))
        cov[np.triu_indices(d)] = r["p"]
        out[r["c"]] = (*found[r["c"]], cov + np.triu(cov, 1).T)
    return out


def _moments(df: DataFrame, columns: Sequence[str], label: str) -> dict:
    """Count, mean vector and population covariance by class; few columns in one pass."""
    if len(columns) > FEW_COLUMNS:
        return _wide_moments(df, columns, label)
    x, d = [F.col(c).cast("double") for c in columns], len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = {}
    for r in df.groupBy(label).agg(F.count("*"), *[F.avg(e) for e in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).collect():
        cov = np.zeros((d, d))
        for (i, j), v in zip(pairs, r[2 + d :]):
            cov[i, j] = cov[j, i] = v
        out[r[0]] = (r[1], np.array(r[2 : 2 + d], float), cov)
    return out


def lda(df: DataFrame, columns: Sequence[str], label: str) -> dict:
    """Weights and offset by class from the pooled covariance; the d x d system is solved on the driver."""
    m = _moments(df, columns, label)
    n = sum(c for c, _, _ in m.values())
    pooled = sum(c / n * cov for c, _, cov in m.values())
    solve = np.linalg.pinv(pooled)
    return {k: {"weight": (w := solve @ mean).tolist(), "offset": float(math.log(c / n) - 0.5 * mean @ w)} for k, (c, mean, _) in m.items()}


def lda_scores(state: dict, columns: Sequence[str]) -> dict:
    return {c: F.lit(s["offset"]) + _sum([F.col(k).cast("double") * w for k, w in zip(columns, s["weight"])]) for c, s in state.items()}


def qda(df: DataFrame, columns: Sequence[str], label: str, reg_param: float = 0.0) -> dict:
    """Inverse covariance (sample, shrunk to the identity by reg_param), mean and offset by class."""
    m = _moments(df, columns, label)
    n = sum(c for c, _, _ in m.values())
    out = {}
    for k, (c, mean, cov) in m.items():
        cov = (1 - reg_param) * cov * c / max(1, c - 1) + reg_param * np.eye(len(columns))
        out[k] = {"inverse": np.linalg.inv(cov).tolist(), "mean": mean.tolist(), "offset": float(math.log(c / n) - 0.5 * np.linalg.slogdet(cov)[1])}
    return out


def qda_scores(state: dict, columns: Sequence[str]) -> dict:
    out = {}
    for c, s in state.items():
        z = [F.col(k).cast("double") - m for k, m in zip(columns, s["mean"])]
        out[c] = F.lit(s["offset"]) - F.lit(0.5) * _sum([z[i] * z[j] * s["inverse"][i][j] for i in range(len(z)) for j in range(len(z))])
    return out


FITS = {"gaussian": (gaussian_nb, gaussian_scores), "multinomial": (multinomial_nb, multinomial_scores), "bernoulli": (bernoulli_nb, bernoulli_scores), "lda": (lda, lda_scores), "qda": (qda, qda_scores)}


def predict(df: DataFrame, state: dict, kind: str, columns: Sequence[str], out: str = "prediction") -> DataFrame:
    """df with the predicted class."""
    return df.withColumn(out, _best(FITS[kind][1](state, columns)))
