"""Yeo-Johnson and Box-Cox power transforms with the exponent of greatest likelihood, found on grids in aggregate jobs.

A grid of 41 exponents in [-2, 2] is evaluated for all columns at once, then twice refined around the best (21 points
each, last step 0.001). The transformed column is standardised with the population deviation. Tasks count the distinct values
of their rows, and only these meet the exponents; what leaves a task are moments by column and exponent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.stats import as_dict, col, per_column

YEO, BOX = "yeo-johnson", "box-cox"


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).when(x < 0, down)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


#: Distinct values of a column that a task counts before they meet the exponents.
COUNTED = 1 << 16


def _varied(x: np.ndarray, lam: float, method: str) -> np.ndarray:
    """The transform of an array."""
    if method == BOX:
        return np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam
    up, down = np.maximum(x, 0.0), np.minimum(x, 0.0)  # NaN stays in both
    up = np.log1p(up) if abs(lam) < 1e-12 else ((up + 1) ** lam - 1) / lam
    down = -np.log1p(-down) if abs(lam - 2) < 1e-12 else -((1 - down) ** (2 - lam) - 1) / (2 - lam)
    return np.where(x < 0, down, up)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments (number, mean, sums of squares and of cubes about it, Jacobian's sum; last axis) of two sets together."""
    n, gap = a[..., 0] + b[..., 0], b[..., 1] - a[..., 1]
    mine, share = a[..., 0] / n, b[..., 0] / n
    squares = a[..., 2] + b[..., 2] + gap**2 * a[..., 0] * share
    cubes = a[..., 3] + b[..., 3] + gap**3 * a[..., 0] * share * (mine - share) + 3 * gap * (mine * b[..., 2] - share * a[..., 2])
    return np.stack([n, a[..., 1] + gap * share, squares, cubes, a[..., 4] + b[..., 4]], axis=-1)


def _moments(x: np.ndarray, counts: np.ndarray, lams: np.ndarray, method: str) -> np.ndarray:
    """Moments of the transformed values, each as often as counted, by exponent."""
    with np.errstate(all="ignore"):
        jacobian = (counts * (np.sign(x) * np.log1p(np.abs(x)) if method == YEO else np.log(x))).sum()
        n, out = counts.sum(), np.empty((len(lams), 5))
        for i, lam in enumerate(lams):
            v = _varied(x, lam, method)
            mean = (counts * v).sum() / n
            gap = v - mean
            out[i] = n, mean, (counts * gap**2).sum(), (counts * gap**3).sum(), jacobian
    return out


def _summed(df: DataFrame, columns: dict[str, Column], lams: dict[str, list[float]], method: str) -> DataFrame:
    """c (number of the column) and m (its packed moments by exponent): one pass, in which each task's distinct values meet the exponents."""
    grids = [np.array(lams[c], float) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64)) for _ in grids]
        waits, sums = [[] for _ in grids], [None for _ in grids]

        def counted(i: int) -> None:
            values, counts = zip(held[i], *waits[i])
            values, at = np.unique(np.concatenate(values), return_inverse=True)
            held[i], waits[i] = (values, np.bincount(at, np.concatenate(counts), len(values)).astype(np.int64)), []

        def spent(i: int) -> None:
            if len(held[i][0]):
                now = _moments(*held[i], grids[i], method)
                sums[i] = now if sums[i] is None else _merged(sums[i], now)
                held[i] = (np.zeros(0), np.zeros(0, np.int64))

        for batch in batches:
            for i, c in enumerate(batch.columns):
                waits[i].append(np.unique(c.drop_null().to_numpy(), return_counts=True))
                if sum(len(v) for v, _ in waits[i]) >= COUNTED:
                    counted(i)
                    if len(held[i][0]) >= COUNTED:
                        spent(i)
        for i in range(len(grids)):
            counted(i)
            spent(i)
            if sums[i] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums[i].tobytes()], pa.binary())], ["c", "m"])

    rows = df.select(*[e.cast("double").alias(f"v{i}") for i, e in enumerate(columns.values())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                now = np.frombuffer(m.as_buffer()).reshape(-1, 5)
                total[c] = _merged(total[c], now) if c in total else now
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["c", "m"])

    return rows.mapInArrow(run, "c int, m binary").repartition("c").mapInArrow(add, "c int, m binary")


def _fitted(df: DataFrame, columns: dict[str, Column], lams: dict[str, list[float]], method: str) -> dict[str, list[tuple[float, float, dict]]]:
    """(likelihood, exponent, the transform's mean, deviation and skewness) of every exponent by column."""
    moments = {r["c"]: np.frombuffer(r["m"]).reshape(-1, 5).tolist() for r in _summed(df, columns, lams, method).collect()}
    out: dict[str, list[tuple[float, float, dict]]] = {c: [] for c in columns}
    for i, c in enumerate(columns):
        for lam, (n, mean, squares, cubes, jacobian) in zip(lams[c], moments.get(i, ())):
            if squares > 0 and n > 0:
                shape = {"mean": mean, "deviation": math.sqrt(squares / n), "skewness": math.sqrt(n) * cubes / squares**1.5}
                out[c].append((-n / 2 * math.log(squares / n) + (lam - 1) * jacobian, lam, shape))
    return out


def _likelihoods(df: DataFrame, columns: dict[str, Column], lams: dict[str, list[float]], method: str) -> dict[str, list[tuple[float, float]]]:
    """(likelihood, exponent) of every exponent by column."""
    return {c: [each[:2] for each in found] for c, found in _fitted(df, columns, lams, method).items()}


def grid(low: float = -2.0, high: float = 2.0, n: int = 41) -> list[float]:
    return [round(low + (high - low) * i / (n - 1), 6) for i in range(n)]


def best_exponents(df: DataFrame, columns: dict[str, Column], method: str, refine: int = 2) -> dict[str, tuple[float, dict]]:
    """Exponent, and the transform's mean, deviation and skewness, by column; columns gives the (shifted) expression of each. Equal likelihoods: the least exponent."""
    lams = {c: grid() for c in columns}
    best: dict[str, tuple[float, dict]] = {}
    step = 0.1
    for turn in range(refine + 1):
        for c, scored in _fitted(df, columns, lams, method).items():
            if scored:
                top = max(v for v, *_ in scored)
                best[c] = min((each[1:] for each in scored if each[0] == top), key=lambda e: e[0])
        lams = {c: grid(best[c][0] - step, best[c][0] + step, 21) for c in columns if c in best}
        columns = {c: e for c, e in columns.items() if c in best}
        if not columns:
            break
        step /= 10
    return best


def _fit(df: DataFrame, lows: dict[str, float], method: str, refine: int) -> dict[str, dict]:
    """State by column as `fit` returns it, and skewness. lows: least values."""
    shift = {c: (abs(v) + 1 if method == BOX and v <= 0 else 0.0) for c, v in lows.items()}
    source = {c: col(c).cast("double") + F.lit(shift[c]) for c in lows}
    return {c: {"method": method, "shift": shift[c], "exponent": lam, **shape} for c, (lam, shape) in best_exponents(df, source, method, refine).items()}


def _lows(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: r["v"] for c, r in as_dict(per_column(df, columns, {"v": lambda c: F.min(c).cast("double")})).items() if r["v"] is not None}


def fit(df: DataFrame, columns: Sequence[str], method: str, refine: int = 2) -> dict[str, dict]:
    """State by column: method, shift, exponent, mean and deviation. For Box-Cox a column with values up to zero is shifted by |min| + 1."""
    if method not in (YEO, BOX):
        raise ValueError(f"unknown method {method}")
    return {c: {k: v for k, v in state.items() if k != "skewness"} for c, state in _fit(df, _lows(df, columns), method, refine).items()}


def transformed(c: Column, state: dict) -> Column:
    x = c.cast("double") + F.lit(state["shift"])
    return ((yeo_johnson if state["method"] == YEO else box_cox)(x, state["exponent"]) - F.lit(state["mean"])) / F.lit(state["deviation"])


def recommend(df: DataFrame, columns: Sequence[str], refine: int = 2) -> DataFrame:
    """column, both skewnesses after the transforms and recommendation: Yeo-Johnson for values up to zero, else the less skewed one (ties: Box-Cox)."""
    lows = _lows(df, columns)
    both = {m: _fit(df, lows, m, refine) for m in (BOX, YEO)}
    rows = []
    for c in columns:
        if c in both[BOX] and c in both[YEO]:
            a, b = (both[m][c]["skewness"] for m in (BOX, YEO))
            rows.append((c, a, b, BOX if lows[c] > 0 and abs(a) <= abs(b) else YEO))
    return df.sparkSession.createDataFrame(rows, "column string, skew_box_cox double, skew_yeo_johnson double, recommendation string")


def vote(recommended: DataFrame) -> DataFrame:
    """The recommendation of most columns; ties: Yeo-Johnson."""
    return recommended.agg(F.count_if(F.col("recommendation") == BOX).alias("box_cox"), F.count_if(F.col("recommendation") == YEO).alias("yeo_johnson")).withColumn("choice", F.when(F.col("box_cox") > F.col("yeo_johnson"), BOX).otherwise(YEO))
