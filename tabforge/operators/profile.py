"""Profiling of a table: shape, types, nulls, moments, quantiles, identifiers, skew, outliers, correlation, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.stats import as_dict, categorical_columns, col, distinct_counts, numeric_columns, per_column, quantiles, quoted

# Thresholds of the profile.
SKEW, CORRELATED, ID_RATIO, ID_HINT_RATIO, ID_NULLS, FENCE = 0.5, 0.65, 0.9, 0.5, 5.0, 1.5
ID_HINTS = "id|key|code|uuid|guid"


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def schema_table(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """column, position, kind (numeric or categorical) and nulls."""
    kept = [c for c in df.columns if c not in exclude]
    numbers = numeric_columns(df)
    nulls = per_column(df, kept, {"nulls": lambda c: F.count_if(F.col(c).isNull())})
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i + 1))])
    kind = F.when(F.col("column").isin(numbers), F.lit("numeric")).otherwise(F.lit("categorical"))
    return nulls.select("column", place[F.col("column")].alias("position"), kind.alias("kind"), "nulls")


def nulls(df: DataFrame) -> DataFrame:
    """column, nulls, null_pct and has_nulls."""
    rows = per_column(df, df.columns, {"nulls": lambda c: F.count_if(F.col(c).isNull()), "n": lambda c: F.count("*")})
    return rows.select("column", "nulls", F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("n")), F.lit(0.0)).alias("null_pct"), (F.col("nulls") > 0).alias("has_nulls"))


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample deviation, extremes and quartiles of numeric columns; exact=False takes approximate quartiles in the same pass."""
    columns = numeric_columns(df) if columns is None else columns
    fields = {"n": lambda c: F.count(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    if not exact:
        rows = per_column(df, columns, fields | {"q": lambda c: F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10_000)})
    else:
        found = [(c, [float(x) for x in q] if q else None) for c, q in quantiles(df, columns, [0.25, 0.5, 0.75]).items()]
        rows = per_column(df, columns, fields).join(F.broadcast(df.sparkSession.createDataFrame(found, "column string, q array<double>")), "column")
    return rows.select("column", "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def distinct_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return distinct_counts(df, df.columns if columns is None else columns).select("column", "distinct", (F.col("distinct") / F.col("n")).alias("ratio"))


def identifiers(df: DataFrame) -> DataFrame:
    """column, ratio, null_pct, hinted and is_id."""
    numbers = numeric_columns(df)
    both = distinct_ratio(df).join(nulls(df), "column")
    hinted = F.lower("column").rlike(ID_HINTS)
    number = F.col("column").isin(numbers)
    is_id = (F.col("null_pct") <= ID_NULLS) & F.when(number, (F.col("ratio") > ID_RATIO) & hinted).otherwise((F.col("ratio") > ID_RATIO) | ((F.col("ratio") > ID_HINT_RATIO) & hinted))
    return both.select("column", "ratio", "null_pct", hinted.alias("hinted"), is_id.alias("is_id"))


def column_types(df: DataFrame) -> DataFrame:
    """column and kind: id, numeric or categorical."""
    numbers = numeric_columns(df)
    kind = F.when(F.col("is_id"), F.lit("id")).when(F.col("column").isin(numbers), F.lit("numeric")).otherwise(F.lit("categorical"))
    return identifiers(df).select("column", kind.alias("kind"))


def id_columns(df: DataFrame) -> list[str]:
    return [r["column"] for r in identifiers(df).where("is_id").collect()]


def bias_corrected_skewness(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def skew(df: DataFrame, threshold: float = SKEW, max_ratio: float | None = ID_RATIO) -> DataFrame:
    """column, skewness and skewed of numeric columns whose distinct ratio is not above max_ratio; an undefined skewness is not skewed."""
    rows = per_column(df, numeric_columns(df), {"skewness": bias_corrected_skewness})
    if max_ratio is not None:
        rows = rows.join(distinct_ratio(df, numeric_columns(df)).where(F.col("ratio") <= max_ratio).select("column"), "column")
    return rows.select("column", "skewness", F.coalesce(F.abs("skewness") > threshold, F.lit(False)).alias("skewed"))


def skew_map(df: DataFrame, columns: Sequence[str], threshold: float = SKEW) -> DataFrame:
    """The columns that are skewed, with their skewness."""
    return per_column(df, columns, {"skewness": bias_corrected_skewness}).where(F.abs("skewness") > threshold)


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Jarque-Bera statistic and p of each numeric column, over all rows."""
    rows = per_column(df, numeric_columns(df) if columns is None else columns, {"n": lambda c: F.count(c), "s": lambda c: F.skewness(c), "k": lambda c: F.kurtosis(c)})
    jb = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return rows.select("column", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"))


def fences(df: DataFrame, columns: Sequence[str], multiplier: float = FENCE) -> dict[str, tuple[float, float]]:
    """Lower and upper fence by column (None for a column without values)."""
    found = quantiles(df, columns, [0.25, 0.75])
    return {c: (q[0] - multiplier * (q[1] - q[0]), q[1] + multiplier * (q[1] - q[0])) for c, q in found.items() if q}


def outliers(df: DataFrame, max_ratio: float = ID_RATIO, multiplier: float = FENCE) -> DataFrame:
    """column, low, high and outliers of numeric columns whose distinct ratio is not above max_ratio."""
    columns = [r["column"] for r in distinct_ratio(df, numeric_columns(df)).where(F.col("ratio") <= max_ratio).collect()]
    limits = fences(df, columns, multiplier)
    by = {quoted(c): v for c, v in limits.items()}
    counted = per_column(df, list(limits), {"outliers": lambda c: F.count_if((F.col(c) < by[c][0]) | (F.col(c) > by[c][1])) if c in by else F.count(c)})
    known = df.sparkSession.createDataFrame([(c, float(a), float(b)) for c, (a, b) in limits.items()], "column string, low double, high double")
    return counted.join(F.broadcast(known), "column").select("column", "low", "high", "outliers")


#: Columns of one block of the matrix: a task keeps seven numbers for each pair in two blocks.
CORRELATED_COLUMNS = 512


class _Moments:
    """For each pair (a of the left columns, b of the right ones) over the rows where both have values: n, the two means, the two sums of squares and the sum of products about them."""

    def __init__(self, left: int, right: int):
        self.n = np.zeros((left, right))
        self.parts = [np.zeros((left, right)) for _ in range(5)]

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> _Moments:
        """From values with NaN for null; they are shifted to their means, so that sums of squares keep their digits."""
        out = _Moments(x.shape[1], y.shape[1])
        (x, m, at), (y, k, to) = _shifted(x), _shifted(y)
        out.n = m.T @ k
        n = np.maximum(out.n, 1)
        a, b = x.T @ k / n, m.T @ y / n
        # what is left beside rounding errors of the sums counts as no deviation
        rest = lambda whole, part: np.where(whole - part <= 1e-13 * whole, 0.0, whole - part)
        aa, bb = (x * x).T @ k, m.T @ (y * y)
        out.parts = [at[:, None] + a, to[None, :] + b, rest(aa, n * a * a), rest(bb, n * b * b), x.T @ y - n * a * b]
        return out

    def add(self, other: _Moments) -> None:
        """Moments of both sets of rows, pair by pair (Chan et al. 1979)."""
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        a, b = other.parts[0] - self.parts[0], other.parts[1] - self.parts[1]
        weight = self.n * share
        self.parts = [
            np.where(self.n > 0, self.parts[0], 0) + np.where(self.n > 0, a * share, other.parts[0] * (other.n > 0)), np.where(self.n > 0, self.parts[1], 0) + np.where(self.n > 0, b * share, other.parts[1] * (other.n > 0)),
            self.parts[2] + other.parts[2] + weight * a * a, self.parts[3] + other.parts[3] + weight * b * b, self.parts[4] + other.parts[4] + weight * a * b,
        ]
        self.n = n


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values less a number near each column's mean (0 for null), whether there is a value, and the number. A constant column becomes exactly 0."""
    has = ~np.isnan(x)
    first = np.where(has.any(0), x[has.argmax(0), np.arange(x.shape[1])], 0.0) if len(x) else np.zeros(x.shape[1])
    x = np.where(has, x - first, 0.0)
    mean = x.sum(0) / np.maximum(has.sum(0), 1)
    return np.where(has, x - mean, 0.0), has.astype(float), first + mean


def _pairs(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """a, b (places in left and right) and r for all pairs with a < b, if both are the same columns, or for all pairs."""
    columns = left if left == right else [*left, *right]
    values = df.select(*[F.coalesce(col(c).cast("double"), F.lit(float("nan"))).alias(f"_{i}") for i, c in enumerate(columns)], *[(col(c).isNotNull() & F.isnan(col(c).cast("double"))).alias(f"_n{i}") for i, c in enumerate(columns)])
    d, k = len(columns), len(left)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bad = _Moments(k, len(right)), np.zeros(d, bool)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:d]], axis=1)
            bad |= np.array([c.true_count > 0 for c in batch.columns[d:]]) | np.isinf(x).any(0)
            x = np.where(np.isinf(x), np.nan, x)
            total.add(_Moments.of(x[:, :k], x[:, -len(right) :]))
        undefined = bad[:k, None] | bad[None, -len(right) :]
        for a in range(k):
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([np.stack([total.n[a], *(p[a] for p in total.parts), undefined[a].astype(float)]).tobytes()])], ["a", "m"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Moments, np.ndarray]] = {}
        for batch in batches:
            for a, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.frombuffer(m).reshape(7, 1, -1)
                one = _Moments(1, m.shape[2])
                one.n, one.parts = m[0], list(m[1:6])
                if a in held:
                    held[a][0].add(one)
                    held[a] = held[a][0], held[a][1] + m[6, 0]
                else:
                    held[a] = one, m[6, 0]
        for a, (m, bad) in held.items():
            b = np.arange(a + 1 if left == right else 0, len(right))
            xx, yy, xy = (p[0][b] for p in m.parts[2:])
            whole = (m.n[0][b] > 0) & (xx > 0) & (yy > 0)
            r = np.divide(xy, np.sqrt(xx) * np.sqrt(yy), out=np.zeros(len(b)), where=whole).clip(-1, 1)
            r[bad[b] > 0] = np.nan
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a, np.int32)), pa.array(b.astype(np.int32)), pa.array(r, mask=~(whole | (bad[b] > 0)))], ["a", "b", "r"])

    return values.mapInArrow(sums, "a int, m binary").repartition("a").mapInArrow(joined, "a int, b int, r double")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """col_a, col_b and r of each pair of numeric columns, in column order; pairs with a null are left out pairwise.

    One pass over the table for up to CORRELATED_COLUMNS columns, and one more for each further pair of blocks of as many:
    tasks make matrices of products, of the values and of where there are values, and hand on a row of them a column. A
    column that is constant where the other has values has r null, as has a pair without common rows; NaN and infinite
    values make r NaN.
    """
    columns = list(numeric_columns(df) if columns is None else columns)
    out = df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    if len(columns) < 2:
        return out
    blocks = [columns[a : a + CORRELATED_COLUMNS] for a in range(0, len(columns), CORRELATED_COLUMNS)]
    found = None
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            names = lambda own: F.array(*map(F.lit, own))
            rows = _pairs(df, left, right).select(F.get(names(left), F.col("a")).alias("col_a"), F.get(names(right), F.col("b")).alias("col_b"), "r")
            found = rows if found is None else found.unionByName(rows)
    return found


def correlation_map(df: DataFrame, threshold: float = CORRELATED) -> DataFrame:
    """column, other and r, both directions, where |r| is above the threshold."""
    strong = correlations(df).where(F.abs("r") > threshold)
    return strong.select(F.col("col_a").alias("column"), F.col("col_b").alias("other"), "r").unionByName(strong.select(F.col("col_b").alias("column"), F.col("col_a").alias("other"), "r"))


def correlation_pairs(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    return correlations(df).where(F.abs("r") > threshold)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """column, bin (from 1) and n over equal widths between each column's extremes; the last bin takes the largest value."""
    limits = as_dict(per_column(df, columns, {"a": lambda c: F.min(c).cast("double"), "b": lambda c: F.max(c).cast("double")}))
    limits = {c: (r["a"], r["b"]) for c, r in limits.items() if r["a"] is not None}
    place = [F.when(F.lit(b == a), F.when(col(c).isNotNull(), 1)).otherwise(F.least(F.floor((col(c).cast("double") - a) / ((b - a) or 1.0) * bins) + 1, F.lit(bins))).cast("int").alias(c) for c, (a, b) in limits.items()]
    if not limits:
        return df.sparkSession.createDataFrame([], "column string, bin int, n long")
    return df.select(*place).unpivot([], [quoted(c) for c in limits], "column", "bin").where("bin is not null").groupBy("column", "bin").agg(F.count("*").alias("n"))


def box_plot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles and whiskers: the outermost values within the fences."""
    limits = fences(df, columns)
    by = {quoted(c): v for c, v in limits.items()}
    inside = lambda c: F.when((F.col(c) >= by[c][0]) & (F.col(c) <= by[c][1]), F.col(c)) if c in by else F.col(c)
    found = df.sparkSession.createDataFrame([(c, [float(x) for x in q]) for c, q in quantiles(df, list(limits), [0.25, 0.5, 0.75]).items()], "column string, q array<double>")
    rows = per_column(df, list(limits), {"low": lambda c: F.min(inside(c)).cast("double"), "high": lambda c: F.max(inside(c)).cast("double")}).join(F.broadcast(found), "column")
    return rows.select("column", F.col("low").alias("whisker_low"), F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), F.col("high").alias("whisker_high"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(col(target).alias("class")).agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one; groups are counted after pre-aggregation."""
    return df.groupBy(*map(quoted, df.columns)).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")).withColumn("has_duplicates", F.col("duplicates") > 0)


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """The profile table: one row a column with type, nulls, distinct values and, for numbers, moments and quartiles.

    exact=False takes approximate distinct counts and quartiles, which need no shuffle of the values.
    """
    numbers = numeric_columns(df)
    counts = distinct_counts(df, df.columns) if exact else per_column(df, df.columns, {"distinct": lambda c: F.approx_count_distinct(c, 0.01), "n": lambda c: F.count("*")})
    base = schema_table(df).join(counts, "column", "left")  # an empty table has no values
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.join(F.broadcast(describe(df, numbers, exact).drop("n")), "column", "left").select("column", "position", "kind", zero("n"), "nulls", zero("distinct"), "mean", "std", "min", "q25", "q50", "q75", "max")


def feature_lists(df: DataFrame, target: str) -> dict:
    """Lists of columns by property, for the later stages."""
    ids = id_columns(df)
    rest = [c for c in df.columns if c not in ids]
    numbers, texts = [c for c in numeric_columns(df) if c in rest], [c for c in categorical_columns(df) if c in rest]
    skewed = {r["column"]: r["skewed"] for r in skew(df.select(*map(quoted, numbers))).collect()} if numbers else {}
    out = [r["column"] for r in outliers(df.select(*map(quoted, numbers))).where("outliers > 0").collect()] if numbers else []
    empty = [r["column"] for r in nulls(df).where("has_nulls").collect()]
    return {"id_cols": ids, "numerical_cols": numbers, "categorical_cols": texts, "skewed_cols": [c for c, s in skewed.items() if s], "normal_cols": [c for c, s in skewed.items() if not s], "contains_null": empty, "contains_outliers": out, "target_col": target}
