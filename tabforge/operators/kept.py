"""Profiles that are kept by batch and merged, so that a growing table is never read twice.

A batch's profile is one row a column: counts, moments about its mean, extremes and two sketches (distinct values,
quantiles). Merging adds the counts, moves the moments to the common mean and unites the sketches; merged profiles have the
same form, so they merge again. Counts, moments and extremes are those of the whole table, but for rounding. Distinct counts
have a standard error of 1.6 %, ranks of quantiles an error of 0.7 % as a rule, whatever the number of batches.

Defined cases: an empty batch adds nothing; a column without values has no moments and no quantiles; NaN makes the moments NaN and
is no value of the quantiles; a column that some batches lack is profiled by the others' rows; columns that are not numbers
have counts, nulls and distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabforge.operators.stats import col, numeric_columns, quoted

#: Sizes of the sketches: binary logarithm of the cells for distinct values, and the quantiles' k.
CELLS, KEPT = 12, 400
_MOMENTS = ("mean", "m2", "m3", "m4")


def _fields(c: str, number: bool) -> Column:
    """The profile of a column of one batch. m2 to m4 are sums of powers of the distance to the mean."""
    x, kept = F.col(c).cast("double"), F.count(c)
    m2 = F.var_pop(x) * kept
    spread = F.stddev_pop(x)
    constant = F.when(kept > 0, F.when(spread.isNotNull() & (spread == 0), 0.0))  # skewness and kurtosis of a constant are undefined
    moments = [F.avg(x), m2, F.coalesce(constant, F.skewness(x) * spread * m2), F.coalesce(constant, (F.kurtosis(x) + 3) * m2 * m2 / kept)]
    none = F.lit(None).cast("double")
    ends = [F.min(x), F.max(x)] if number else [none, none]
    sketch = F.when(F.count_if(x.isNotNull() & ~F.isnan(x)) > 0, F.kll_sketch_agg_double(F.when(~F.isnan(x), x), KEPT)) if number else F.lit(None).cast("binary")
    return F.struct(
        F.count("*").alias("rows"), kept.alias("n"), *[(m if number else none).alias(k) for k, m in zip(_MOMENTS, moments)], ends[0].alias("min"), ends[1].alias("max"),
        F.hll_sketch_agg(F.col(c).cast("string"), CELLS).alias("values"), sketch.alias("ranks"),
    )


def batch(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, column and its profile, one row a column and batch: a batch is df, or the rows that agree in `by`. One aggregation of all columns."""
    columns = [c for c in df.columns if c not in by] if columns is None else list(columns)
    if not columns:
        raise ValueError("no columns to profile")
    numbers = set(numeric_columns(df))
    one = df.groupBy(*map(quoted, by)).agg(*[_fields(quoted(c), c in numbers).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("p")) for i, c in enumerate(columns)]))
    return one.select(*map(col, by), rows.alias("r")).select(*map(col, by), "r.column", "r.p.*")


def merged(profiles: DataFrame) -> DataFrame:
    """One row a column, of the form of `batch`, from the rows of many batches. The means, a row a column, are broadcast; the sketches are united before the shuffle."""
    some = F.col("n") > 0  # a batch without values of a column has no mean and adds nothing
    means = profiles.where(some).groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_mean"))
    d, n = F.col("mean") - F.col("_mean"), F.col("n")
    moved = [F.sum(F.col("m2") + n * d**2), F.sum(F.col("m3") + 3 * d * F.col("m2") + n * d**3), F.sum(F.col("m4") + 4 * d * F.col("m3") + 6 * d**2 * F.col("m2") + n * d**4)]
    return profiles.join(F.broadcast(means), "column", "left").groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max("_mean").alias("mean"), *[m.alias(k) for k, m in zip(_MOMENTS[1:], moved)],
        F.min("min").alias("min"), F.max("max").alias("max"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def read(profiles: DataFrame) -> DataFrame:
    """The profile table of merged rows: column, n, nulls, distinct, mean, std, skewness, min, q25, q50, q75 and max. distinct and the quartiles are estimates."""
    n = F.col("n").cast("double")
    sketch = F.when(F.col("mean").isNotNull() & (F.kll_sketch_get_n_double("ranks") > 0), F.col("ranks"))
    quartiles = [F.kll_sketch_get_quantile_double(sketch, F.lit(p)).alias(k) for k, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return profiles.select(
        "column", "n", (F.col("rows") - F.col("n")).alias("nulls"), F.hll_sketch_estimate("values").alias("distinct"), "mean",
        F.when(n > 1, F.sqrt(F.try_divide("m2", n - 1))).alias("std"), F.when(n > 0, F.try_divide(F.col("m3") / n, F.pow(F.col("m2") / n, F.lit(1.5)))).alias("skewness"),
        "min", *quartiles, "max",
    )


def keep(df: DataFrame, path: str, name: str, columns: Sequence[str] | None = None) -> str:
    """Writes df's profile as the batch of that name; the same name again replaces it, so a repeated batch counts once."""
    batch(df, columns).write.mode("overwrite").parquet(f"{path}/batch={name}")
    return path


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The profile table of all batches kept below path."""
    return read(merged(spark.read.parquet(path).drop("batch")))


def keep_stream(stream: DataFrame, path: str, checkpoint: str, columns: Sequence[str] | None = None) -> StreamingQuery:
    """Keeps a profile of every micro-batch at hand, then ends; one stream a path. A batch that is run again after a failure replaces its own profile."""
    return stream.writeStream.foreachBatch(lambda df, i: keep(df, path, f"stream-{i}", columns) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
