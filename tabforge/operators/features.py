"""Generated features and feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators import attribution, models
from tabforge.operators.preprocess import impute_values
from tabforge.operators.resample import resampled
from tabforge.operators.stats import col, numeric_columns, per_column, quoted
from tabforge.sources.tables import checkpointed

MOST_FEATURES, MOST_CLASSES, IMPORTANCE_ROWS = 5000, 100, 2000


def identity(df: DataFrame) -> DataFrame:
    return df


def pairwise(columns: Sequence[str], target: str | None = None, strict_names: bool = False, most: int = MOST_FEATURES) -> dict[str, Column]:
    """Name and expression of the originals and of a + b, a * b and a - b of each pair and a / b of each ordered pair.

    strict_names drops every feature whose name contains the target's; otherwise only an exact match is dropped. The number
    grows with the square of the columns and is refused beyond `most`.
    """
    if len(columns) + 5 * len(columns) * (len(columns) - 1) // 2 > most:
        raise ValueError(f"more than {most} features; choose columns first")
    out: dict[str, Column] = {c: col(c).cast("double") for c in columns}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = col(a).cast("double"), col(b).cast("double")
            out |= {f"{a} + {b}": x + y, f"{a} * {b}": x * y, f"{a} - {b}": x - y, f"{a} / {b}": F.try_divide(x, y), f"{b} / {a}": F.try_divide(y, x)}
    return {n: e for n, e in out.items() if not target or (target not in n if strict_names else n != target)}


def filled(e: Column) -> Column:
    """Infinite, undefined and null values become 0."""
    return F.when(e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")), F.lit(0.0)).otherwise(e)


def generate(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), target: str | None = None, strict_names: bool = False) -> DataFrame:
    """keep and all features, in one projection."""
    return df.select(*map(quoted, keep), *[filled(e).alias(n) for n, e in pairwise(columns, target, strict_names).items()])


def prepared(df: DataFrame) -> DataFrame:
    """For selection: infinite numbers count as null, null numbers become the median, null texts the mode or 'unknown'."""
    numbers = numeric_columns(df)
    finite = {c: F.when(~F.isnan(col(c).cast("double")) & (F.abs(col(c).cast("double")) != float("inf")), col(c)) for c in numbers}
    df = df.withColumns(finite) if finite else df
    others = [c for c in df.columns if c not in numbers]
    fill = impute_values(df, numbers, "median") | {c: v if v is not None else "unknown" for c, v in impute_values(df, others, "mode").items()}
    return df.withColumns({c: F.coalesce(col(c).cast("double") if c in numbers else col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def variance_ranking(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """feature, importance (sample variance) and rank of the n most varying columns; ties by name."""
    from pyspark.sql import Window

    rows = per_column(df, numeric_columns(df) if columns is None else columns, {"importance": lambda c: F.var_samp(c)}).where("importance is not null")
    order = Window.orderBy(F.desc("importance"), "column")  # one row a column
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(F.col("column").alias("feature"), "importance", "rank")


def importance_ranking(df: DataFrame, target: str, n: int, columns: Sequence[str], rows: int = IMPORTANCE_ROWS, attributed: bool = False) -> DataFrame:
    """feature, importance and rank by a forest that predicts the target; where it finds nothing by a linear model, else by variance.

    attributed takes the mean size of the forest's exact attributions over all rows instead of its impurity importance.

    The models are fitted on at most `rows` rows, those of the least hash over all columns. The variance ranks, too, where there is nothing to classify: one class, or more than MOST_CLASSES.
    """
    classes = sorted(r[0] for r in df.select(quoted(target)).where(col(target).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect())
    if 1 < len(classes) <= MOST_CLASSES and columns:
        code = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target)) - 1
        known = df.where(col(target).isNotNull()).select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)], code.alias("_label"))
        chosen = known.orderBy(F.xxhash64(*known.columns), *known.columns[:1]).limit(rows)
        table = checkpointed(models.assembled(chosen, [f"_{i}" for i in range(len(columns))], "_label"))
        every = models.assembled(known.na.fill(0.0), [f"_{i}" for i in range(len(columns))], "_label")
        by_forest = lambda: attribution.importance(every, columns, models.fit(table, "random_forest"), n) if attributed else models.forest_importance(table, columns, n)
        for rank in (by_forest, lambda: models.linear_importance(table, columns).where(F.col("rank") <= n)):
            found = rank()
            if found.where("importance > 0").take(1):
                return found
    return variance_ranking(df, n, columns)


def project(df: DataFrame, selected: Sequence[str], n: int = 20, keep: Sequence[str] = ()) -> DataFrame:
    """The selected columns that exist; if none does, the first n."""
    there = [c for c in selected if c in df.columns]
    return df.select(*map(quoted, keep), *[col(c) for c in there or [c for c in df.columns if c not in keep][:n]])


def run(train: DataFrame, test: DataFrame | None, target: str, n: int = 20, keep: Sequence[str] = (), make: bool = True, resampling: str | None = None, ranking: str = "importance") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The stage: resample train (or not; the first of keep is its key), generate (or not), rank on train by importance, attribution or variance, project both."""
    if ranking not in ("importance", "attribution", "variance"):
        raise ValueError(f"unknown ranking {ranking}")
    columns = [c for c in numeric_columns(train) if c != target and c not in keep]
    if resampling:
        keep = list(keep[:1])
        train = resampled(train, keep[0], columns, target, resampling)
    shape = lambda df: generate(df, columns, [*keep, target], target) if make else df.select(*map(quoted, [*keep, target, *columns]))
    made = shape(train)
    names = [c for c in made.columns if c != target and c not in keep]
    ranked = variance_ranking(made, n, names) if ranking == "variance" else importance_ranking(made, target, n, names, attributed=ranking == "attribution")
    names = [r["feature"] for r in ranked.orderBy("rank").collect()]
    return project(made, names, n, [*keep, target]), None if test is None else project(shape(test), names, n, [*keep, target]), ranked
