"""Fitted transforms: imputing, capping, power transforms, scaling, encoding, target coding.

Every handler is fitted on the table as it comes in, not on the previous handler's output, so all statistics come from a
few shared aggregate jobs. Applying all of them is one projection. Order: drop ids, drop repeated rows (train only), impute,
cap, power, scale, encode, target, target last.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions import power
from tabforge.operators.stats import as_dict, categorical_columns, col, numeric_columns, per_column, quantiles, quoted


def impute_values(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, object]:
    """Fill value by column. mean and median of numbers; the mode (least on ties) of others; constant is 0."""
    numbers = numeric_columns(df)
    if method == "constant":
        return {c: 0.0 if c in numbers else "0" for c in columns}
    if method not in ("mean", "median", "mode"):
        raise ValueError(f"unknown method {method}")
    out: dict[str, object] = {}
    plain = [c for c in columns if c in numbers and method != "mode"]
    if plain:
        out |= {c: r["v"] for c, r in as_dict(per_column(df, plain, {"v": lambda c: F.avg(c)})).items()} if method == "mean" else {c: q[0] if q else None for c, q in quantiles(df, plain, [0.5]).items()}
    for c in (c for c in columns if c not in plain):
        r = df.where(col(c).isNotNull()).groupBy(quoted(c)).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), quoted(c)).limit(1).collect()
        out[c] = r[0][0] if r else None
    return out


def imputed(c: str, value, numeric_mean: bool = False) -> Column:
    return F.coalesce(col(c).cast("double") if numeric_mean else col(c), F.lit(value))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=[quoted(c) for c in columns] if columns else None)


def caps(df: DataFrame, columns: Sequence[str], method: str = "IQR") -> dict[str, tuple[float, float]]:
    """Limits: quartiles and 1.5 interquartile ranges, or three sample deviations around the mean."""
    if method == "IQR":
        return {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quantiles(df, columns, [0.25, 0.75]).items() if q}
    if method == "Z-Score":
        rows = as_dict(per_column(df, columns, {"m": lambda c: F.avg(c), "s": lambda c: F.stddev_samp(c)}))
        return {c: (r["m"] - 3 * (r["s"] or 0.0), r["m"] + 3 * (r["s"] or 0.0)) for c, r in rows.items() if r["m"] is not None}
    raise ValueError(f"unknown method {method}")


def capped(c: Column, limits: tuple[float, float]) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c.cast("double"), F.lit(limits[1])), F.lit(limits[0])))


def scale_values(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, tuple[float, float]]:
    """Centre and width by column; a width of zero counts as one."""
    if method == "standard":
        rows = as_dict(per_column(df, columns, {"a": lambda c: F.avg(c), "b": lambda c: F.stddev_pop(c)}))
        pairs = {c: (r["a"], r["b"]) for c, r in rows.items()}
    elif method == "robust":
        pairs = {c: (q[1], q[2] - q[0]) if q else (None, None) for c, q in quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    elif method == "minmax":
        rows = as_dict(per_column(df, columns, {"a": lambda c: F.min(c).cast("double"), "b": lambda c: F.max(c).cast("double")}))
        pairs = {c: (r["a"], None if r["a"] is None else r["b"] - r["a"]) for c, r in rows.items()}
    else:
        raise ValueError(f"unknown method {method}")
    return {c: (a, b or 1.0) for c, (a, b) in pairs.items() if a is not None}


def scaled(c: Column, values: tuple[float, float]) -> Column:
    return (c - F.lit(values[0])) / F.lit(values[1])


MAX_VOCABULARY = 1000


def vocabulary(df: DataFrame, c: str, most: int = MAX_VOCABULARY) -> list:
    """Sorted values with null last, if there is one. More than `most` values are refused: such a column needs a sparse encoding (StringIndexer and OneHotEncoder)."""
    values = [r[0] for r in df.select(quoted(c)).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{c} has more than {most} values")
    return sorted(v for v in values if v is not None) + ([None] if None in values else [])


def one_hot(c: str, values: Sequence, kind: str = "double", drop_first: bool = False) -> list[Column]:
    return [F.when(col(c).eqNullSafe(F.lit(v)), 1).otherwise(0).cast(kind).alias(f"{c}_{'nan' if v is None else v}") for v in values[1 if drop_first else 0 :]]


def label_code(c: str, values: Sequence) -> Column:
    """Place in sorted order; an unseen value raises an error."""
    codes = F.create_map(*[x for i, v in enumerate(v for v in values if v is not None) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(codes[col(c)], F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.coalesce(col(c).cast("string"), F.lit("null")))).cast("int"))


def number_target(c: str) -> Column:
    """The target as a number; nulls, before or after, raise an error."""
    return F.coalesce(col(c).try_cast("double"), F.raise_error(F.lit(f"null or text in the target {c}")).cast("double"))


def target_last(df: DataFrame, target: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c != target], quoted(target))


def features_and_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(quoted(target))


@dataclass
class Preprocessing:
    """What is to be done (methods and columns) and, after fit, the values found (state)."""

    target: str
    ids: list[str] = field(default_factory=list)
    dedupe: bool = True
    missing: str | None = None
    missing_columns: list[str] = field(default_factory=list)
    outliers: str | None = None
    outlier_columns: list[str] = field(default_factory=list)
    skewed: str | None = None
    skewed_columns: list[str] = field(default_factory=list)
    scaling: str | None = None
    scaled_columns: list[str] = field(default_factory=list)
    encoding: str | None = None
    encoded_columns: list[str] = field(default_factory=list)
    drop_first: bool = False
    state: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Preprocessing:
        out = lambda cols: [c for c in cols if c != self.target and c in df.columns]
        s: dict = {"target_text": dict(df.dtypes)[self.target] == "string"}
        if self.missing and self.missing != "drop":
            s["fill"] = impute_values(df, out(self.missing_columns), self.missing)
        if self.outliers:
            s["caps"] = caps(df, out(self.outlier_columns), self.outliers)
        if self.skewed:
            s["power"] = power.fit(df, out(self.skewed_columns), self.skewed)
        if self.scaling:
            s["scale"] = scale_values(df, out(self.scaled_columns), self.scaling)
        if self.encoding:
            s["values"] = {c: vocabulary(df, c) for c in out(self.encoded_columns)}
        if s["target_text"]:
            s["classes"] = vocabulary(df, self.target)
            if None in s["classes"]:
                raise ValueError("the target has nulls")
        self.state = s
        return self

    def transform(self, df: DataFrame, train: bool = False) -> DataFrame:
        s, out = self.state, df.drop(*self.ids)
        if train and self.dedupe:
            out = out.dropDuplicates()
        if self.missing == "drop":
            out = drop_null_rows(out, [c for c in self.missing_columns if c in out.columns])
        numbers = numeric_columns(out)
        steps: list[dict[str, Column]] = [{c: imputed(c, v, c in numbers and self.missing in ("mean", "median")) for c, v in s.get("fill", {}).items() if v is not None}]
        steps.append({c: capped(col(c), v) for c, v in s.get("caps", {}).items()})
        steps.append({c: power.transformed(col(c), v) for c, v in s.get("power", {}).items()})
        steps.append({c: scaled(col(c), v) for c, v in s.get("scale", {}).items()})
        for step in steps:
            out = out.withColumns(step) if step else out
        if self.encoding == "label":
            out = out.withColumns({c: label_code(c, v) for c, v in s["values"].items()})
        elif self.encoding:
            more = [e for c, v in s["values"].items() for e in one_hot(c, v, "int" if self.encoding == "dummies" else "double", self.drop_first)]
            out = out.select(*[quoted(c) for c in out.columns if c not in s["values"]], *more)
        if self.target in out.columns:
            out = out.withColumn(self.target, label_code(self.target, s["classes"]) if s["target_text"] else number_target(self.target))
            out = target_last(out, self.target)
        return out

    def config(self) -> dict:
        return asdict(self)


def run(train: DataFrame, test: DataFrame | None, plan: Preprocessing) -> tuple[DataFrame, DataFrame | None, dict]:
    """The stage: fitted on train; repeated rows go from train only."""
    plan.fit(train)
    return plan.transform(train, train=True), None if test is None else plan.transform(test), plan.config()


def default_plan(df: DataFrame, target: str, ids: Sequence[str] = ()) -> Preprocessing:
    """Median or mode for nulls, caps by quartiles, standard scale and one-hot codes for all columns but ids and target."""
    numbers = [c for c in numeric_columns(df) if c not in ids and c != target]
    texts = [c for c in categorical_columns(df) if c not in ids and c != target]
    return Preprocessing(target, list(ids), True, "median", numbers + texts, "IQR", numbers, None, [], "standard", numbers, "onehot", texts)
