"""Cleaning: nine rules in fixed order, fitted once and frozen as a plan that any table of the same columns can be put through.

The plan is plain data (JSON). Applying it is one projection and one filter. The target is left alone unless asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.stats import as_dict, col, distinct_counts, numeric_columns, per_column, quoted, value_histogram

# Thresholds, words for yes and no, and date patterns (Spark's letters) in order of trial.
HIGH_NULL, NEAR_CONSTANT, HALF, PARSED, CASE_VALUES, LONG_TEXT = 0.6, 0.98, 0.5, 0.8, (2, 100), 100
TRUE, FALSE = ["yes", "y", "true", "t", "1", "on"], ["no", "n", "false", "f", "0", "off"]
PATTERNS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyyMMdd"]
SHAPES = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{4}/\d{2}/\d{2}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{2}-\d{2}-\d{4}$", r"^\d{8}$"]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"(?U)[^\w\s.,;:!?()-]"


@dataclass
class CleanPlan:
    """drop: column to reason; strings: columns to clean; cases: column to {lower value: kept value}; types: column to kind; dates: column to pattern; row_share: most nulls of a row."""

    drop: dict[str, str] = field(default_factory=dict)
    strings: list[str] = field(default_factory=list)
    cases: dict[str, dict[str, str]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    dates: dict[str, str] = field(default_factory=dict)
    row_share: float = HALF
    lowercase: bool = True

    def state(self) -> dict:
        return asdict(self)


def _shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    rows = as_dict(per_column(df, columns, {"nulls": lambda c: F.count_if(col(c).isNull()), "n": lambda c: F.count("*")}))
    return {c: r["nulls"] / r["n"] if r["n"] else 0.0 for c, r in rows.items()}


def _facts(df: DataFrame) -> dict[str, dict]:
    """By column, from one histogram of values: n rows, full values, distinct ones, top (rows of the commonest) and the share of nulls."""
    has = F.col("value").isNotNull()
    fields = {"n": F.sum("n"), "full": F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)), "distinct": F.count("value"), "top": F.coalesce(F.max(F.when(has, F.col("n"))), F.lit(0))}
    rows = as_dict(value_histogram(df, df.columns).groupBy("column").agg(*[e.alias(k) for k, e in fields.items()]))
    none = {"n": 0, "full": 0, "distinct": 0, "top": 0}
    return {c: (r := rows.get(c, none)) | {"nulls": 1 - r["full"] / r["n"] if r["n"] else 0.0} for c in df.columns}


def high_null_columns(df: DataFrame, keep: Sequence[str] = (), most: float = HIGH_NULL) -> list[str]:
    return [c for c, s in _shares(df, df.columns).items() if s > most and c not in keep]


def constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    rows = as_dict(distinct_counts(df, df.columns))
    return [c for c in df.columns if c not in keep and rows.get(c, {"distinct": 0})["distinct"] <= 1]


def near_constant_columns(df: DataFrame, keep: Sequence[str] = (), most: float = NEAR_CONSTANT) -> list[str]:
    """Columns whose commonest value has more than `most` of the values; those with more than half nulls are passed over."""
    rows = value_histogram(df, df.columns).groupBy("column").agg(F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("full"), F.sum("n").alias("n")).collect()
    return [c for c in df.columns for r in rows if r["column"] == c and c not in keep and r["full"] and r["full"] >= HALF * r["n"] and r["top"] > most * r["full"]]


def duplicate_columns(df: DataFrame, keep: Sequence[str] = ()) -> dict[str, str]:
    """Each column that equals an earlier one of its type at every row, with that one. Pairs are pruned by nulls, extremes and a hash sum, then compared exactly in one pass."""
    columns = [c for c in df.columns if c not in keep]
    kinds = dict(df.dtypes)
    text = lambda c: col(c).cast("string")
    rows = as_dict(per_column(df, columns, {"nulls": lambda c: F.count_if(col(c).isNull()), "low": lambda c: F.min(text(c)), "high": lambda c: F.max(text(c)), "sum": lambda c: F.sum(F.xxhash64(c).cast("decimal(38,0)"))}))
    alike = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if kinds[a] == kinds[b] and all(rows[a][k] == rows[b][k] for k in ("nulls", "low", "high", "sum"))]
    if not alike:
        return {}
    same = df.agg(*[F.bool_and(col(a).eqNullSafe(col(b))).alias(f"p{i}") for i, (a, b) in enumerate(alike)]).first()
    out: dict[str, str] = {}
    for i, (a, b) in enumerate(alike):
        if same[f"p{i}"] and a not in out:
            out.setdefault(b, a)
    return out


def cleaned_string(c: Column, lowercase: bool = True) -> Column:
    """Stripped of white space at both ends, lower case, without special characters, in this order."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(c) if lowercase else c, SPECIAL, "")


def text_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Text columns with at most half nulls."""
    texts = [c for c, t in df.dtypes if t == "string" and c not in keep]
    return [c for c, s in _shares(df, texts).items() if s <= HALF] if texts else []


def case_maps(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, str]]:
    """For each column with 2 to 100 values, the commonest spelling of each value that has several (ties: the least)."""
    if not columns:
        return {}
    counts = value_histogram(df, columns).where("value is not null")
    few = counts.groupBy("column").agg(F.count("*").alias("d")).where(F.col("d").between(*CASE_VALUES)).select("column")
    low = F.lower("value")
    best = counts.join(F.broadcast(few), "column").withColumn("low", low).withColumn("r", F.row_number().over(Window.partitionBy("column", "low").orderBy(F.desc("n"), "value"))).withColumn("spellings", F.count("*").over(Window.partitionBy("column", "low")))
    out: dict[str, dict[str, str]] = {}
    for r in best.where("r = 1 and spellings > 1").collect():  # at most 100 values a column
        out.setdefault(r["column"], {})[r["low"]] = r["value"]
    return out


def with_case(c: str, mapping: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return F.coalesce(pairs[F.lower(col(c))], col(c))


def as_number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c)).try_cast("double")


def as_date(c: Column, i: int) -> Column:
    """Timestamp by the i-th pattern; null where the text does not have its shape."""
    return F.try_to_timestamp(F.when(c.rlike(SHAPES[i]), c), F.lit(PATTERNS[i]))


def text_types(df: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None) -> dict[str, str]:
    """integer, double, date or boolean for the text columns that are to be converted."""
    columns = text_columns(df, keep) if columns is None else columns
    rows = as_dict(per_column(df, columns, {
        "n": lambda c: F.count("*"),
        "long": lambda c: F.max(F.length(c)),
        "numbers": lambda c: F.count(as_number(col(c))),
        "whole": lambda c: F.count_if(as_number(col(c)) == F.floor(as_number(col(c)))),
        "dates": lambda c: F.count(F.coalesce(*[as_date(col(c), i) for i in range(len(PATTERNS))])),
        "flags": lambda c: F.count_if(F.lower(c).isin(TRUE + FALSE)),
    }))
    out = {}
    for c, r in rows.items():
        if not r["n"] or (r["long"] or 0) > LONG_TEXT:
            continue
        if r["numbers"] > PARSED * r["n"]:
            out[c] = "integer" if r["whole"] == r["n"] else "double"
        elif r["dates"] > PARSED * r["n"]:
            out[c] = "date"
        elif r["flags"] == r["n"]:
            out[c] = "boolean"
    return out


def converted(c: Column, kind: str) -> Column:
    if kind in ("integer", "double"):
        return as_number(c).cast("bigint") if kind == "integer" else as_number(c)
    if kind == "boolean":
        return F.lower(c).isin(TRUE)
    return F.coalesce(*[as_date(c, i) for i in range(len(PATTERNS))])


def date_patterns(df: DataFrame, keep: Sequence[str] = ()) -> dict[str, str]:
    """First pattern that more than 80 % of a text column's values have, all rows tested; 'timestamp' for date and time columns."""
    out = {c: "timestamp" for c, t in df.dtypes if t in ("timestamp", "date", "timestamp_ntz") and c not in keep}
    texts = [c for c, t in df.dtypes if t == "string" and c not in keep]
    fields = {"n": lambda c: F.count(c)} | {f"p{i}": lambda c, i=i: F.count(as_date(col(c), i)) for i in range(len(PATTERNS))}
    for c, r in (as_dict(per_column(df, texts, fields)) if texts else {}).items():
        hit = next((i for i in range(len(PATTERNS)) if r["n"] and r[f"p{i}"] > PARSED * r["n"]), None)
        if hit is not None:
            out[c] = PATTERNS[hit]
    return out


def standard_date(c: Column, pattern: str) -> Column:
    """yyyy-MM-dd text."""
    return F.date_format(c if pattern == "timestamp" else as_date(c, PATTERNS.index(pattern)), "yyyy-MM-dd")


def full_rows(df: DataFrame, most: float = HALF) -> DataFrame:
    """Rows whose share of nulls is not above most."""
    empty = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(empty <= most * len(df.columns))


def fit(df: DataFrame, ids: Sequence[str] = (), target: str | None = None, touch_target: bool = False, lowercase: bool = True) -> CleanPlan:
    """Decides every rule on df. ids and the target keep their columns and values."""
    keep = [*ids] + ([target] if target and not touch_target else [])
    plan = CleanPlan(lowercase=lowercase)
    facts = _facts(df)  # rules 1 to 3 and the shares of nulls, which no later rule changes
    rules = {"high_null": lambda r: r["nulls"] > HIGH_NULL, "constant": lambda r: r["distinct"] <= 1, "near_constant": lambda r: r["full"] and r["full"] >= HALF * r["n"] and r["top"] > NEAR_CONSTANT * r["full"]}
    for c in (c for c in df.columns if c not in keep):
        reason = next((k for k, holds in rules.items() if holds(facts[c])), None)
        if reason:
            plan.drop[c] = reason
    now = df.drop(*plan.drop)
    gone = duplicate_columns(now, keep)
    plan.drop |= {c: f"duplicate of {of}" for c, of in gone.items()}
    now = now.drop(*gone)
    plan.strings = [c for c, t in now.dtypes if t == "string" and c not in keep and facts[c]["nulls"] <= HALF]
    now = now.withColumns({c: cleaned_string(col(c), lowercase) for c in plan.strings}) if plan.strings else now
    plan.cases = case_maps(now, plan.strings)
    now = now.withColumns({c: with_case(c, m) for c, m in plan.cases.items()}) if plan.cases else now
    plan.types = text_types(now, keep, plan.strings)
    now = now.withColumns({c: converted(col(c), k) for c, k in plan.types.items()}) if plan.types else now
    plan.dates = date_patterns(now, keep)
    return plan


def apply(df: DataFrame, plan: CleanPlan, drop_rows: bool = True) -> DataFrame:
    """One projection for all rules, then the row filter, if rows are to go."""
    out = df.drop(*plan.drop)
    for step in (
        {c: cleaned_string(col(c), plan.lowercase) for c in plan.strings},
        {c: with_case(c, m) for c, m in plan.cases.items()},
        {c: converted(col(c), k) for c, k in plan.types.items()},
        {c: standard_date(col(c), p) for c, p in plan.dates.items()},
    ):
        step = {c: e for c, e in step.items() if c in out.columns}
        out = out.withColumns(step) if step else out
    return full_rows(out, plan.row_share) if drop_rows else out


def report(df: DataFrame, plan: CleanPlan) -> DataFrame:
    """column, action and detail of each change, and rows before and after."""
    rows = [(c, "dropped", r) for c, r in plan.drop.items()] + [(c, "string_cleaning", "") for c in plan.strings] + [(c, "case", str(len(m))) for c, m in plan.cases.items()] + [(c, "converted", k) for c, k in plan.types.items()] + [(c, "date_standardization", p) for c, p in plan.dates.items()]
    spark = df.sparkSession
    changes = spark.createDataFrame(rows, "column string, action string, detail string")
    counts = df.agg(F.count("*").cast("string").alias("detail")).select(F.lit("*").alias("column"), F.lit("rows_before").alias("action"), "detail")
    after = apply(df, plan).agg(F.count("*").cast("string").alias("detail")).select(F.lit("*").alias("column"), F.lit("rows_after").alias("action"), "detail")
    return changes.unionByName(counts).unionByName(after)


def run(train: DataFrame, test: DataFrame | None = None, ids: Sequence[str] = (), target: str | None = None) -> tuple[DataFrame, DataFrame | None, CleanPlan]:
    """The stage: fitted on train, frozen, applied to both."""
    plan = fit(train, ids, target)
    return apply(train, plan), None if test is None else apply(test, plan), plan
