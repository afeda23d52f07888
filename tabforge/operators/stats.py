"""Shared statistics: one wide aggregate for all columns, one histogram of values, and the keyed order of rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Beyond about this many expressions generated code gets too long to be compiled, so wide aggregates are cut.
WIDE = 42


def quoted(c: str) -> str:
    """A column's name as Spark's parser takes it: in backticks where it holds dots, spaces or marks."""
    return c if re.fullmatch(r"\w+", c) or (len(c) > 1 and c[0] == c[-1] == "`") else "`" + c.replace("`", "``") + "`"


def col(c: str) -> Column:
    return F.col(quoted(c))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every other column, dates and booleans included."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NumericType) and f.name not in exclude]


def wide_row(df: DataFrame, expressions: dict[str, Column]) -> dict:
    """Values of many aggregates, in as few passes as generated code allows."""
    names, out = list(expressions), {}
    for a in range(0, len(names), WIDE):
        part = names[a : a + WIDE]
        out |= dict(zip(part, df.agg(*[expressions[n].alias(f"_{i}") for i, n in enumerate(part)]).first()))
    return out


def per_column(df: DataFrame, columns: Sequence[str], fields: dict) -> DataFrame:
    """One row a column from one aggregation job: column, and each field's aggregate of that column.

    fields: name to a function of the column's name, quoted where it must be, that gives an aggregate. No columns give no rows.
    """
    if not columns:
        none = df.sparkSession.createDataFrame([], "c string").agg(*[f("c").alias(n) for n, f in fields.items()])
        return none.select(F.lit("").alias("column"), *fields).where("false")
    one = df.agg(*[f(quoted(c)).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in fields.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in fields]) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _unpivoted(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """column and value of each column's values as one type."""
    return df.select(*[col(c).cast(kind).alias(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "value")


def value_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value (as text, null for null) and n: one shuffle, pre-aggregated, for all columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    return _unpivoted(df, columns, "string").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, distinct (nulls are no value) and n (rows). Whole numbers, other numbers and the rest are unpivoted apart, so numbers need not become text."""
    kinds = dict(df.dtypes)
    whole = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    real = [c for c in columns if kinds[c] in ("float", "double")]
    out = None
    for group, kind in ((whole, "bigint"), (real, "double"), ([c for c in columns if c not in whole and c not in real], "string")):
        if group:
            part = _unpivoted(df, group, kind).groupBy("column", "value").agg(F.count("*").alias("n")).groupBy("column").agg(F.count("value").alias("distinct"), F.sum("n").alias("n"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, distinct long, n long")


def order_key(df_columns: Sequence[str], seed: int) -> Column:
    """A repeatable random order: MD5 of the key columns and the seed."""
    return F.md5(F.concat_ws("|", *[col(c).cast("string") for c in df_columns], F.lit(str(seed))))


def running_before(df: DataFrame, value: Column, key: str, group: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of its group that come before in the order of key (text of hexadecimal digits, like an MD5).

    A group is cut into 4096 parts by the key's first digits; the parts' sums (4096 a group at most, joined by group and
    part, as the rows are dealt already) give each part what lies before it, so no task orders a whole group.
    """
    cut = df.withColumn("_v", value).withColumn("_p", F.substring(key, 1, 3))
    sums = cut.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.sum("_v").alias("_n"))
    sums = sums.select("_g", "_q", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy(group, "_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = cut.withColumn("_inside", inside).join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(out))


def as_dict(rows: DataFrame, key: str = "column") -> dict:
    """A small per-column table on the driver."""
    return {r[key]: r.asDict() for r in rows.collect()}


#: Steps into which a pass cuts the values of each bracket, and the accuracy of the sketch that finds them.
STEPS, ACCURACY = 512, 1500
#: Distinct values of a bracket that are brought to the driver.
BRACKET_VALUES = 15_000


class _Bracket:
    """Values from low to high (None: no bound) of column number c, among which the order statistics `places` lie."""

    def __init__(self, c: int, places: list[int], low: float | None = None, high: float | None = None):
        self.c, self.places, self.low, self.high = c, places, low, high

    def inside(self, x: Column) -> Column:
        least = F.lit(True) if self.low is None else x >= self.low
        return least & (F.lit(True) if self.high is None else x <= self.high)

    def cut(self, below: int, n: int, grid: list[float]) -> list[_Bracket]:
        """Brackets of the places by the grid of a pass, a step wider on either side than the sketch's error asks for."""
        out: list[_Bracket] = []
        for k in self.places:
            i, j = (k - below) * STEPS // n - 1, -(-(k - below + 1) * STEPS // n) + 1
            one = _Bracket(self.c, [k], self.low if i <= 0 else grid[i], self.high if j >= STEPS else grid[j])
            if out and (one.low is None or out[-1].high is None or one.low <= out[-1].high):
                out[-1] = _Bracket(self.c, [*out[-1].places, k], out[-1].low, one.high)
            else:
                out.append(one)
        return out


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], most: int = BRACKET_VALUES) -> dict[str, list[float] | None]:
    """Exact quantiles (linear interpolation) by column; None for a column without values.

    A pass counts the values below and inside each bracket of every column and sketches those inside; the sketch narrows
    each bracket to a few of STEPS parts. Once brackets hold at most `most` values (as a rule after one pass, after two
    beyond 1,200,000 rows, after three beyond 160,000,000), one more pass counts those values, which are ordered on the
    driver. Memory is bounded whatever the table, and the number of passes does not depend on the number of columns.
    """
    x = [col(c).cast("double") for c in columns]
    open_, closed, size = [_Bracket(i, []) for i in range(len(columns))], [], {}
    while open_:
        fields = []
        for b in open_:
            inside = b.inside(x[b.c])
            fields += [F.count_if(x[b.c] < (float("-inf") if b.low is None else b.low)), F.count_if(inside & x[b.c].isNotNull()), F.percentile_approx(F.when(inside, x[b.c]), [i / STEPS for i in range(STEPS + 1)], ACCURACY)]
        row = df.agg(*[f.alias(f"_{i}") for i, f in enumerate(fields)]).first()
        cut = []
        for i, b in enumerate(open_):
            below, n, grid = row[3 * i : 3 * i + 3]
            if b.c not in size:
                size[b.c] = n
                b.places = sorted({k for p in probabilities for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))}) if n else []
            if n:
                parts = [b] if n <= most else b.cut(below, n, grid)
                for q in parts:
                    # done if few values are left, or one, or if both ends are values of so many rows that no part is narrower
                    done = n <= most or (len(q.places) + 4) * n // STEPS <= most or (q.low, q.high) == (b.low, b.high) or (q.low is not None and q.low == q.high)
                    (closed if done else cut).append(q)
        open_ = cut
    values = _bracket_values(df, x, closed)
    out: dict[str, list[float] | None] = {}
    for i, c in enumerate(columns):
        n, out[c] = size[i], [] if size[i] else None
        for p in probabilities if n else []:
            k, part = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
            low, high = values[i, k], values[i, min(k + 1, n - 1)]
            out[c].append(low + part * (high - low) if high != low else low)
    return out


def _bracket_values(df: DataFrame, x: Sequence[Column], brackets: Sequence[_Bracket]) -> dict[tuple[int, int], float]:
    """The order statistics of the brackets, by column number and place; one histogram of the values inside and of the gaps between."""
    by: dict[int, list[_Bracket]] = {}
    for b in sorted(brackets, key=lambda b: (b.low is not None, b.low)):
        by.setdefault(b.c, []).append(b)
    if not by:
        return {}
    cells = []
    for c, own in by.items():
        gap, value = F.when(x[c].isNull(), F.lit(None).cast("int")), F.lit(None).cast("double")
        for i, b in enumerate(own):
            if b.low is not None:
                gap = gap.when(x[c] < b.low, 2 * i)
            gap = gap.when(b.inside(x[c]), 2 * i + 1)
        for b in own:
            value = F.when(b.inside(x[c]), x[c]).otherwise(value)
        cells.append(F.struct(F.lit(c).alias("c"), gap.alias("g"), value.alias("v")))
    found = df.select(F.explode(F.array(*cells)).alias("s")).where("s.g is not null").groupBy("s.c", "s.g", "s.v").count().collect()
    out: dict[tuple[int, int], float] = {}
    for c, own in by.items():
        wanted, seen = sorted(k for b in own for k in b.places), 0
        for r in sorted((r for r in found if r["c"] == c), key=lambda r: (r["g"], r["v"] != r["v"], r["v"] or 0.0)):
            while wanted and seen + r["count"] > wanted[0]:
                if r["v"] is None:
                    raise ValueError("the values changed between passes")
                out[c, wanted.pop(0)] = r["v"]
            seen += r["count"]
    return out
