"""Tables as users bring them, through every operator on whole tables: no text, no numbers, constants, dotted names, one row, none."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import chain, clean, evaluate, features, preprocess, resample, split
from tabforge.operators import knn as K
from tabforge.operators import profile as P


def _table(spark, name):
    n = 40
    rows = {
        "numbers": ([(i, math.sin(i) * 10, float(i % 7), i % 2) for i in range(n)], "id long, x double, z double, label int"),
        "continuous": ([(math.sin(i), math.cos(i * 1.7), i % 2) for i in range(n)], "x double, z double, label int"),
        "texts": ([(f"a{i}", "yes" if i % 3 else "no", "p" if i % 2 else "q") for i in range(n)], "name string, flag string, label string"),
        "constants": ([(i, 1.0, "k", None, i % 2) for i in range(n)], "id long, x double, t string, e double, label int"),
        "dropped": ([(1.0, "k", i % 2) for i in range(n)], "x double, t string, label int"),
        "dotted": ([(i, math.sin(i), i % 5 * 1.0, "u" if i % 3 else "v", i % 2) for i in range(n)], "`row.id` long, `a.b` double, `c d` double, `t.x` string, label int"),
        "one_row": ([(1, 2.0, "x", 1)], "id long, x double, t string, label int"),
        "none": ([], "id long, x double, t string, label int"),
    }[name]
    return spark.createDataFrame(*rows)


TABLES = ["numbers", "continuous", "texts", "constants", "dropped", "dotted", "one_row", "none"]


@pytest.mark.parametrize("name", TABLES)
def test_profile(spark, name):
    df = _table(spark, name)
    n, numbers = df.count(), P.numeric_columns(df)
    assert [r["n_rows"] for r in P.shape(df).collect()] == [n]
    assert {r["column"] for r in P.profile_columns(df).collect()} == {r["column"] for r in P.schema_table(df).collect()} == set(df.columns)
    assert len(P.describe(df).collect()) == len(P.normality(df).collect()) == len(numbers)
    for rows in (P.column_types(df), P.skew(df), P.skew_map(df, numbers), P.outliers(df), P.correlation_map(df), P.histogram(df, numbers), P.box_plot(df, numbers), P.class_distribution(df, "label"), P.duplicate_rows(df)):
        rows.collect()


@pytest.mark.parametrize("name", TABLES)
def test_clean(spark, name):
    df = _table(spark, name)
    plan = clean.fit(df, target="label")
    out = clean.apply(df, plan)
    assert "label" in out.columns and out.count() <= df.count()
    assert clean.report(df, plan).count() >= 2
    for rule in (clean.high_null_columns, clean.constant_columns, clean.near_constant_columns, clean.text_types):
        rule(df)


@pytest.mark.parametrize("name", ["continuous", "constants", "dotted", "one_row", "none"])
def test_preprocess_and_features(spark, name):
    df = _table(spark, name)
    plan = preprocess.default_plan(df, "label")
    out = preprocess.run(df, df, plan)[1]
    assert out.columns[-1] == "label" and out.count() == df.count()
    features.prepared(df).collect()
    numbers = [c for c in P.numeric_columns(df) if c != "label"]
    assert features.generate(df, numbers, ["label"], "label").count() == df.count()
    assert features.variance_ranking(df, 5).count() <= 5
    features.run(df, df, "label", 3)[0].collect()
    parts = split.train_test_split(df, "label", df.columns[:1])
    assert parts.count() == df.count()


@pytest.mark.parametrize("name", ["numbers", "texts", "dotted"])
def test_chain(spark, name):
    df = _table(spark, name)
    fitted = chain.fit(df, "label", [c for c in df.columns if c in ("id", "row.id")], "decision_tree", {"max_depth": 2}, 3)
    assert fitted.score(df).count() == df.count()


def test_correlations_by_numpy(spark):
    """Pairwise complete, with constants, far means, NaN, infinity and pairs without common rows; one job whatever the columns."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 7)) * [1, 5, 1e-3, 1, 1, 1, 1] + [0, 1e6, 0, 0, 0, 0, 0]
    x[:, 3] = 0.1
    x[:, 4] = x[:, 0] * 2 + rng.normal(size=300) * 0.1
    gap = rng.random((300, 7)) < 0.2
    gap[:, 5], gap[:, 6] = np.arange(300) >= 150, np.arange(300) < 150
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gap)]
    df = spark.createDataFrame(rows, ", ".join(f"`c.{i}` double" for i in range(7))).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlations(df).collect()}
    assert len(got) == 21
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~gap[:, i] & ~gap[:, j]
            r = got[f"c.{i}", f"c.{j}"]
            if 3 in (i, j) or not both.any():
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    odd = spark.createDataFrame([(1.0, float("nan"), 2.0, 1.0), (2.0, 1.0, float("inf"), 3.0), (3.0, 2.0, 1.0, 5.0)], "a double, b double, c double, d double")
    found = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlations(odd).collect()}
    assert found["a", "d"] == pytest.approx(1.0) and all(math.isnan(found[k]) for k in found if k != ("a", "d"))


def test_correlations_of_many_columns_are_one_job(spark, monkeypatch):
    wide = spark.range(200).select(*[F.rand(i).alias(f"c{i}") for i in range(300)])
    group = "correlations-of-many-columns"
    spark.sparkContext.setJobGroup(group, group)
    n = P.correlations(wide).where("r is not null").count()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == 300 * 299 // 2 and len(jobs) <= 3  # with adaptive execution each shuffle is a job of its own
    small = spark.range(50).select(*[F.rand(i).alias(f"c{i}") for i in range(9)])
    whole = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlations(small).collect()}
    monkeypatch.setattr(P, "CORRELATED_COLUMNS", 4)
    parts = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlations(small).collect()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)
