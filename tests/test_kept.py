"""Kept profiles: merged batches against the whole table."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import kept


def rows(n=6000):
    rng = random.Random(8)
    return [(i, i % 7, None if i % 10 == 0 else 1e6 + rng.expovariate(0.01), 4.0, None if i % 3 else f"v{i % 500}", None) for i in range(n)]


SCHEMA = "id long, g int, `x.y` double, same double, t string, none double"


def held(spark, table):
    """What a profile must say of the rows above."""
    x = np.array([r[2] for r in rows() if r[2] is not None])
    got = {r["column"]: r for r in table.collect()}
    assert set(got) == {"id", "x.y", "same", "t", "none"} | ({"g"} & set(got))
    r = got["x.y"]
    assert (r["n"], r["nulls"], r["min"], r["max"]) == (len(x), 6000 - len(x), x.min(), x.max())
    assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["std"] == pytest.approx(x.std(ddof=1), rel=1e-9)
    assert r["skewness"] == pytest.approx(((x - x.mean()) ** 3).mean() / x.std() ** 3, rel=1e-6)
    for p in (25, 50, 75):
        assert abs((x <= r[f"q{p}"]).mean() - p / 100) < 0.02
    assert abs(got["id"]["distinct"] / 6000 - 1) < 0.06 and abs(got["t"]["distinct"] / 500 - 1) < 0.06
    assert (got["t"]["n"], got["t"]["nulls"], got["t"]["mean"], got["t"]["q50"]) == (2000, 4000, None, None)
    assert (got["same"]["std"], got["same"]["skewness"], got["same"]["q50"], got["same"]["distinct"]) == (0.0, None, 4.0, 1)
    assert tuple(got["none"][k] for k in ("n", "nulls", "distinct", "mean", "std", "min", "q25", "max")) == (0, 6000, 0, None, None, None, None, None)


def test_merged_batches_are_the_whole(spark):
    df = spark.createDataFrame(rows(), SCHEMA).cache()
    held(spark, kept.read(kept.batch(df, by=["g"]).where("false").unionByName(kept.batch(df.drop("g")).withColumn("g", F.lit(0))).drop("g")))
    parts = kept.batch(df, by=["g"])
    assert parts.count() == 7 * 5
    held(spark, kept.read(kept.merged(parts)))
    # profiles of profiles
    some = kept.merged(parts.where("g < 3").drop("g")).unionByName(kept.merged(parts.where("g >= 3").drop("g")))
    held(spark, kept.read(kept.merged(some)))


def test_kept_batches_and_streams(spark, tmp_path):
    """Batches kept twice count once; an empty one adds nothing; a stream's micro-batches add up."""
    df = spark.createDataFrame(rows(), SCHEMA).cache()
    for i in (0, 1, 2, 1):
        kept.keep(df.where(F.col("id") % 3 == i), f"{tmp_path}/a", f"part-{i}")
    kept.keep(df.limit(0), f"{tmp_path}/a", "empty")
    held(spark, kept.kept(spark, f"{tmp_path}/a"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept.keep_stream(stream, f"{tmp_path}/b", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/b").select("batch").distinct().count() == 4
    held(spark, kept.kept(spark, f"{tmp_path}/b"))


def test_undefined_numbers(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "a double")
    r = kept.read(kept.merged(kept.batch(df))).first()
    assert r["n"] == 3 and math.isnan(r["mean"]) and r["q25"] in (1.0, 2.0)
    empty = kept.read(kept.merged(kept.batch(df.limit(0)))).first()
    assert (empty["n"], empty["nulls"], empty["mean"], empty["q50"]) == (0, 0, None, None)
    with pytest.raises(ValueError, match="no columns"):
        kept.batch(df, [])
