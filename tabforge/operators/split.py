"""Repeatable splits and samples, by the MD5 of a key and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.stats import col, order_key, quoted
from tabforge.sources.tables import checkpointed

SEED, TEST_SHARE = 42, 0.2
FEW_KEYS = 1000
#: Digits of a key, and classes whose edges are broadcast.
KEY_DIGITS, FEW_CLASSES = 32, 10_000


def split_random(df: DataFrame, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """df with split (train or test): the ceil(share * n) rows of the least keys are the test rows; rows of one key stay together.

    No global order: the edge is found digit by digit, from 4096 prefix counts a pass, until its prefix has few keys. Of
    rows that share the key at the edge none is taken if not all fit.
    """
    keyed = df.withColumn("_key", order_key(key, seed))
    n = math.ceil(test_share * keyed.count())
    before, edge = 0, ""
    while len(edge) < 30:
        prefix = F.substring("_key", 1, len(edge) + 3)
        counts = keyed.where(F.col("_key").startswith(edge)).groupBy(prefix.alias("p")).count().orderBy("p").collect()
        for r in counts:
            if before + r["count"] > n:
                edge, left = r["p"], r["count"]
                break
            before += r["count"]
        else:
            return keyed.withColumn("split", F.lit("test" if n else "train")).drop("_key")
        if left <= FEW_KEYS:
            break
    last = edge
    for r in keyed.where(F.col("_key").startswith(edge)).groupBy("_key").count().orderBy("_key").limit(FEW_KEYS).collect():
        before += r["count"]
        if before > n:
            break
        last = r["_key"]
    return keyed.withColumn("split", F.when(F.col("_key") <= last, "test").otherwise("train")).drop("_key")


def _edges(counts: DataFrame) -> DataFrame:
    """_class, _want, _edge (the first prefix with which a class has more than _want rows; null if all fit), its rows _n and the rows _before it."""
    so_far = F.col("_before") + F.sum("_n").over(Window.partitionBy("_class").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("_far") > F.col("_want"), F.struct("_p", "_n", (F.col("_far") - F.col("_n")).alias("_b"))))
    found = counts.withColumn("_far", so_far).groupBy("_class", "_want").agg(first.alias("_e"))
    return found.select("_class", "_want", F.col("_e._p").alias("_edge"), F.col("_e._n").alias("_n"), F.col("_e._b").alias("_before"))


def split_stratified(df: DataFrame, target: str, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """df with split: in each class (nulls are one) the ceil(share * n) rows of the least keys are the test rows; rows of one key stay together.

    No row is ranked: counts of 4096 key prefixes a class, pass by pass, find the prefix in which each class's edge lies,
    until all those have few rows; then whole keys are counted, and a filter parts the rows. The edges stay a
    table, which is broadcast for FEW_CLASSES classes at most. Of rows that share the key at the edge none is taken if not
    all fit.
    """
    keyed = df.withColumn("_key", order_key(key, seed)).withColumn("_class", col(target))
    counts = keyed.groupBy("_class", F.substring("_key", 1, 3).alias("_p")).agg(F.count("*").alias("_n"))
    want = F.ceil(F.sum("_n").over(Window.partitionBy("_class")) * test_share)
    edges, digits = checkpointed(_edges(counts.withColumn("_want", want).withColumn("_before", F.lit(0)))), 3
    few = edges.count() <= FEW_CLASSES

    def met(rows: DataFrame) -> DataFrame:
        side = edges.withColumnRenamed("_class", "_c")
        return rows.join(F.broadcast(side) if few else side, F.col("_class").eqNullSafe(F.col("_c")))

    while digits < KEY_DIGITS:
        most = edges.agg(F.max("_n")).first()[0]
        if most is None:
            break
        longer = digits + 3 if most > FEW_KEYS and digits < 30 else KEY_DIGITS
        inside = met(keyed).where(F.substring("_key", 1, digits) == F.col("_edge")).groupBy("_class", "_want", "_before", F.substring("_key", 1, longer).alias("_p"))
        rest = edges.where("_edge is null")
        edges, digits = checkpointed(_edges(inside.agg(F.count("*").alias("_n"))).unionByName(rest)), longer
    fits = F.col("_edge").isNull() | (F.col("_key") < F.col("_edge"))
    return met(keyed).select(*map(quoted, df.columns), F.when(fits, "test").otherwise("train").alias("split"))


def train_test_split(df: DataFrame, target: str, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Stratified if the target is not numeric or has fewer than 10 values, else random."""
    numeric = dict(df.dtypes)[target] not in ("string", "boolean", "date", "timestamp")
    few = df.select(quoted(target)).distinct().limit(10).count() < 10
    return split_stratified(df, target, key, test_share, seed) if few or not numeric else split_random(df, key, test_share, seed)


def sample_rows(df: DataFrame, key: Sequence[str], k: int, seed: int = SEED) -> DataFrame:
    """k rows without replacement: the least keys."""
    return df.withColumn("_key", order_key(key, seed)).orderBy("_key").limit(k).drop("_key")
