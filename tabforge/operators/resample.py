"""Resampling of imbalanced classes: SMOTE, Tomek links, edited nearest neighbours and ADASYN.

Rows are id (long), x (array of double) and label (text); classes are few. Synthetic rows are numbered downwards from below
zero and the smallest id, in the order of their seeds' MD5; the neighbour and the step between two rows come from MD5, too,
so a run can be repeated on any cluster. What cannot be made raises an error, or, where ADASYN's rule asks for no rows of a class, a warning.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabforge.operators.knn import knn
from tabforge.operators.stats import running_before
from tabforge.sources.tables import checkpointed

NEIGHBOURS = 5


def _digits(*parts: Column) -> Column:
    """An integer in [0, 2**32) from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def _synthetic(rows: DataFrame, quota: DataFrame, k: int, within: bool = True) -> DataFrame:
    """quota: id and n, how many rows to make from it; the neighbours are of its own class."""
    least = rows.agg(F.least(F.min("id"), F.lit(0))).first()[0] or 0
    numbered = running_before(quota.where("n > 0").withColumn("_key", F.md5(F.col("id").cast("string"))).withColumn("_all", F.lit(0)), F.col("n"), "_key", "_all", "before")
    seeds = rows.join(numbered.select("id", "n", "before"), "id")
    near = knn(seeds.select("id", "x", F.col("label").alias("g")), rows.select("id", "x", F.col("label").alias("g")), k, within=True)
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    made = seeds.join(lists, "id").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    pick = F.pmod(_digits(F.col("id"), F.col("j"), F.lit("n")), F.size("near"))
    made = made.select("before", "j", "x", "label", F.get("near", pick.cast("int"))["neighbour"].alias("neighbour"), (_digits(F.col("id"), F.col("j"), F.lit("u")) / F.lit(4294967296.0)).alias("u"))
    other = rows.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    mixed = made.join(other, "neighbour")
    return mixed.select((F.lit(least).cast("long") - F.col("before").cast("long") - F.col("j")).alias("id"), "x", "y", "u", "label").select("id", F.transform(F.arrays_zip("x", "y"), lambda p: p["x"] + F.col("u") * (p["y"] - p["x"])).alias("x"), "label")


def _class_sizes(rows: DataFrame) -> DataFrame:
    """label, size and most (the largest class's size): one row a class. A class of one row, which has no neighbour, raises an error, as do null labels, points and ids and ids that repeat."""
    bad = rows.agg(F.count_if(F.col("id").isNull() | F.col("x").isNull() | F.col("label").isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} rows without id, point or label")
    twice = rows.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the id {twice[0]['id']} repeats")
    sizes = rows.groupBy("label").agg(F.count("*").alias("size"))
    single = sizes.where("size = 1").limit(1).collect()
    if single and rows.select("label").distinct().limit(2).count() > 1:
        raise ValueError(f"the class {single[0]['label']} has one row, which has no neighbour of its class")
    return sizes.withColumn("most", F.max("size").over(Window.partitionBy()))


def smote(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """rows and synthetic ones, so that every class has the size of the largest.

    Each row of a class makes the whole share of what is missing; the rest falls to the rows of the least MD5.
    """
    ranked = rows.join(_class_sizes(rows), "label").where("size < most")
    edges = running_before(ranked.withColumn("_key", F.md5(F.col("id").cast("string"))), F.lit(1), "_key", "label", "r")
    gap = F.col("most") - F.col("size")
    quota = edges.select("id", (F.floor(gap / F.col("size")) + (F.col("r") < gap % F.col("size")).cast("int")).alias("n"))
    return rows.select("id", "x", "label").unionByName(_synthetic(rows, quota, k))


def tomek_links(rows: DataFrame) -> DataFrame:
    """id of both members of each mutual nearest pair of different classes."""
    first = knn(rows, rows, 1).select("id", "neighbour")
    labels = rows.select("id", "label")
    pairs = first.join(labels, "id").join(labels.select(F.col("id").alias("neighbour"), F.col("label").alias("other")), "neighbour").where("label <> other").select("id", "neighbour")
    back = pairs.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    return pairs.join(back, ["id", "neighbour"], "left_semi").select("id").distinct()


def remove_tomek(rows: DataFrame) -> DataFrame:
    return rows.join(tomek_links(rows), "id", "left_anti")


def edited(rows: DataFrame, k: int = 3) -> DataFrame:
    """Rows whose k nearest neighbours are all of their class."""
    labels = rows.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    bad = knn(rows, rows, k).join(rows.select("id", "label"), "id").join(labels, "neighbour").where("label <> other").select("id").distinct()
    return rows.join(bad, "id", "left_anti")


def smote_tomek(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    return remove_tomek(checkpointed(smote(rows, k)))


def smote_enn(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    return edited(checkpointed(smote(rows, k)))


def adasyn(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """rows and synthetic ones: a smaller class gets what it lacks, each row in proportion to the share of other classes among its k neighbours."""
    small = rows.join(_class_sizes(rows), "label").where("size < most")
    labels = rows.select(F.col("id").alias("neighbour"), F.col("label").alias("other"))
    hard = knn(small.select("id", "x"), rows, k).join(labels, "neighbour").join(small.select("id", "label", "size", "most"), "id")
    share = hard.groupBy("id", "label", "size", "most").agg(F.avg((F.col("label") != F.col("other")).cast("double")).alias("share"))
    total = checkpointed(share.groupBy("label").agg(F.sum("share").alias("total")))
    if easy := [r["label"] for r in total.where("total = 0").collect()]:
        warnings.warn(f"nothing is made of the classes {easy}: none of their rows has a neighbour of another class", stacklevel=2)
    quota = share.join(total, "label").select("id", F.coalesce(F.floor(F.try_divide(F.col("share"), F.col("total")) * (F.col("most") - F.col("size")) + 0.5), F.lit(0)).alias("n"))
    return rows.select("id", "x", "label").unionByName(_synthetic(rows, quota, k))


METHODS = {"smote": smote, "smote_tomek": smote_tomek, "smote_enn": smote_enn, "adasyn": adasyn, "tomek": remove_tomek, "enn": edited}


def resampled(df: DataFrame, key: str, columns: list[str], target: str, method: str) -> DataFrame:
    """key, columns and target of the resampled table; synthetic rows have negative keys. Null features count as 0."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    kind = dict(df.dtypes)[target]
    rows = df.select(F.col(key).cast("long").alias("id"), F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]).alias("x"), F.col(target).cast("string").alias("label"))
    out = METHODS[method](rows)
    return out.select(F.col("id").alias(key), *[F.col("x")[i].alias(c) for i, c in enumerate(columns)], F.col("label").cast(kind).alias(target))
