"""Sources and sinks: Parquet and CSV tables, the derived views of the test tables, and a scratch folder."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Views over the test tables, in SQL that Spark and DuckDB both accept.
VIEWS = {
    "dirty_customer": """
SELECT c_custkey,
  CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS acctbal,
  CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment)
       WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
       WHEN c_custkey % 4 = 2 THEN concat('  ', c_mktsegment, '$ ')
       ELSE c_mktsegment END AS segment,
  c_nationkey AS nation, c_nationkey AS nation_copy, 7 AS const_col,
  CASE WHEN c_custkey % 100 = 0 THEN 'rare' ELSE 'common' END AS near_const,
  CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE NULL END AS mostly_null,
  CASE WHEN c_custkey % 10 = 9 THEN 'n/a' ELSE concat('$', CAST(c_custkey * 3 AS STRING)) END AS num_text,
  CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag_text,
  concat('2024-', lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')) AS date_text,
  CASE WHEN c_acctbal >= 4500 THEN 1 ELSE 0 END AS label
FROM {customer}""",
    "clf_lineitem": """
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax, l_linestatus, l_returnflag AS target
FROM {lineitem}""",
    "scored_binary": """
SELECT event_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS y,
  CASE WHEN value + (CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END) > 20 THEN 1 ELSE 0 END AS y_pred,
  (value + (CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END)) / (value + 40) AS p1
FROM {events}""",
    "scored_multi": """
SELECT event_id, CAST(event_id % 3 AS INT) AS y,
  CAST((event_id + CASE WHEN value > 30 THEN 1 ELSE 0 END) % 3 AS INT) AS y_pred,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS p0,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0.375 END AS DOUBLE) AS p1,
  CAST(CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE 0.375 END AS DOUBLE) AS p2
FROM {events}""",
    "doc_labels": """
SELECT d.doc_id, d.lang, d.source, d.n_chars,
  length(d.text) - length(replace(d.text, ' ', '')) AS n_spaces, l.quality, l.toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}
BASES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view of a test folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASES if "{" + b + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def view_sql(name: str) -> str:
    """The view's text for DuckDB."""
    return VIEWS[name].format(**{b: b for b in BASES}).replace("AS STRING", "AS VARCHAR")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the cluster shares. Where that is unset, a new temporary one if Spark runs in this process alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
    return folder or "file://" + tempfile.mkdtemp(prefix="tabforge-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there on; nothing stays in the executors' memory."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark))
    return df.checkpoint()


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV table with a header; without a schema the types are inferred, which reads the file once more. Only .csv paths are taken."""
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError("only .csv files are read")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> str:
    """One stage's output; no index column."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)
    return path


def write_json(state: dict, spark: SparkSession, path: str) -> str:
    """Fitted state as one JSON row, by Spark's writer, so any store works."""
    spark.createDataFrame([(json.dumps(state, default=str),)], "state string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
