"""Queries of the profile, of splits and of sources."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from tabforge.operators import kept
from tabforge.operators import profile as P
from tabforge.operators import split as D
from tabforge.operators.preprocess import features_and_target, target_last
from tabforge.plans.catalogue import register
from tabforge.plans.support import NUMBERS, TEXTS, rounded, union, with_view
from tabforge.sources.tables import read_csv, scratch_dir, table, write_json, write_table, read_json

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_describe = lambda t, cols, q=True: union([f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {t}" for c in cols])


@register("profile_columns", union([f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{'numeric' if c in NUMBERS['lineitem'] else 'categorical'}' AS kind, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", " + (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max" if c in NUMBERS["lineitem"] else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS max") + " FROM lineitem" for i, c in enumerate(LINE, 1)]))
def profile_columns(spark, d):
    return rounded(P.profile_columns(table(spark, d, "lineitem")), 4)


@register("profile_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def profile_shape(spark, d):
    return P.shape(table(spark, d, "lineitem"))


@register("preview_topk", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def preview_topk(spark, d):
    return P.preview(table(spark, d, "orders"), ["o_orderkey"])


_DIRTY = ["c_custkey", "acctbal", "segment", "nation", "nation_copy", "const_col", "near_const", "mostly_null", "num_text", "flag_text", "date_text", "label"]


@register("profile_schema", with_view("dirty_customer", union([f"SELECT '{c}' AS \"column\", CAST({i} AS INTEGER) AS position, '{'numeric' if c in NUMBERS['dirty_customer'] else 'categorical'}' AS kind, count(*) - count({c}) AS nulls FROM dirty_customer" for i, c in enumerate(_DIRTY, 1) if c != "label"])))
def profile_schema(spark, d):
    return P.schema_table(table(spark, d, "dirty_customer"), exclude=["label"])


@register("profile_nulls", with_view("dirty_customer", union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(*) > count({c}) AS has_nulls FROM dirty_customer" for c in _DIRTY])))
def profile_nulls(spark, d):
    return rounded(P.nulls(table(spark, d, "dirty_customer")))


@register("profile_describe", _describe("lineitem", NUMBERS["lineitem"]))
def profile_describe(spark, d):
    return rounded(P.describe(table(spark, d, "lineitem")))


@register("profile_distinct", union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", round(count(DISTINCT {c}) / count(*), 6) AS ratio FROM events" for c in NUMBERS["events"] + TEXTS["events"]]))
def profile_distinct(spark, d):
    return rounded(P.distinct_ratio(table(spark, d, "events")))


def _id_sql(t):
    rows = union([f"SELECT '{c}' AS \"column\", {'true' if c in NUMBERS[t] else 'false'} AS num, count(DISTINCT {c}) / count(*) AS ratio, (count(*) - count({c})) * 100.0 / count(*) AS null_pct FROM {t}" for c in NUMBERS[t] + TEXTS[t]])
    return f"WITH s AS ({rows}), h AS (SELECT *, regexp_matches(lower(\"column\"), 'id|key|code|uuid|guid') AS hinted FROM s), i AS (SELECT *, null_pct <= 5 AND CASE WHEN num THEN ratio > 0.9 AND hinted ELSE ratio > 0.9 OR (ratio > 0.5 AND hinted) END AS is_id FROM h) "


@register("profile_ids", _id_sql("customer") + 'SELECT "column", round(ratio, 6) AS ratio, round(null_pct, 6) AS null_pct, hinted, is_id FROM i')
def profile_ids(spark, d):
    return rounded(P.identifiers(table(spark, d, "customer")))


@register("profile_types", _id_sql("events") + "SELECT \"column\", CASE WHEN is_id THEN 'id' WHEN num THEN 'numeric' ELSE 'categorical' END AS kind FROM i")
def profile_types(spark, d):
    return P.column_types(table(spark, d, "events"))


@register("profile_skew", "WITH s AS (" + union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) / count(*) AS ratio, skewness({c}) AS s FROM lineitem" for c in NUMBERS["lineitem"]]) + ') SELECT "column", round(s, 6) AS skewness, coalesce(abs(s) > 0.5, false) AS skewed FROM s WHERE ratio <= 0.9')
def profile_skew(spark, d):
    return rounded(P.skew(table(spark, d, "lineitem")))


@register("profile_skew_map", "WITH s AS (" + union([f"SELECT '{c}' AS \"column\", skewness({c}) AS s FROM events" for c in NUMBERS["events"]]) + ') SELECT "column", round(s, 6) AS skewness FROM s WHERE abs(s) > 0.5')
def profile_skew_map(spark, d):
    return rounded(P.skew_map(table(spark, d, "events"), NUMBERS["events"]))


@register("profile_normality", "WITH m AS (" + union([f"SELECT '{c}' AS \"column\", count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS s, kurtosis_pop({c}) AS k FROM events" for c in NUMBERS["events"]]) + '), j AS (SELECT "column", n / 6 * (s * s + k * k / 4) AS jb FROM m) SELECT "column", round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 4) AS p_value FROM j')
def profile_normality(spark, d):
    return rounded(P.normality(table(spark, d, "events")), 4)


_FENCE = "SELECT '{c}' AS \"column\", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b, count(DISTINCT {c}) / count(*) AS ratio FROM {t}"


@register("profile_outliers", "WITH q AS (" + union([_FENCE.format(c=c, t="lineitem") for c in NUMBERS["lineitem"]]) + '), f AS (SELECT "column", a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q WHERE ratio <= 0.9) ' + union([f"SELECT f.\"column\", round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (WHERE l.{c} < low OR l.{c} > high) AS outliers FROM f, lineitem l WHERE f.\"column\" = '{c}' GROUP BY ALL" for c in NUMBERS["lineitem"]]))
def profile_outliers(spark, d):
    return rounded(P.outliers(table(spark, d, "lineitem")))


def _corr(t, cols):
    return union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM {t}" for a, b in combinations(cols, 2)])


@register("corr_matrix", "WITH c AS (" + _corr("lineitem", NUMBERS["lineitem"]) + ") SELECT col_a, col_b, round(r, 6) AS r FROM c")
def corr_matrix(spark, d):
    return rounded(P.correlations(table(spark, d, "lineitem")))


_WITH_CONSTANT = "SELECT l_quantity, 5.0::DOUBLE AS always, l_discount, CASE WHEN l_linenumber > 3 THEN 1.0::DOUBLE END AS \"once.or null\", l_tax FROM lineitem"


@register("corr_constant", f"WITH t AS ({_WITH_CONSTANT}), c AS (" + union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, " + (f'corr("{a}", "{b}") AS r FROM t' if not {a, b} & {"always", "once.or null"} else "CAST(NULL AS DOUBLE) AS r") for a, b in combinations(["l_quantity", "always", "l_discount", "once.or null", "l_tax"], 2)]) + ") SELECT col_a, col_b, round(r, 6) AS r FROM c")
def corr_constant(spark, d):
    """Constant columns, and a name that must be quoted."""
    df = table(spark, d, "lineitem").select("l_quantity", F.lit(5.0).alias("always"), "l_discount", F.when(F.col("l_linenumber") > 3, 1.0).alias("once.or null"), "l_tax")
    return rounded(P.correlations(df))


_DC = ["c_custkey", "acctbal", "nation", "nation_copy", "mostly_null", "label"]


@register("corr_map_065", with_view("dirty_customer", "WITH c AS (" + _corr("dirty_customer", _DC) + '), s AS (SELECT * FROM c WHERE abs(r) > 0.65) SELECT col_a AS "column", col_b AS other, round(r, 6) AS r FROM s UNION ALL SELECT col_b, col_a, round(r, 6) FROM s'))
def corr_map_065(spark, d):
    return rounded(P.correlation_map(table(spark, d, "dirty_customer").select(*_DC)))


@register("corr_pairs_095", with_view("dirty_customer", "WITH c AS (" + _corr("dirty_customer", _DC) + ") SELECT col_a, col_b, round(r, 6) AS r FROM c WHERE abs(r) > 0.95"))
def corr_pairs_095(spark, d):
    return rounded(P.correlation_pairs(table(spark, d, "dirty_customer").select(*_DC)))


@register("profile_histogram", union([f"(WITH e AS (SELECT min({c}) AS a, max({c}) AS b FROM {t}) SELECT '{c}' AS \"column\", CAST(least(floor((CAST({c} AS DOUBLE) - a) / (b - a) * 10) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM {t}, e WHERE {c} IS NOT NULL GROUP BY ALL)" for c, t in (("l_quantity", "lineitem"), ("l_discount", "lineitem"), ("l_tax", "lineitem"))]))
def profile_histogram(spark, d):
    return P.histogram(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@register("profile_boxplot", union([f"(WITH q AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {t}) SELECT '{c}' AS \"column\", round(CAST(min({c}) FILTER (WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS DOUBLE), 6) AS whisker_low, round(a, 6) AS q25, round(m, 6) AS q50, round(b, 6) AS q75, round(CAST(max({c}) FILTER (WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS DOUBLE), 6) AS whisker_high FROM {t}, q GROUP BY a, m, b)" for c, t in (("value", "events"), ("user_id", "events"))]))
def profile_boxplot(spark, d):
    return rounded(P.box_plot(table(spark, d, "events"), ["value", "user_id"]))


@register("class_distribution", with_view("clf_lineitem", "SELECT target AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clf_lineitem GROUP BY target"))
def class_distribution(spark, d):
    return rounded(P.class_distribution(table(spark, d, "clf_lineitem"), "target"))


@register("duplicate_rows", "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, sum(n - 1) > 0 AS has_duplicates FROM g")
def duplicate_rows(spark, d):
    return P.duplicate_rows(table(spark, d, "events").select("user_id", "event_type"))


@register("feature_store")
def feature_store(spark, d):
    """The lists of columns by property, written to the profile sink and read back."""
    lists = P.feature_lists(table(spark, d, "events"), "event_type")
    back = read_json(spark, write_json(lists, spark, f"{scratch_dir(spark)}/feature_store-{id(lists)}"))
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else v) for k, v in back.items()], "property string, columns string")


_MONTHS = "substring(CAST(l_shipdate AS STRING), 1, 7)"
_kept_sql = union([f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max FROM lineitem" for c in NUMBERS["lineitem"]])


def _kept(spark, d, columns):
    """The lines' profiles by month, kept in the shared folder and merged from there."""
    months = kept.batch(table(spark, d, "lineitem").withColumn("month", F.expr(_MONTHS)), columns, ["month"])
    path = write_table(months, f"{scratch_dir(spark)}/kept-{uuid.uuid4().hex}")
    return kept.read(kept.merged(spark.read.parquet(path)))


@register("profile_kept", _kept_sql)
def profile_kept(spark, d):
    """Counts, moments and extremes of the numbers, merged from the months' profiles."""
    return rounded(_kept(spark, d, NUMBERS["lineitem"]).select("column", "n", "nulls", "mean", "std", "min", "max"), 2)


@register("profile_sketches")
def profile_sketches(spark, d):
    """Estimates of the distinct values and quartiles of every column, merged from the months' sketches."""
    return _kept(spark, d, None).select("column", "n", "distinct", "q25", "q50", "q75")


@register("split_random", "WITH k AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '42'))) AS r, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM k")
def split_random(spark, d):
    return D.split_random(table(spark, d, "events"), ["event_id"]).select("event_id", "split")


@register("split_stratified", "WITH k AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '42'))) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, CASE WHEN r <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM k")
def split_stratified(spark, d):
    return D.train_test_split(table(spark, d, "events"), "event_type", ["event_id"]).select("event_id", "event_type", "split")


@register("sample_k", "SELECT event_id, value FROM events ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')) LIMIT 1000")
def sample_k(spark, d):
    return D.sample_rows(table(spark, d, "events"), ["event_id"], 1000).select("event_id", "value")


@register("csv_source", "SELECT count(*) AS n, round(sum(c_acctbal), 4) AS total, CAST(max(c_custkey) AS BIGINT) AS top FROM customer")
def csv_source(spark, d):
    """customer written as CSV, read back with inferred types."""
    path = write_table(table(spark, d, "customer"), f"{scratch_dir(spark)}/customer-{id(spark)}.csv", "csv")
    return read_csv(spark, path).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("total"), F.max("c_custkey").cast("bigint").alias("top"))


@register("table_sink")
def table_sink(spark, d):
    path = write_table(table(spark, d, "dirty_customer"), f"{scratch_dir(spark)}/stage-{id(spark)}.parquet")
    return spark.read.parquet(path)


@register("feature_target_split", with_view("clf_lineitem", "SELECT target, count(*) AS n FROM clf_lineitem GROUP BY target"))
def feature_target_split(spark, d):
    return features_and_target(table(spark, d, "clf_lineitem"), "target")[1].groupBy("target").agg(F.count("*").alias("n"))


@register("target_last", with_view("dirty_customer", "SELECT c_custkey, acctbal, segment, nation, nation_copy, const_col, near_const, mostly_null, num_text, date_text, label, flag_text FROM dirty_customer"))
def target_last_query(spark, d):
    return target_last(table(spark, d, "dirty_customer"), "flag_text")
