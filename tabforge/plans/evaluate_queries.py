"""Queries of metrics and of features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabforge.operators import evaluate as E
from tabforge.operators import features as X
from tabforge.plans.catalogue import register
from tabforge.plans.support import rounded, union, with_view
from tabforge.sources.tables import table

multi = lambda body: with_view("scored_multi", body)
binary = lambda body: with_view("scored_binary", body)
P3 = {0: "p0", 1: "p1", 2: "p2"}
_CLASSES = """WITH c AS (SELECT DISTINCT y AS c FROM {v} UNION SELECT DISTINCT y_pred FROM {v}),
k AS (SELECT c, (SELECT count(*) FROM {v} WHERE y = c AND y_pred = c) AS tp, (SELECT count(*) FROM {v} WHERE y_pred = c) AS pr, (SELECT count(*) FROM {v} WHERE y = c) AS su FROM c),
m AS (SELECT *, CASE WHEN pr = 0 THEN 0 ELSE tp / pr END AS p, CASE WHEN su = 0 THEN 0 ELSE tp / su END AS r, CASE WHEN pr + su = 0 THEN 0 ELSE 2 * tp / (pr + su) END AS f FROM k) """


@register("confusion", multi("WITH c AS (SELECT DISTINCT y AS c FROM scored_multi UNION SELECT DISTINCT y_pred FROM scored_multi) SELECT a.c AS y, b.c AS y_pred, count(s.event_id) AS n FROM c a CROSS JOIN c b LEFT JOIN scored_multi s ON s.y = a.c AND s.y_pred = b.c GROUP BY a.c, b.c"))
def confusion(spark, d):
    return E.confusion(table(spark, d, "scored_multi"))


_LABEL = _CLASSES.format(v="scored_multi") + ", t AS (SELECT sum(tp) AS c, sum(su) AS s, sum(pr * su) AS pt, sum(pr * pr) AS pp, sum(su * su) AS tt, avg(CASE WHEN su > 0 THEN r END) AS bal, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(p * su) / sum(su) AS wp, sum(r * su) / sum(su) AS wr, sum(f * su) / sum(su) AS wf FROM m) "


@register("label_metrics", multi(_LABEL + union([f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM t" for n, e in {"accuracy": "c / s", "balanced_accuracy": "bal", "mcc": "(CAST(c AS DOUBLE) * s - pt) / sqrt((CAST(s AS DOUBLE) * s - pp) * (CAST(s AS DOUBLE) * s - tt))", "kappa": "(c / s - pt / (CAST(s AS DOUBLE) * s)) / (1 - pt / (CAST(s AS DOUBLE) * s))", "macro_precision": "mp", "macro_recall": "mr", "macro_f1": "mf", "weighted_precision": "wp", "weighted_recall": "wr", "weighted_f1": "wf"}.items()])))
def label_metrics(spark, d):
    return rounded(E.label_metrics(table(spark, d, "scored_multi")))


@register("binary_metrics", binary("WITH c AS (SELECT CAST(count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS fn, CAST(count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS DOUBLE) AS tn FROM scored_binary) " + union([f"SELECT '{n}' AS metric, round({e}, 6) AS value FROM c" for n, e in {"precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "specificity": "tn / (tn + fp)", "f1": "2 * tp / (2 * tp + fp + fn)"}.items()])))
def binary_metrics(spark, d):
    return rounded(E.binary_metrics(table(spark, d, "scored_binary")))


@register("class_report", multi(_CLASSES.format(v="scored_multi") + "SELECT CAST(c AS VARCHAR) AS label, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(f AS DOUBLE), 6) AS f1, CAST(su AS BIGINT) AS support FROM m UNION ALL SELECT 'accuracy', round(sum(tp) / sum(su), 6), round(sum(tp) / sum(su), 6), round(sum(tp) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM m UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(su) AS BIGINT) FROM m UNION ALL SELECT 'weighted avg', round(sum(p * su) / sum(su), 6), round(sum(r * su) / sum(su), 6), round(sum(f * su) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM m"))
def class_report(spark, d):
    return rounded(E.class_report(table(spark, d, "scored_multi")))


@register("log_loss", multi("SELECT 'log_loss' AS metric, round(-avg(ln(greatest(least(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1 - 1e-15), 1e-15))), 6) AS value FROM scored_multi"))
def log_loss(spark, d):
    return rounded(E.log_loss(table(spark, d, "scored_multi"), "y", P3))


def _auc(name, v, pos, neg, score):
    """Mann-Whitney by mid-ranks within the rows of both kinds."""
    return f"{name} AS (SELECT (sum(CASE WHEN pos THEN r END) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos)) AS a, count(*) FILTER (WHERE pos) AS n FROM (SELECT {pos} AS pos, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {v} WHERE {pos} OR {neg}))"


@register("roc_auc", binary("WITH " + _auc("k", "scored_binary", "y = 1", "y = 0", "p1") + " SELECT 'roc_auc' AS metric, round(a, 6) AS value FROM k"))
def roc_auc(spark, d):
    return rounded(E.roc_auc(table(spark, d, "scored_binary")))


_OVR = "WITH " + ", ".join(_auc(f"k{c}", "scored_multi", f"y = {c}", f"y <> {c}", f"p{c}") for c in range(3)) + ", u AS (" + union([f"SELECT * FROM k{c}" for c in range(3)]) + ") "


@register("auc_ovr", multi(_OVR + "SELECT 'roc_auc_ovr' AS metric, round(avg(a), 6) AS value FROM u UNION ALL SELECT 'roc_auc_ovr_weighted', round(sum(a * n) / sum(n), 6) FROM u"))
def auc_ovr(spark, d):
    return rounded(E.auc_ovr(table(spark, d, "scored_multi"), "y", P3))


_PAIRS = [(a, b) for a in range(3) for b in range(3) if a != b]


@register("auc_ovo", multi("WITH " + ", ".join(_auc(f"k{a}{b}", "scored_multi", f"y = {a}", f"y = {b}", f"p{a}") for a, b in _PAIRS) + ", u AS (" + union([f"SELECT * FROM k{a}{b}" for a, b in _PAIRS]) + ") SELECT 'roc_auc_ovo' AS metric, round(avg(a), 6) AS value FROM u"))
def auc_ovo(spark, d):
    return rounded(E.auc_ovo(table(spark, d, "scored_multi"), "y", P3))


@register("problem_type", multi("SELECT CASE WHEN count(DISTINCT y) = 2 THEN 'binary' ELSE 'multiclass' END AS problem, count(DISTINCT y) AS n_classes, string_agg(DISTINCT CAST(y AS VARCHAR), ',' ORDER BY CAST(y AS VARCHAR)) AS classes FROM scored_multi"))
def problem_type(spark, d):
    return E.problem_type(table(spark, d, "scored_multi"))


@register("metric_improvement", binary("WITH a AS (SELECT avg(CAST(y = 0 AS INT)) AS base, avg(CAST(y = y_pred AS INT)) AS tuned FROM scored_binary) SELECT 'accuracy' AS metric, round(base, 6) AS base, round(tuned, 6) AS tuned, round(tuned - base, 6) AS change, round((tuned - base) / greatest(base, 1e-10) * 100, 6) AS improvement_pct FROM a"))
def metric_improvement(spark, d):
    """A constant prediction against the given one."""
    df = table(spark, d, "scored_binary")
    base = E.label_metrics(df.withColumn("y_pred", F.lit(0))).where("metric = 'accuracy'")
    return rounded(E.improvement(base, E.label_metrics(df).where("metric = 'accuracy'")))


@register("evaluate_stage")
def evaluate_stage(spark, d):
    return rounded(E.run(table(spark, d, "scored_multi"), "y", "y_pred", P3))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FIN = "CASE WHEN {e} IS NULL OR isnan({e}) OR isinf({e}) THEN 0 ELSE {e} END"


def _pair_sql(cols):
    out = {c: f"CAST({c} AS DOUBLE)" for c in cols}
    for a, b in combinations(cols, 2):
        x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
        out |= {f"{a} + {b}": f"({x} + {y})", f"{a} * {b}": f"({x} * {y})", f"{a} - {b}": f"({x} - {y})", f"{a} / {b}": f"({x} / nullif({y}, 0))", f"{b} / {a}": f"({y} / nullif({x}, 0))"}
    return out


def _made(cols):
    return ", ".join(f"{_FIN.format(e=e)} AS \"{n}\"" for n, e in _pair_sql(cols).items())


clf = lambda body: with_view("clf_lineitem", body)


@register("features_pairwise", clf(f"SELECT l_orderkey, l_linenumber, {_made(_COLS)} FROM clf_lineitem"))
def features_pairwise(spark, d):
    return X.generate(table(spark, d, "clf_lineitem"), _COLS, ["l_orderkey", "l_linenumber"])


@register("features_fill", clf("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_FIN.format(e=f'CAST({c} AS DOUBLE)')}, 6) AS {c}" for c in _COLS) + " FROM clf_lineitem"))
def features_fill(spark, d):
    return rounded(table(spark, d, "clf_lineitem").select("l_orderkey", "l_linenumber", *[X.filled(F.col(c).cast("double")).alias(c) for c in _COLS]))


@register("features_identity", clf("SELECT * FROM clf_lineitem"))
def features_identity(spark, d):
    return X.identity(table(spark, d, "clf_lineitem"))


@register("features_name_filter", clf("SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE), 6) AS l_quantity, round(CAST(l_discount AS DOUBLE), 6) AS l_discount, " + ", ".join(f"round({_FIN.format(e=e)}, 6) AS \"{n}\"" for n, e in _pair_sql(["l_quantity", "l_discount"]).items() if " " in n) + " FROM clf_lineitem"))
def features_name_filter(spark, d):
    """Every feature whose name contains the target's name goes."""
    return rounded(X.generate(table(spark, d, "clf_lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"], "l_tax", strict_names=True))


_RANK = "WITH v AS (" + union([f"SELECT '{c}' AS feature, var_samp({c}) AS s FROM clf_lineitem" for c in _COLS]) + "), r AS (SELECT feature, s, row_number() OVER (ORDER BY s DESC, feature) AS k FROM v) "


@register("features_variance_topn", clf(_RANK + "SELECT feature, round(s, 4) AS importance, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3"))
def features_variance_topn(spark, d):
    return rounded(X.variance_ranking(table(spark, d, "clf_lineitem").select(*_COLS), 3), 4)


@register("features_prepared", clf("SELECT l_orderkey, l_linenumber, round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM clf_lineitem)), 6) AS l_extendedprice FROM clf_lineitem"))
def features_prepared(spark, d):
    df = X.prepared(table(spark, d, "clf_lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))
    return rounded(df.withColumns({c: F.col(c).cast("bigint") for c in ("l_orderkey",)} | {"l_linenumber": F.col("l_linenumber").cast("int")}))


@register("features_select", clf("SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM clf_lineitem"))
def features_select(spark, d):
    return X.project(table(spark, d, "clf_lineitem"), ["l_extendedprice", "missing", "l_quantity"], keep=["l_orderkey", "l_linenumber"])


@register("features_stage")
def features_stage(spark, d):
    """Generated on four fifths, ranked there, the rest projected alike."""
    df = table(spark, d, "clf_lineitem").drop("l_linestatus")
    return rounded(X.run(df.where("l_orderkey % 5 <> 0"), df.where("l_orderkey % 5 = 0"), "target", 5, ["l_orderkey", "l_linenumber"])[1], 4)
