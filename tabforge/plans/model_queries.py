"""Queries of neighbours, resampling, classifiers and tuning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabforge.operators import attribution as A
from tabforge.operators import bayes as B
from tabforge.operators import chain
from tabforge.operators import knn as K
from tabforge.operators import models as M
from tabforge.operators import resample as R
from tabforge.operators import tune as H
from tabforge.plans.catalogue import register
from tabforge.plans.support import rounded, with_view
from tabforge.sources.tables import scratch_dir, table

docs = lambda body: with_view("doc_labels", body)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))


def _points(spark, d):
    """Labelled documents as points: characters and spaces; label: toxic."""
    return table(spark, d, "doc_labels").select(F.col("doc_id").alias("id"), F.array(F.col("n_chars").cast("double"), F.col("n_spaces").cast("double")).alias("x"), F.col("toxic").cast("string").alias("label"))


_NEAR = """SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS dist, CAST(b.label AS VARCHAR) AS label FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
_TOP = "n AS (" + _NEAR + "), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS INTEGER) AS rank FROM n QUALIFY rank <= 5)"


@register("knn_join", f"WITH {_TOP} SELECT id, neighbour, round(dist, 6) AS distance, rank FROM t")
def knn_join(spark, d):
    rows = _vectors(spark, d)
    return rounded(K.knn(rows, rows, 5))


@register("knn_classify", f"WITH {_TOP}, v AS (SELECT id, label, count(*) AS c FROM t GROUP BY ALL) SELECT id, arg_min(label, (-c, label)) AS prediction FROM v GROUP BY id".replace("arg_min(label, (-c, label))", "first(label ORDER BY c DESC, label)"))
def knn_classify(spark, d):
    rows = _vectors(spark, d)
    return K.vote(K.knn(rows, rows, 5), rows.select("id", "label"))


@register("knn_classify_distance", f"WITH {_TOP}, v AS (SELECT id, label, sum(1 / greatest(dist, 1e-12)) AS c FROM t GROUP BY ALL) SELECT id, first(label ORDER BY round(c, 9) DESC, label) AS prediction FROM v GROUP BY id")
def knn_classify_distance(spark, d):
    rows = _vectors(spark, d)
    return K.vote(K.knn(rows, rows, 5), rows.select("id", "label"), "distance")


@register("knn_approximate")
def knn_approximate(spark, d):
    rows = _vectors(spark, d)
    return rounded(K.approximate(rows, rows, 1.2))


_R = "r AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS a, CAST(n_spaces AS DOUBLE) AS b, CAST(toxic AS VARCHAR) AS label FROM doc_labels)"
_DIST = "round(sqrt((p.a - o.a) * (p.a - o.a) + (p.b - o.b) * (p.b - o.b)), 9)"
_HEX = "CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), CAST(j AS VARCHAR), '{w}')), 1, 8) AS BIGINT)"
_SIZES = "s AS (SELECT label, count(*) AS size, max(count(*)) OVER () AS most FROM r GROUP BY label)"
_MAKE = f"""d AS (SELECT p.id, o.id AS nb, {_DIST} AS dist FROM q p JOIN r o ON p.label = o.label AND p.id <> o.id WHERE p.n > 0),
k AS (SELECT id, nb, row_number() OVER (PARTITION BY id ORDER BY dist, nb) AS rk FROM d QUALIFY rk <= 5),
c AS (SELECT id, count(*) AS c FROM k GROUP BY id),
b AS (SELECT *, CAST(sum(n) OVER (ORDER BY md5(CAST(id AS VARCHAR))) - n AS BIGINT) AS before FROM q WHERE n > 0),
j AS (SELECT id, label, a, b, before, unnest(range(1, CAST(n AS BIGINT) + 1)) AS j FROM b),
m AS (SELECT j.*, {_HEX.format(w='n').replace('(id', '(j.id').replace('CAST(id', 'CAST(j.id')} % c.c + 1 AS pick, {_HEX.format(w='u').replace('CAST(id', 'CAST(j.id')} / 4294967296.0 AS u FROM j JOIN c ON j.id = c.id),
y AS (SELECT least((SELECT min(id) FROM r), 0) - m.before - m.j AS id, m.label, m.a + m.u * (o.a - m.a) AS a, m.b + m.u * (o.b - m.b) AS b FROM m JOIN k ON k.id = m.id AND k.rk = m.pick JOIN r o ON o.id = k.nb),
w AS (SELECT id, label, a, b FROM r UNION ALL SELECT id, label, a, b FROM y)"""
_SMOTE = f"WITH {_R}, {_SIZES}, e AS (SELECT r.*, size, most, row_number() OVER (PARTITION BY r.label ORDER BY md5(CAST(id AS VARCHAR))) AS rn FROM r JOIN s ON r.label = s.label WHERE size < most), q AS (SELECT id, label, a, b, (most - size) // size + CASE WHEN rn <= (most - size) % size THEN 1 ELSE 0 END AS n FROM e), {_MAKE}"
_OUT = " SELECT id, label, round(a, 4) AS x0, round(b, 4) AS x1 FROM "


def _flat(df):
    return rounded(df.select("id", "label", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")), 4)


@register("smote", docs(_SMOTE + _OUT + "w"))
def smote(spark, d):
    return _flat(R.smote(_points(spark, d)))


def _tomek(v):
    return f"tn AS (SELECT p.id, o.id AS nb, p.label <> o.label AS diff, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST}, o.id) AS rk FROM {v} p JOIN {v} o ON p.id <> o.id QUALIFY rk = 1), tl AS (SELECT t.id FROM tn t JOIN tn u ON t.nb = u.id AND u.nb = t.id WHERE t.diff), tr AS (SELECT * FROM {v} WHERE id NOT IN (SELECT id FROM tl))"


def _enn(v):
    return f"en AS (SELECT p.id, p.label <> o.label AS diff, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST}, o.id) AS rk FROM {v} p JOIN {v} o ON p.id <> o.id QUALIFY rk <= 3), er AS (SELECT * FROM {v} WHERE id NOT IN (SELECT id FROM en WHERE diff))"


@register("tomek", docs(f"WITH {_R}, {_tomek('r')}{_OUT}tr"))
def tomek(spark, d):
    return _flat(R.remove_tomek(_points(spark, d)))


@register("enn", docs(f"WITH {_R}, {_enn('r')}{_OUT}er"))
def enn(spark, d):
    return _flat(R.edited(_points(spark, d)))


@register("smote_tomek", docs(_SMOTE + ", " + _tomek("w") + _OUT + "tr"))
def smote_tomek(spark, d):
    return _flat(R.smote_tomek(_points(spark, d)))


@register("smote_enn", docs(_SMOTE + ", " + _enn("w") + _OUT + "er"))
def smote_enn(spark, d):
    return _flat(R.smote_enn(_points(spark, d)))


@register("adasyn", docs(f"WITH {_R}, {_SIZES}, h AS (SELECT p.id, p.label, p.a, p.b, p.label <> o.label AS diff, size, most, row_number() OVER (PARTITION BY p.id ORDER BY {_DIST}, o.id) AS rk FROM r p JOIN r o ON p.id <> o.id JOIN s ON s.label = p.label WHERE size < most QUALIFY rk <= 5), g AS (SELECT id, label, a, b, size, most, avg(CAST(diff AS INT)) AS share FROM h GROUP BY ALL), q AS (SELECT id, label, a, b, coalesce(floor(share / sum(share) OVER (PARTITION BY label) * (most - size) + 0.5), 0) AS n FROM g), {_MAKE}{_OUT}w"))
def adasyn(spark, d):
    return _flat(R.adasyn(_points(spark, d)))


_NB = ["l_quantity", "l_discount", "l_tax"]
clf = lambda body: with_view("clf_lineitem", body)


def _nb(spark, d, kind, columns=None, **more):
    columns = columns or _NB
    df = table(spark, d, "clf_lineitem")
    state = B.FITS[kind][0](df, columns, "target", **more)
    return B.predict(df, state, kind, columns).groupBy("target", "prediction").agg(F.count("*").alias("n"))


def _argmax_sql(score: str) -> str:
    """Counts of (target, prediction) for a score by row and class; the score is rounded so that ties agree."""
    return f"z AS (SELECT l.l_orderkey AS o, l.rid, l.target, s.c, {score} AS v FROM l CROSS JOIN s), p AS (SELECT rid, target, first(c ORDER BY v DESC, c) AS prediction FROM z GROUP BY rid, target) SELECT target, prediction, count(*) AS n FROM p GROUP BY ALL"


_L = "l AS (SELECT *, row_number() OVER () AS rid FROM clf_lineitem)"


@register("nb_gaussian", clf("WITH " + _L + ", g AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) AS e FROM l), s AS (SELECT target AS c, count(*) / (SELECT count(*) FROM l) AS pr, " + ", ".join(f"avg({c}) AS m{i}, var_pop({c}) + (SELECT e FROM g) AS v{i}" for i, c in enumerate(_NB)) + " FROM l GROUP BY target), " + _argmax_sql("ln(s.pr) - 0.5 * (" + " + ".join(f"ln(2 * pi() * s.v{i}) + pow(l.{c} - s.m{i}, 2) / s.v{i}" for i, c in enumerate(_NB)) + ")")))
def nb_gaussian(spark, d):
    return _nb(spark, d, "gaussian")


@register("nb_multinomial", clf("WITH " + _L + ", s AS (SELECT target AS c, count(*) / (SELECT count(*) FROM l) AS pr, " + ", ".join(f"ln((sum({c}) + 1) / (sum(l_quantity) + sum(l_discount) + sum(l_tax) + 3)) AS w{i}" for i, c in enumerate(_NB)) + " FROM l GROUP BY target), " + _argmax_sql("ln(s.pr) + " + " + ".join(f"l.{c} * s.w{i}" for i, c in enumerate(_NB)))))
def nb_multinomial(spark, d):
    return _nb(spark, d, "multinomial")


@register("nb_bernoulli", clf("WITH " + _L + ", s AS (SELECT target AS c, count(*) / (SELECT count(*) FROM l) AS pr, " + ", ".join(f"(count(*) FILTER (WHERE {c} > 0.05) + 1) / (count(*) + 2) AS p{i}" for i, c in enumerate(_NB)) + " FROM l GROUP BY target), " + _argmax_sql("ln(s.pr) + " + " + ".join(f"CASE WHEN l.{c} > 0.05 THEN ln(s.p{i}) ELSE ln(1 - s.p{i}) END" for i, c in enumerate(_NB)))))
def nb_bernoulli(spark, d):
    return _nb(spark, d, "bernoulli", threshold=0.05)


_XY = ["l_quantity", "l_discount"]


@register("lda_2d", clf("WITH " + _L + ", t AS (SELECT target AS c, count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_discount, l_discount) AS yy FROM l GROUP BY target), u AS (SELECT sum(n) AS n, sum(n * xx) / sum(n) AS xx, sum(n * xy) / sum(n) AS xy, sum(n * yy) / sum(n) AS yy FROM t), s AS (SELECT c, ln(t.n / u.n) AS pr, a, b, (u.yy * a - u.xy * b) / (u.xx * u.yy - u.xy * u.xy) AS wa, (u.xx * b - u.xy * a) / (u.xx * u.yy - u.xy * u.xy) AS wb FROM t, u), " + _argmax_sql("s.pr - 0.5 * (s.a * s.wa + s.b * s.wb) + l.l_quantity * s.wa + l.l_discount * s.wb")))
def lda_2d(spark, d):
    return _nb(spark, d, "lda", _XY)


@register("qda_2d", clf("WITH " + _L + ", t AS (SELECT target AS c, count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, covar_samp(l_quantity, l_quantity) AS xx, covar_samp(l_quantity, l_discount) AS xy, covar_samp(l_discount, l_discount) AS yy FROM l GROUP BY target), s AS (SELECT *, ln(n / (SELECT count(*) FROM l)) AS pr, xx * yy - xy * xy AS de FROM t), " + _argmax_sql("s.pr - 0.5 * ln(s.de) - 0.5 * (s.yy * pow(l.l_quantity - s.a, 2) - 2 * s.xy * (l.l_quantity - s.a) * (l.l_discount - s.b) + s.xx * pow(l.l_discount - s.b, 2)) / s.de")))
def qda_2d(spark, d):
    return _nb(spark, d, "qda", _XY)


def _binary(spark, d):
    return M.assembled(table(spark, d, "doc_labels").withColumn("id", F.col("doc_id")), ["n_chars", "n_spaces", "quality"], "toxic", ["id"])


def _many(spark, d):
    from pyspark.ml.functions import array_to_vector

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))


def _model(name, source, params=None):
    def run(spark, d):
        df = source(spark, d)
        return M.score(M.fit(df, name, params), df, ["id"]).select("id", "label", "prediction")

    run.__doc__ = f"Fitted and applied to the whole table: {name}."
    register(f"model_{name}")(run)


for _name, _source in [
    ("logistic_regression", _many), ("ridge", _many), ("sgd", _binary), ("decision_tree", _many), ("random_forest", _many), ("gradient_boosting", _binary), ("adaboost", _binary), ("extra_trees", _many),
    ("svc", _binary), ("mlp", _many), ("xgboost", _binary), ("lightgbm", _binary), ("catboost", _binary),
]:
    _model(_name, _source)


for _name, _source, _params in [("knn", _many, None), ("gaussian_nb", _many, None), ("lda", _many, None), ("qda", _binary, {"reg_param": 0.1}), ("multinomial_nb", _binary, None), ("bernoulli_nb", _binary, {"threshold": 0.5})]:
    _model(_name, _source, _params)


def _scratch(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("model_saved")
def model_saved(spark, d):
    """Models of several kinds, written and read again, score as before; rows are kept."""
    df, out = _binary(spark, d), None
    for name, params in (("logistic_regression", None), ("ridge", None), ("svc", None), ("knn", None), ("xgboost", None)):
        model = M.load(spark, M.save(M.fit(df, name, params), spark, _scratch(spark, name)))
        one = M.score(model, df, ["id"]).select(F.lit(name).alias("model"), "id", "prediction")
        out = one if out is None else out.unionByName(one)
    return out


@register("chain_saved")
def chain_saved(spark, d):
    """The whole chain over the raw customers, saved and loaded: class and probability of every row."""
    df = table(spark, d, "dirty_customer")
    fitted = chain.fit(df, "label", ["c_custkey"], "logistic_regression", None, 10)
    scored = chain.load(spark, fitted.save(spark, _scratch(spark, "chain"))).score(df, ["c_custkey"])
    return scored.select("c_custkey", "prediction", F.round(F.array_max("probability"), 4).alias("top"))


@register("importance_rf")
def importance_rf(spark, d):
    return rounded(M.forest_importance(_many(spark, d), [f"e{i}" for i in range(64)], 20))


@register("importance_attribution")
def importance_attribution(spark, d):
    """Mean size of a forest's exact attributions over all rows."""
    df = _binary(spark, d)
    return rounded(A.importance(df, ["n_chars", "n_spaces", "quality"], M.fit(df, "random_forest")))


@register("features_attributed")
def features_attributed(spark, d):
    """The feature stage with the ranking by attributions of all rows."""
    from tabforge.operators import features

    df = table(spark, d, "doc_labels").select("doc_id", "n_chars", "n_spaces", "toxic")
    return rounded(features.run(df, None, "toxic", 5, ["doc_id"], ranking="attribution")[0])


@register("importance_permutation")
def importance_permutation(spark, d):
    df = _binary(spark, d)
    return rounded(M.permutation_importance(df, ["n_chars", "n_spaces", "quality"], M.fit(df, "decision_tree"), "id"))


@register("importance_linear")
def importance_linear(spark, d):
    return rounded(M.linear_importance(_binary(spark, d), ["n_chars", "n_spaces", "quality"]))


@register("tune_grid")
def tune_grid(spark, d):
    return rounded(H.grid_search(_binary(spark, d), "decision_tree", {"max_depth": [2, 5], "criterion": ["gini", "entropy"]})[0])


@register("tune_random")
def tune_random(spark, d):
    return rounded(H.random_search(_binary(spark, d), "logistic_regression", {"C": (0.001, 100.0), "max_iter": (10, 50)}, 4, "logLoss")[0])


@register("tune_roc_auc")
def tune_roc_auc(spark, d):
    return rounded(H.grid_search(_binary(spark, d), "gaussian_nb", metric="roc_auc", cv=3)[0])


@register("tune_stage")
def tune_stage(spark, d):
    """Tuned on four fifths, judged on the rest."""
    df = _binary(spark, d)
    trials, _, value = H.run(df.where("id % 5 <> 0"), "decision_tree", df.where("id % 5 = 0"), "random", "f1", {"max_depth": (2, 6)}, 3)
    return rounded(trials.withColumn("test_value", F.lit(float(value))))


@register("features_resampled")
def features_resampled(spark, d):
    """The feature stage on a rebalanced training table."""
    from tabforge.operators import features

    df = table(spark, d, "doc_labels").select("doc_id", "n_chars", "n_spaces", "toxic")
    return features.run(df, None, "toxic", 5, ["doc_id"], resampling="smote")[0].groupBy("toxic").agg(F.count("*").alias("n"))
