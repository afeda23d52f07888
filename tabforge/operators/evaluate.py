"""Classification metrics. All label metrics come from one count by (y, y_pred); ranking metrics from counts by score.

A table of predictions has a label column, a predicted column and, for probability metrics, a column for each class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15
MAX_CLASSES = 2000


def cells(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """y, y_pred and n of the pairs that occur; the one shuffle that all label metrics need."""
    return df.groupBy(F.col(y).alias("y"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Dense matrix over the sorted classes that occur in either column, null among them if it does; more than MAX_CLASSES are refused, as the matrix has their square."""
    found = cells(df, y, y_pred)
    classes = found.select(F.col("y").alias("c")).unionByName(found.select(F.col("y_pred").alias("c"))).distinct()
    if classes.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    square = classes.select(F.col("c").alias("y")).crossJoin(F.broadcast(classes.select(F.col("c").alias("y_pred"))))
    own = found.select(F.col("y").alias("_y"), F.col("y_pred").alias("_p"), "n")
    return square.join(own, F.col("y").eqNullSafe(F.col("_y")) & F.col("y_pred").eqNullSafe(F.col("_p")), "left").select("y", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """class, tp, predicted, support, precision, recall and f1; a zero denominator gives 0."""
    found = cells(df, y, y_pred)
    rows = found.select(F.col("y").alias("class"), F.when(F.col("y") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("predicted"), F.col("n").alias("support"))
    cols = found.select(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("support"))
    both = rows.unionByName(cols).groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return both.select("*", zero(F.col("tp"), F.col("predicted")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def label_metrics(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """metric and value: accuracy, balanced_accuracy, mcc, kappa, macro and weighted precision, recall and f1."""
    one = per_class(df, y, y_pred).agg(
        F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("pt"), F.sum(F.col("predicted").cast("double") ** 2).alias("pp"), F.sum(F.col("support").cast("double") ** 2).alias("tt"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )
    c, s, pt = F.col("c"), F.col("s"), F.col("pt")
    values = {
        "accuracy": c / s, "balanced_accuracy": F.col("balanced"),
        "mcc": F.coalesce(F.try_divide(c * s - pt, F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))), F.lit(0.0)),
        "kappa": F.coalesce(F.try_divide(c / s - pt / (s * s), 1 - pt / (s * s)), F.lit(0.0)),
    } | {f"{k}_{m}": F.col(f"{k}_{m}") for k in ("macro", "weighted") for m in ("precision", "recall", "f1")}
    return _long(one, values)


def _long(one: DataFrame, values: dict[str, Column]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("m")).select("m.*")


def binary_metrics(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """precision, recall and f1 of class 1, specificity (recall of class 0)."""
    n = lambda a, b: F.coalesce(F.sum(F.when((F.col("y") == a) & (F.col("y_pred") == b), F.col("n"))), F.lit(0)).cast("double")
    one = cells(df, y, y_pred).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return _long(one, {"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "specificity": zero(tn, tn + fp), "f1": zero(2 * tp, 2 * tp + fp + fn)})


def class_report(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """label, precision, recall, f1 and support by class, then accuracy, macro avg and weighted avg."""
    rows = per_class(df, y, y_pred)
    names = ("precision", "recall", "f1")
    classes = rows.select(F.col("class").cast("string").alias("label"), *names, "support")
    accuracy = F.sum("tp") / F.sum("support").cast("double")
    total = rows.agg(*[accuracy.alias(m) for m in names], F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), *names, "support")
    macro = rows.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = rows.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    return classes.unionByName(total).unionByName(macro).unionByName(weighted)


def log_loss(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """Mean negative logarithm of the label's probability, clipped. probabilities: class to column. A label without a column, a null one and a null probability raise an error."""
    p = F.coalesce(*[F.when(F.col(y) == c, F.col(k)) for c, k in probabilities.items()], F.raise_error(F.concat(F.lit("no probability for the class "), F.coalesce(F.col(y).cast("string"), F.lit("null")))).cast("double"))
    return df.agg((-F.avg(F.log(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))))).alias("value")).select(F.lit("log_loss").alias("metric"), "value")


RANGES = 256


def _rank_sums(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, positives, negatives and u (the Mann-Whitney sum) from rows (keys, score, pos, neg).

    Scores are first collapsed to distinct values. The order is then taken in ranges cut at quantiles of the score: each
    range is ordered by itself, and the ranges' totals (at most RANGES a key) give each its start. Ties share their mid-rank.
    """
    distinct = scores.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cuts = distinct.select(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    ranged = distinct.withColumn("_r", F.size(F.filter(cuts, lambda c: c < F.col("score"))))
    inner = Window.partitionBy(*keys, "_r").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("_below", F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    totals = ranged.groupBy(*keys, "_r").agg(F.sum("neg").alias("_n"))
    start = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_r", F.coalesce(F.sum("_n").over(start), F.lit(0)).alias("_start"))
    both = ranked.join(starts, [*keys, "_r"])
    u = F.sum(F.col("pos").cast("double") * (F.col("_below") + F.col("_start") + F.col("neg") / 2))
    return both.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), u.alias("u"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "p1", positive=1) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null with one class only."""
    rows = df.select(F.lit(0).alias("k"), F.col(score).cast("double").alias("score"), (F.col(y) == positive).cast("int").alias("pos"), (F.col(y) != positive).cast("int").alias("neg"))
    return _rank_sums(rows, ["k"]).select(F.lit("roc_auc").alias("metric"), F.try_divide(F.col("u"), F.col("positives").cast("double") * F.col("negatives")).alias("value"))


def auc_ovr(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """Each class against the rest: roc_auc_ovr (plain mean) and roc_auc_ovr_weighted (by support)."""
    one = F.explode(F.array(*[F.struct(F.lit(str(c)).alias("k"), F.col(p).cast("double").alias("score"), (F.col(y) == c).cast("int").alias("pos"), (F.col(y) != c).cast("int").alias("neg")) for c, p in probabilities.items()])).alias("r")
    auc = _rank_sums(df.select(one).select("r.*"), ["k"]).withColumn("auc", F.try_divide(F.col("u"), F.col("positives").cast("double") * F.col("negatives")))
    return _long(auc.agg(F.avg("auc").alias("a"), (F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("b")), {"roc_auc_ovr": F.col("a"), "roc_auc_ovr_weighted": F.col("b")})


def auc_ovo(df: DataFrame, y: str, probabilities: dict) -> DataFrame:
    """Mean over ordered pairs of classes of the area within the pair (Hand and Till 2001)."""
    # a row's class is one of the two of 2 (k - 1) pairs, and only these are made of it
    place = F.coalesce(*[F.when(F.col(y) == c, F.lit(i)) for i, c in enumerate(probabilities)])
    scores = F.array(*[F.col(p).cast("double") for p in probabilities.values()])
    known = df.select(place.alias("_own"), scores.alias("_scores")).where("_own is not null")
    others = F.filter(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)), lambda i: i != F.col("_own"))
    cell = lambda a, b, score, pos: F.struct((a * len(probabilities) + b).cast("long").alias("k"), F.get("_scores", score).alias("score"), F.lit(pos).alias("pos"), F.lit(1 - pos).alias("neg"))
    own = F.col("_own")
    rows = known.select(F.explode(F.concat(F.transform(others, lambda i: cell(own, i, own, 1)), F.transform(others, lambda i: cell(i, own, i, 0)))).alias("r")).select("r.*")
    return _rank_sums(rows, ["k"]).agg(F.avg(F.try_divide(F.col("u"), F.col("positives").cast("double") * F.col("negatives"))).alias("value")).select(F.lit("roc_auc_ovo").alias("metric"), "value")


def problem_type(df: DataFrame, y: str = "y") -> DataFrame:
    """problem (binary or multiclass), n_classes and classes (sorted)."""
    one = df.agg(F.array_sort(F.collect_set(F.col(y).cast("string"))).alias("classes"))
    return one.select(F.when(F.size("classes") == 2, "binary").otherwise("multiclass").alias("problem"), F.size("classes").cast("bigint").alias("n_classes"), F.array_join("classes", ",").alias("classes"))


def improvement(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """metric, base, tuned, change and improvement_pct of two metric tables."""
    both = base.select("metric", F.col("value").alias("base")).join(tuned.select("metric", F.col("value").alias("tuned")), "metric")
    return both.select("metric", "base", "tuned", (F.col("tuned") - F.col("base")).alias("change"), ((F.col("tuned") - F.col("base")) / F.greatest(F.col("base"), F.lit(1e-10)) * 100).alias("improvement_pct"))


def run(df: DataFrame, y: str = "y", y_pred: str = "y_pred", probabilities: dict | None = None) -> DataFrame:
    """Every metric that the table allows, in one metric table; probability metrics only where probabilities are given."""
    out = label_metrics(df, y, y_pred)
    if probabilities:
        out = out.unionByName(log_loss(df, y, probabilities))
        if len(probabilities) == 2:
            positive = sorted(probabilities)[1]
            out = out.unionByName(roc_auc(df, y, probabilities[positive], positive))
        else:
            out = out.unionByName(auc_ovr(df, y, probabilities)).unionByName(auc_ovo(df, y, probabilities))
    return out
