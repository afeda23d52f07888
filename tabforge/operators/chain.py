"""The whole way from a raw table to predictions: cleaning, preprocessing, features and model, fitted once, saved and loaded."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import clean, features, models, preprocess
from tabforge.operators.stats import col, numeric_columns, quoted
from tabforge.sources.tables import read_json, write_json


@dataclass
class Chain:
    """columns: inputs of the feature stage; selected: what the model reads; classes: the labels by code."""

    target: str
    ids: list[str]
    cleaning: clean.CleanPlan
    preprocessing: preprocess.Preprocessing
    columns: list[str]
    make: bool
    selected: list[str]
    classes: list
    model: object

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep, prediction (as in the raw table) and, where the model has them, probabilities by class code, for every row: none is dropped or merged."""
        names = [f"_keep{i}" for i in range(len(keep))]  # kept as they came, not as cleaning changes them
        rows = df.drop(self.target).withColumns({n: col(c) for n, c in zip(names, keep)})
        rows = self.preprocessing.transform(clean.apply(rows, self.cleaning, drop_rows=False))
        made = features.generate(rows, self.columns, names) if self.make else rows
        table = made.select(*names, *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(self.selected)], F.lit(0.0).alias("_label"))
        table = models.assembled(table, [f"_{i}" for i in range(len(self.selected))], "_label", names)
        scored = models.score(self.model, table, names)
        values = F.array(*[F.lit(c) for c in self.classes])
        label = F.get(values, F.col("prediction").cast("int"))
        return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], label.alias("prediction"), *[c for c in scored.columns if c == "probability"])

    def save(self, spark: SparkSession, path: str) -> str:
        state = {
            "target": self.target, "ids": self.ids, "cleaning": self.cleaning.state(), "preprocessing": self.preprocessing.config(),
            "columns": self.columns, "make": self.make, "selected": self.selected, "classes": self.classes,
        }
        write_json(state, spark, f"{path}/chain")
        models.save(self.model, spark, f"{path}/model")
        return path


def load(spark: SparkSession, path: str) -> Chain:
    s = read_json(spark, f"{path}/chain")
    plans = {"cleaning": clean.CleanPlan(**s.pop("cleaning")), "preprocessing": preprocess.Preprocessing(**s.pop("preprocessing"))}
    return Chain(**s, **plans, model=models.load(spark, f"{path}/model"))


def fit(df: DataFrame, target: str, ids: Sequence[str] = (), name: str = "random_forest", params: dict | None = None, n_features: int = 20, make: bool = False, ranking: str = "importance") -> Chain:
    """Every stage fitted on df, each on what the one before made of it; rows without a target are left out."""
    ids = list(ids)
    known = df.where(col(target).isNotNull())
    cleaning = clean.fit(known, ids, target)
    tidy = clean.apply(known, cleaning)
    kept = [c for c in ids if c in tidy.columns]
    preprocessing = preprocess.default_plan(tidy, target, kept).fit(tidy)
    rows = preprocessing.transform(tidy, train=True)
    classes = preprocessing.state.get("classes") or sorted(r[0] for r in rows.select(quoted(target)).distinct().limit(features.MOST_CLASSES + 1).collect())
    if len(classes) > features.MOST_CLASSES:
        raise ValueError(f"more than {features.MOST_CLASSES} classes")
    columns = [c for c in numeric_columns(rows) if c != target]
    made, _, ranked = features.run(rows, None, target, n_features, make=make, ranking=ranking)
    selected = [r["feature"] for r in ranked.orderBy("rank").collect()]
    code = col(target) if preprocessing.state["target_text"] else F.array_position(F.array(*[F.lit(c) for c in classes]), col(target)) - 1
    table = made.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(selected)], code.alias("_label"))
    model = models.fit(models.assembled(table, [f"_{i}" for i in range(len(selected))], "_label"), name, params)
    return Chain(target, ids, cleaning, preprocessing, columns, make, selected, classes, model)
