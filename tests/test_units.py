"""Tiny frames with results known by hand."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.functions import power
from tabforge.operators import stats
from tabforge.operators import bayes, chain, clean, evaluate, features, knn, models, preprocess, profile, resample, split, tune


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_thresholds_are_strict(spark):
    df = frame(spark, [(i, None if i < 6 else 1.0 * i, None if i < 5 else "x", "a" if i < 98 else "b") for i in range(10)], "id int, six double, five string, top string")
    assert clean.high_null_columns(df) == []
    assert clean.high_null_columns(df, most=0.59) == ["six"]
    assert clean.text_columns(df) == ["five", "top"]
    wide = frame(spark, [("a" if i < 98 else "b", "a" if i < 99 else "b") for i in range(100)], "p string, q string")
    assert clean.near_constant_columns(wide) == ["q"]


def test_row_nulls(spark):
    df = frame(spark, [(1, 1, 1, 1), (1, 1, None, None), (1, None, None, None)], "a int, b int, c int, d int")
    assert clean.full_rows(df).count() == 2


def test_constant_and_duplicate_columns(spark):
    df = frame(spark, [(1, 1, None, 2, "1"), (2, 2, None, 2, "2"), (None, None, None, 2, None)], "a int, b int, c int, d int, e string")
    assert clean.constant_columns(df) == ["c", "d"] and clean.duplicate_columns(df) == {"b": "a"}


def test_text_types(spark):
    df = frame(spark, [("1", "1.5", "yes", "2024-01-05", "x"), ("2", "x", "NO", "2024-02-30", "y"), ("3", "2", "t", "2024-03-01", "1")] + [("4", "5", "0", "2024-04-01", "z")] * 4, "i string, d string, b string, t string, s string")
    assert clean.text_types(df) == {"i": "integer", "d": "double", "b": "boolean", "t": "date"}
    assert clean.date_patterns(df)["t"] == "yyyy-MM-dd"


def test_mode_ties_take_the_least(spark):
    df = frame(spark, [("b", 2.0), ("a", 1.0), (None, None)], "t string, n double")
    assert preprocess.impute_values(df, ["t", "n"], "mode") == {"t": "a", "n": 1.0}
    assert preprocess.impute_values(df, ["t", "n"], "mean") == {"t": "a", "n": 1.5}
    with pytest.raises(ValueError):
        preprocess.impute_values(df, ["n"], "best")


def test_zero_spread(spark):
    df = frame(spark, [(3.0,), (3.0,)], "x double")
    for method in ("standard", "robust", "minmax"):
        assert preprocess.scale_values(df, ["x"], method)["x"][1] == 1.0


def test_unseen_values(spark):
    train, test = frame(spark, [("a", 1), ("b", 2)], "c string, y int"), frame(spark, [("a", 1), ("c", 1), (None, 1)], "c string, y int")
    hot = preprocess.Preprocessing("y", encoding="onehot", encoded_columns=["c"]).fit(train)
    assert [tuple(r) for r in hot.transform(test).select("c_a", "c_b").collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    with pytest.raises(Exception, match="unseen"):
        preprocess.Preprocessing("y", encoding="label", encoded_columns=["c"]).fit(train).transform(test).collect()


def test_capping_is_idempotent(spark):
    df = frame(spark, [(float(i),) for i in range(20)] + [(1000.0,), (None,)], "x double")
    limits = preprocess.caps(df, ["x"])["x"]
    once = df.select(preprocess.capped(F.col("x"), limits).alias("x"))
    assert once.collect() == once.select(preprocess.capped(F.col("x"), limits).alias("x")).collect() and once.where("x is null").count() == 1


def test_power(spark):
    rng = random.Random(1)
    df = frame(spark, [(math.exp(rng.gauss(0, 1)), rng.gauss(-1, 2)) for _ in range(500)], "ln double, n double")
    state = power.fit(df, ["ln", "n"], power.BOX)
    assert abs(state["ln"]["exponent"]) < 0.15 and state["n"]["shift"] > 1
    out = df.select(power.transformed(F.col("ln"), state["ln"]).alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(out[0]) < 1e-9 and abs(out[1] - 1) < 1e-9
    assert {r["column"]: r["recommendation"] for r in power.recommend(df, ["ln", "n"], refine=0).collect()}["n"] == power.YEO


def test_split_is_complete_and_disjoint(spark):
    df = frame(spark, [(i, "abc"[i % 3] if i % 7 else "a") for i in range(101)], "id long, y string")
    for out in (split.split_random(df, ["id"]), split.split_stratified(df, "y", ["id"])):
        assert out.count() == 101 and out.select("id").distinct().count() == 101
    assert split.split_random(df, ["id"]).where("split = 'test'").count() == 21
    per = {r["y"]: (r["n"], r["t"]) for r in split.split_stratified(df, "y", ["id"]).groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert all(t == math.ceil(n * 0.2) for n, t in per.values())
    assert split.train_test_split(df, "id", ["id"]).where("split = 'test'").count() == 21


@pytest.mark.parametrize("few", [1, 1000])
def test_stratified_edges_by_brute_force(spark, monkeypatch, few):
    """One pass and many; a class with most rows, a null class, one of a single row; rows of a repeated key stay together; names that need quotes."""
    monkeypatch.setattr(split, "FEW_KEYS", few)
    rows = [(i // 3 if i % 5 == 0 else i + 10_000, None if i % 11 == 0 else "rare" if i == 5 else "b" if i % 4 == 0 else "a") for i in range(900)]
    df = frame(spark, rows, "`the.id` long, `y.z` string")
    for share in (0.2, 0.5, 1.0):
        want = []
        for c in {y for _, y in rows}:
            own = [hashlib.md5(f"{i}|42".encode()).hexdigest() for i, y in rows if y == c]
            room, edge = math.ceil(share * len(own)), None
            for k in sorted(set(own)):
                if sum(h <= k for h in own) > room:
                    edge = k
                    break
            want += [(i, str(y), "test" if edge is None or hashlib.md5(f"{i}|42".encode()).hexdigest() < edge else "train") for i, y in rows if y == c]
        got = split.split_stratified(df, "y.z", ["the.id"], share)
        assert got.columns == ["the.id", "y.z", "split"] and sorted((a, str(b), c) for a, b, c in map(tuple, got.collect())) == sorted(want)
    assert split.split_stratified(df.limit(0), "y.z", ["the.id"]).count() == 0


def test_ids_and_profile_of_empty_table(spark):
    df = frame(spark, [], "id long, x double, t string")
    assert profile.profile_columns(df).count() == 3 and profile.shape(df).first()[0] == 0 and profile.duplicate_rows(df).first()[0] == 0


def test_zero_divisor(spark):
    df = frame(spark, [(1.0, 0.0), (None, 2.0), (float("inf"), 1.0)], "a double, b double")
    out = features.generate(df, ["a", "b"])
    assert [r["a / b"] for r in out.collect()] == [0.0, 0.0, 0.0] and len(out.columns) == 7
    with pytest.raises(ValueError):
        features.pairwise([f"c{i}" for i in range(100)])


def test_metrics_by_hand(spark):
    df = frame(spark, [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9), (1, 0, 0.4)], "y int, y_pred int, p1 double")
    got = {r["metric"]: r["value"] for r in evaluate.run(df, "y", "y_pred").collect()}
    assert got["accuracy"] == pytest.approx(0.6) and got["balanced_accuracy"] == pytest.approx((0.5 + 2 / 3) / 2)
    auc = evaluate.roc_auc(df).first()["value"]
    assert auc == pytest.approx((1 + 0.5 + 1 + 1 + 1 + 0) / 6)
    assert evaluate.roc_auc(df.withColumn("p1", 1 - F.col("p1"))).first()["value"] == pytest.approx(1 - auc)
    assert evaluate.confusion(df).agg(F.sum("n")).first()[0] == 5
    one = df.where("y = 1 and y_pred = 1")
    assert {r["metric"]: r["value"] for r in evaluate.label_metrics(one).collect()}["mcc"] == 0.0 and evaluate.roc_auc(one).first()["value"] is None


def blobs(spark, n=40):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal([0, 6, 12][c], 0.8, 2)], str(c), float(c)) for i in range(n) for c in [0 if i % 4 < 2 else i % 4 - 1]]
    return frame(spark, rows, "id long, x array<double>, label string, y double").cache()


def test_neighbours_and_resampling(spark):
    df = blobs(spark)
    rows = df.collect()
    got = {(r["id"], r["rank"]): r["neighbour"] for r in knn.knn(df, df, 3).collect()}
    for r in rows:
        near = sorted((round(math.dist(r["x"], s["x"]), 9), s["id"]) for s in rows if s["id"] != r["id"])[:3]
        assert [got[r["id"], k] for k in (1, 2, 3)] == [i for _, i in near]
    assert knn.knn(df, df, 2, p=1).count() == 80
    sizes = {r["label"]: r["count"] for r in resample.smote(df).groupBy("label").count().collect()}
    assert set(sizes.values()) == {20}
    assert resample.remove_tomek(df).count() == 40 and resample.edited(df).count() == 40
    assert resample.adasyn(df).count() == 40  # no row has a neighbour of another class
    pred = knn.vote(knn.knn(df, df, 3), df.select("id", "label")).join(df, "id")
    assert pred.where("prediction <> label").count() == 0


@pytest.mark.parametrize("kind", ["gaussian", "lda", "qda"])
def test_generative(spark, kind):
    df = blobs(spark).select("label", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    state = bayes.FITS[kind][0](df, ["a", "b"], "label")
    assert bayes.predict(df, state, kind, ["a", "b"]).where("prediction <> label").count() == 0


def test_moments_of_many_columns(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12)), rng.integers(0, 3, 200)
    names = [f"c{i}" for i in range(12)]
    df = frame(spark, [(*map(float, r), f"k{c}") for r, c in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", y string")
    for k, (n, mean, cov) in bayes._moments(df, names, "y").items():
        own = x[y == int(k[1])]
        assert n == len(own) and mean == pytest.approx(own.mean(0)) and cov == pytest.approx(np.cov(own.T, bias=True))


SMALL = {"random_forest": {"n_estimators": 10}, "extra_trees": {"n_estimators": 10}, "adaboost": {"n_estimators": 10}, "sgd": {"max_iter": 8}, "svc": {"landmarks": 10}}


def two_blobs(spark):
    """Points of three classes, every coordinate above zero."""
    df = blobs(spark).select("id", (F.col("x")[0] + 5).alias("a"), (F.col("x")[1] + 5).alias("b"), "y")
    return models.assembled(df, ["a", "b"], "y", ["id"]).cache()


@pytest.mark.parametrize("name", sorted(set(models.DEFAULTS) - {"gradient_boosting", "xgboost", "lightgbm", "catboost"}))
def test_learners_separate_blobs_and_can_be_saved(spark, name, tmp_path):
    df = two_blobs(spark)
    model = models.fit(df, name, SMALL.get(name))
    out = models.score(model, df, ["id"])
    weak = {"ridge": 28, "bernoulli_nb": 20, "multinomial_nb": 10}  # squares hide the class between two others; shares of two coordinates tell little
    assert out.count() == 40 and out.where("prediction = label").count() >= weak.get(name, 38)
    if "probability" in out.columns:
        for r in out.collect():
            assert sum(r["probability"]) == pytest.approx(1) and (name == "svc" or r["probability"][int(r["prediction"])] == pytest.approx(max(r["probability"])))
    again = models.score(models.load(spark, models.save(model, spark, f"{tmp_path}/m")), df, ["id"])
    assert sorted(map(tuple, again.select("id", "prediction").collect())) == sorted(map(tuple, out.select("id", "prediction").collect()))
    with pytest.raises(ValueError):
        models.fit(df, "oracle")


@pytest.mark.parametrize("name", ["gradient_boosting"])
def test_boosting_by_hand(spark, name):
    """Two rounds on a step: each leaf's score is what logistic boosting by hand gives."""
    df = frame(spark, [(float(i), float(i >= 6)) for i in range(10)], "a double, y double")
    table = models.assembled(df, ["a"], "y").cache()
    model = models.fit(table, name, {"n_estimators": 2, "subsample": 1.0})
    rate = models.DEFAULTS[name]["learning_rate"]
    assert model.treeWeights == [1.0, rate] and model.getOrDefault("maxDepth") == models.DEFAULTS[name]["max_depth"]
    # the first tree fits labels of -1 and 1, the second the gradient 4y / (1 + exp(2yF)) at F of -1 and 1
    margin = 1 + rate * 4 / (1 + math.exp(2))
    for r in models.score(model, table).collect():
        p = 1 / (1 + math.exp(-2 * margin))
        assert r["prediction"] == r["label"] and max(r["probability"]) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("name, penalty, params", [("xgboost", 1.0, {"min_child_weight": 0.0, "subsample": 1.0}), ("lightgbm", 0.0, {"min_samples_leaf": 1}), ("catboost", 3.0, {})])
def test_second_order_boosting_by_hand(spark, name, penalty, params):
    """Two rounds of one split on a step of six rows and four: each side moves by its gradient over its penalised second derivative."""
    df = frame(spark, [(float(i), float(i >= 6)) for i in range(10)], "a double, y double")
    table = models.assembled(df, ["a"], "y").cache()
    rate, side = models.DEFAULTS[name]["learning_rate"], {}
    for y, n in ((0.0, 6), (1.0, 4)):
        score = 0.0 if name == "catboost" else math.log(0.4 / 0.6)
        for _ in range(2):
            p = 1 / (1 + math.exp(-score))
            score += rate * n * (y - p) / (n * p * (1 - p) + penalty)
        side[y] = 1 / (1 + math.exp(-score))
    out = models.score(models.fit(table, name, {"n_estimators": 2, "max_depth": 1} | params), table).collect()
    assert [r["probability"][1] for r in out] == pytest.approx([side[r["label"]] for r in out], abs=1e-9)
    if name == "lightgbm":  # by default a leaf has 20 rows at least, so ten rows keep the share of their class
        assert [r["probability"][1] for r in models.score(models.fit(table, name), table).collect()] == pytest.approx([0.4] * 10)


def test_logistic_regression_and_ridge_by_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2))
    y = (x @ [1.0, -2.0] + rng.normal(size=80) > 0).astype(float)
    df = frame(spark, [(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    table = models.assembled(df, ["a", "b"], "y").cache()
    one = np.column_stack([x, np.ones(80)])
    w = np.zeros(3)
    for _ in range(50):  # Newton's method; penalty 1 / (C n) on both weights, none on the intercept
        p = 1 / (1 + np.exp(-one @ w))
        penalty = np.diag([1 / 80, 1 / 80, 0])
        w -= np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) / 80 + penalty, one.T @ (p - y) / 80 + penalty @ w)
    m = models.fit(table, "logistic_regression")
    assert np.r_[m.coefficients.toArray(), m.intercept] == pytest.approx(w, abs=1e-3)
    c, s = x - x.mean(0), 2 * y - 1
    beta = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (s - s.mean()))
    got, intercept = models.fit(table, "ridge").state["fits"][0]
    assert got == pytest.approx(beta, abs=1e-6) and intercept == pytest.approx(s.mean() - x.mean(0) @ beta, abs=1e-6)


def test_adaboost_by_hand(spark):
    """The first stump errs on one of eight rows: its weight is log(7); the second weighs that row seven times."""
    df = frame(spark, [(float(i), float(i >= 4) if i != 7 else 0.0) for i in range(8)], "a double, y double")
    model = models.fit(models.assembled(df, ["a"], "y").cache(), "adaboost", {"n_estimators": 2})
    assert model.state["weights"][0] == pytest.approx(math.log(7))
    assert model.state["weights"][1] == pytest.approx(math.log((14 - 3) / 3))  # of the weights 1 x 7 and 7, the best stump errs on three


@pytest.mark.parametrize("classes", [2, 3])
def test_adaboost_by_loop(spark, classes):
    """Twelve rounds: each stump is the best split of the weights that a loop raises; scores are the loop's votes."""
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 9, (80, 2)).astype(float)
    y = (x[:, 0] * x[:, 1] > 12).astype(int) + (classes > 2) * (x[:, 1] > 6)
    df = models.assembled(frame(spark, [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, y int"), ["a", "b"], "y", ["id"]).cache()
    model = models.fit(df, "adaboost", {"n_estimators": 12})
    w, votes = np.ones(80), np.zeros((80, classes))
    gini = lambda rows: w[rows].sum() - sum(w[rows & (y == c)].sum() ** 2 for c in range(classes)) / max(w[rows].sum(), 1e-300)
    for weight, f, t, low, high in model.state["stumps"]:
        best, f2, t2 = min((gini(x[:, i] <= v) + gini(x[:, i] > v), i, v + 0.5) for i in (0, 1) for v in range(8))
        if low == high:  # a split whose sides have one class is pruned
            f, t = f2, t2
        side = x[:, f] <= t
        assert gini(side) + gini(~side) == pytest.approx(best)
        for rows, c in ((side, low), (~side, high)):
            shares = [w[rows & (y == k)].sum() for k in range(classes)]
            assert shares[int(c)] == pytest.approx(max(shares))
        said = np.where(side, low, high).astype(int)
        error = w[said != y].sum() / w.sum()
        assert weight == pytest.approx(math.log((1 - error) / error) + math.log(classes - 1))
        w = w * np.where(said != y, math.exp(weight), 1.0)
        votes[np.arange(80), said] += weight
    out = sorted(model.transform(df).select("id", "rawScores", "prediction").collect())
    assert len(model.state["stumps"]) == 12 and np.array([r["rawScores"] for r in out]) == pytest.approx(votes)
    assert [r["prediction"] for r in out] == votes.argmax(1).tolist()


def test_kernel_machine_parts_rings(spark):
    rng = np.random.default_rng(3)
    rows = [(float(r * math.cos(t)), float(r * math.sin(t)), y) for y, r in ((0.0, 1.0), (1.0, 3.0)) for t in rng.uniform(0, 2 * math.pi, 60)]
    df = models.assembled(frame(spark, rows, "a double, b double, y double"), ["a", "b"], "y").cache()
    right = lambda **p: models.score(models.fit(df, "svc", p), df).where("prediction = label").count()
    assert right(landmarks=40) == 120 > right(kernel="linear")
    mean = {r["label"]: r["p"] for r in models.score(models.fit(df, "svc", {"landmarks": 40}), df).groupBy("label").agg(F.avg(F.get("probability", F.lit(1))).alias("p")).collect()}
    assert mean[0.0] < 0.2 and mean[1.0] > 0.8  # calibrated margins


def test_the_saved_chain_scores_raw_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f" {rng.choice('AB')}$", None if i % 9 == 0 else rng.gauss(3 if i % 2 else -3, 1), "yes" if i % 2 else "no", "same") for i in range(200)]
    df = frame(spark, rows, "id long, t string, x double, y string, k string")
    one = chain.fit(df, "y", ["id"], "logistic_regression", {"max_iter": 50}, 5)
    two = chain.load(spark, one.save(spark, f"{tmp_path}/c"))
    raw = df.unionByName(df.where("id < 3")).unionByName(frame(spark, [(900, None, None, None, None)], "id long, t string, x double, y string, k string"))
    got = [sorted(map(tuple, c.score(raw, ["id"]).collect())) for c in (one, two)]
    assert got[0] == got[1] and len(got[0]) == 204  # repeated and empty rows stay
    truth = {r[0]: r[3] for r in rows}
    assert sum(truth[i] == p for i, p, _ in got[0] if i in truth and i % 9) >= 0.98 * 178


def test_features_are_ranked_by_importance(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1) + (i % 2), rng.gauss(0, 1000), 1.0, i % 2) for i in range(300)]
    df = frame(spark, rows, "a double, wide double, one double, y int")
    names = lambda **k: [r["feature"] for r in features.run(df, None, "y", 2, make=False, **k)[2].orderBy("rank").collect()]
    assert names()[0] == "a" and names(ranking="variance")[0] == "wide"
    assert features.importance_ranking(df.withColumn("y", F.lit(1)), "y", 1, ["a", "wide"]).first()["feature"] == "wide"  # one class: variance


def test_roc_auc_and_log_loss_as_tuning_metrics(spark):
    df = two_blobs(spark)
    two = df.where("label < 2").cache()
    for name in ("sgd", "gaussian_nb", "ridge", "knn"):
        assert tune.value(models.fit(two, name, SMALL.get(name)).transform(two), "roc_auc") == pytest.approx(1.0)
    assert tune.value(models.fit(df, "lda").transform(df), "roc_auc") == pytest.approx(1.0)
    with pytest.raises(ValueError, match="probabilities"):
        tune.value(models.fit(two, "sgd", {"max_iter": 3}).transform(two), "logLoss")
    trials = tune.run(two, "knn", method="grid", metric="roc_auc", space={"k": [1, 3], "weights": ["distance"], "p": [1]})[0]
    assert trials.count() == 2 and set(models.DEFAULTS) == set(tune.SPACES)


def test_ids_of_synthetic_rows(spark):
    """Dense, below zero and below the smallest id, whatever the ids."""
    rows = [(10**15 + i, [float(i), 1.0], "a" if i < 12 else "b") for i in range(15)] + [(-(10**15), [3.0, 2.0], "a")]
    out = resample.smote(frame(spark, rows, "id long, x array<double>, label string"))
    new = sorted(r["id"] for r in out.collect() if r["id"] not in {i for i, *_ in rows})
    assert new == list(range(-(10**15) - len(new), -(10**15))) and out.count() == 26


def test_running_sums_in_parts(spark):
    df = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["b"] for r in stats.running_before(df, F.col("v"), "k", "g", "b").collect()}
    seen = {}
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        assert got[r["id"]] == seen.get(r["g"], 0)
        seen[r["g"]] = seen.get(r["g"], 0) + r["v"]


def test_split_narrows_to_few_keys(spark, monkeypatch):
    df = spark.range(3000).withColumn("k", F.lit(1))
    whole = sorted(r["id"] for r in split.split_random(df, ["id"]).where("split = 'test'").collect())
    monkeypatch.setattr(split, "FEW_KEYS", 1)
    assert sorted(r["id"] for r in split.split_random(df, ["id"]).where("split = 'test'").collect()) == whole and len(whole) == 600
    assert split.split_random(df, ["k"]).where("split = 'test'").count() == 0  # rows of one key stay together


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MAX_CLASSES", 3)
    with pytest.raises(ValueError, match="classes"):
        evaluate.confusion(spark.range(4).select(F.col("id").alias("y"), F.col("id").alias("y_pred")))


def test_approximate_neighbours_recall(spark):
    """At least 0.9 of the pairs within the radius, by brute force; equal points find each other, too."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8))
    rows = [(i, [float(v) for v in centres[i % 30] + 0.1 * rng.normal(size=8)]) for i in range(600)] + [(1000 + i, [0.5] * 8) for i in range(20)]
    df = frame(spark, rows, "id long, x array<double>").cache()
    near = knn.knn(df, df, 619).where("distance <= 0.4").select("id", "neighbour")
    found = knn.approximate(df, df, 0.4).select("id", "neighbour")
    want = near.count()
    assert want > 1000 and near.join(found, ["id", "neighbour"]).count() >= 0.9 * want and found.where("id >= 1000 and neighbour >= 1000").count() == 380


@pytest.mark.parametrize("p", [1, 2])
def test_points_that_cells_do_not_part_meet_in_blocks(spark, monkeypatch, p):
    """Many dimensions: no query is sent to cells; equal to all pairs with groups, ties, equal points, far offsets, repeated ids and points that are not finite."""
    from tabforge.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 50)
    monkeypatch.setattr(blocks, "LEAST", 16)
    monkeypatch.setattr(knn, "CELL", 16)
    monkeypatch.setattr(knn, "_routed", None)
    rng = np.random.default_rng(p)
    x = rng.normal(size=(230, 24)) + 1e6
    x[40:60] = x[:20]
    x[60:80] = np.round(x[60:80])
    x[90, 3], x[91, 0] = np.inf, np.nan
    ids, g = np.arange(230) * 7 % 230, rng.integers(0, 2, 230).astype(str)
    ids[110] = ids[111]
    df = spark.createDataFrame([(int(i), list(map(float, a)), b) for i, a, b in zip(ids, x, g)], "id long, x array<double>, g string").repartition(3)
    with np.errstate(invalid="ignore"):
        far = np.round(np.abs(x[:, None] - x[None]).sum(2) if p == 1 else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    for within in (False, True):
        got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in knn.knn(df, df, 4, within, p=p).collect()}
        for i in set(ids.tolist()):
            near = sorted((far[a, b], ids[b]) for a in np.flatnonzero(ids == i) for b in range(230) if ids[b] != i and np.isfinite(far[a, b]) and (not within or g[a] == g[b]))[:4]
            assert [got[i, k + 1] for k in range(len(near))] == [(j, pytest.approx(v)) for v, j in near] and (i, len(near) + 1) not in got


def test_pairs_within_a_radius_are_all_and_not_shuffled(spark, monkeypatch):
    from tabforge.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 70)
    x = np.random.default_rng(3).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[200:220] = x[0]
    df = frame(spark, [(i, list(map(float, a))) for i, a in enumerate(x)], "id long, x array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    found = knn.approximate(df, df, 1.2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["id"], r["neighbour"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far <= 1.2))) if i != j}


def test_exponents_meet_distinct_values_alone(spark, monkeypatch):
    """Likelihoods are a plain loop's, for few and many values, some of them null; no row is multiplied by the exponents."""
    monkeypatch.setattr(power, "COUNTED", 50)
    rng = np.random.default_rng(8)
    columns = {"few": rng.integers(-3, 4, 700).astype(float), "many": rng.normal(0, 2, 700), "up": rng.gamma(2.0, 3.0, 700) + 0.1}
    rows = [tuple(None if i % 9 == k else float(v[i]) for k, v in enumerate(columns.values())) for i in range(700)]
    df = frame(spark, rows, "few double, many double, up double").repartition(3)
    lams = {c: power.grid() for c in columns}
    for method, names in ((power.YEO, ["few", "many", "up"]), (power.BOX, ["up"])):
        picked = {c: F.col(c) for c in names}
        plan = power._summed(df, picked, lams, method)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") == 2
        got = power._likelihoods(df, picked, lams, method)
        for c in names:
            x = np.array([r[list(columns).index(c)] for r in rows if r[list(columns).index(c)] is not None])
            for (value, lam), want in zip(got[c], lams[c], strict=True):
                if method == power.BOX:
                    v, jacobian = np.log(x) if lam == 0 else (x**lam - 1) / lam, np.log(x)
                else:
                    v = np.array([(math.log1p(z) if lam == 0 else ((z + 1) ** lam - 1) / lam) if z >= 0 else (-math.log1p(-z) if lam == 2 else -((1 - z) ** (2 - lam) - 1) / (2 - lam)) for z in x])
                    jacobian = np.sign(x) * np.log1p(np.abs(x))
                assert lam == want and value == pytest.approx(-len(x) / 2 * math.log(v.var()) + (lam - 1) * jacobian.sum())
    state, shape = power.fit(df, ["many"], power.YEO, refine=0)["many"], power.recommend(df, ["many", "up"], refine=0).orderBy("column").collect()
    out = df.select(power.transformed(F.col("many"), state).alias("x")).agg(F.avg("x"), F.stddev_pop("x"), F.skewness("x")).first()
    assert [out[0], out[1], out[2]] == pytest.approx([0.0, 1.0, shape[0]["skew_yeo_johnson"]], abs=1e-9) and set(state) == {"method", "shift", "exponent", "mean", "deviation"}
    passes, summed, lows = [], power._summed, power._lows
    monkeypatch.setattr(power, "_summed", lambda *a: passes.append("exponents") or summed(*a))
    monkeypatch.setattr(power, "_lows", lambda *a: passes.append("least") or lows(*a))
    power.recommend(df, ["many", "up"], refine=0)
    assert sorted(passes) == ["exponents", "exponents", "least"]
    assert power._likelihoods(df.where("false"), {"up": F.col("up")}, lams, power.BOX) == {"up": []}


def test_tuning_honours_the_direction(spark):
    df = models.assembled(blobs(spark).select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "y"), ["a", "b"], "y", ["id"]).cache()
    trials = tune.random_search(df, "logistic_regression", {"C": [1e-6, 100.0]}, 4, "logLoss", seed=3)[0].collect()
    best = next(r for r in trials if r["best"])
    assert best["value"] == min(r["value"] for r in trials)


def test_frozen_plan_serves_other_tables(spark):
    train = frame(spark, [(i, "  A$ " if i % 2 else "b", i * 1.0, 1) for i in range(10)], "id long, t string, x double, y int")
    test = frame(spark, [(99, "A", None, 1)], "id long, t string, x double, y int")
    a, b, plan = clean.run(train, test, ["id"], "y")
    assert a.columns == b.columns and b.first()["t"] == "a" and "y" in a.columns and plan.state()["drop"] == {}


def plain_quantile(values, p):
    """Linear interpolation in the sorted values."""
    v = sorted(x for x in values if x is not None)
    k = int(p * (len(v) - 1))
    return v[k] + (p * (len(v) - 1) - k) * (v[min(k + 1, len(v) - 1)] - v[k])


@pytest.mark.parametrize("most", [10_000, 40, 3])
def test_quantiles_by_narrowing(spark, most):
    """Exact whatever the number of values of a bracket; heavy values, nulls and a column without values."""
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 5)), None, rng.choice([1.0, 2.0, rng.random()]), i) for i in range(3000)] + [(None, 9.0, None, None, 7)]
    df = frame(spark, rows, "x double, y double, z double, w double, i int").cache()
    probabilities = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = stats.quantiles(df, ["x", "y", "z", "w", "i"], probabilities, most)
    assert got["z"] is None
    for j, c in ((0, "x"), (1, "y"), (3, "w"), (4, "i")):
        assert got[c] == pytest.approx([plain_quantile([r[j] for r in rows], p) for p in probabilities], abs=1e-12)
    assert stats.quantiles(df.where("false"), ["x"], [0.5]) == {"x": None} and stats.quantiles(df, [], [0.5]) == {}


def test_quantile_jobs_do_not_grow_with_columns(spark):
    df = spark.range(5000).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(30)])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 30):
        spark.sparkContext.setJobGroup(f"quantiles {n}", "")
        assert stats.quantiles(df, df.columns[:n], [0.25, 0.5, 0.75], 100)["c0"] == [1249.75, 2499.5, 3749.25]
        jobs.append(len(tracker.getJobIdsForGroup(f"quantiles {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 8


def test_nothing_is_lost_in_silence(spark):
    """Null labels are counted; labels without a probability, classes of one row, repeated ids, points of unequal length and negative counts raise errors."""
    import warnings

    from tabforge.operators import bayes, evaluate, resample
    from tabforge.operators import knn as K

    rows = spark.createDataFrame([(1, None), (None, 1), (None, None), (1, 1)], "y int, y_pred int")
    got = {(r["y"], r["y_pred"]): r["n"] for r in evaluate.confusion(rows).collect()}
    assert got == {(1, 1): 1, (1, None): 1, (None, 1): 1, (None, None): 1}
    for y in (2, None):
        odd = spark.createDataFrame([(0, 0.5, 0.5), (y, 0.5, 0.5)], "y int, p0 double, p1 double")
        with pytest.raises(Exception, match="no probability for the class"):
            evaluate.log_loss(odd, "y", {0: "p0", 1: "p1"}).collect()
    many = [(i, [float(i), 0.0], "a") for i in range(20)]
    for bad, say in ((many + [(50, [1.0, 1.0], "b")], "has one row"), (many + [(3, [1.0, 1.0], "b"), (60, [1.0, 2.0], "b")], "repeats"), (many + [(70, None, "b"), (71, [0.0, 1.0], "b")], "without")):
        with pytest.raises(ValueError, match=say):
            resample.smote(spark.createDataFrame(bad, "id long, x array<double>, label string"))
    far = spark.createDataFrame(many + [(100 + i, [1000.0 + i, 0.0], "b") for i in range(8)], "id long, x array<double>, label string")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert resample.adasyn(far).count() == 28
    assert any("['b']" in str(w.message) for w in said)
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0, 1.0])], "id long, x array<double>")
    with pytest.raises(Exception, match="unequal length"):
        K.knn(points, points, 1).collect()
    with pytest.raises(ValueError, match="negative"):
        bayes.multinomial_nb(spark.createDataFrame([(0, -1.0), (1, 2.0)], "y int, x double"), ["x"], "y")


def test_pairs_of_classes_by_loops(spark):
    """Each ordered pair's area, with labels that no class has left out."""
    import random

    from tabforge.operators import evaluate

    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 2, 9]), *(round(rng.random(), 1) for _ in range(3))) for _ in range(60)]
    areas = []
    for a in range(3):
        for b in range(3):
            if a != b:
                own, other = [r[1 + a] for r in rows if r[0] == a], [r[1 + a] for r in rows if r[0] == b]
                areas.append(sum((x > y) + (x == y) / 2 for x in own for y in other) / len(own) / len(other))
    got = evaluate.auc_ovo(spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double"), "y", {0: "p0", 1: "p1", 2: "p2"}).first()["value"]
    assert got == pytest.approx(sum(areas) / 6)


def test_descent_is_a_loop_over_the_hash_order(spark, monkeypatch):
    """Hinge loss, one row at a time; several shards are averaged by their rows; partitions do not matter."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from tabforge.operators import sgd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)).round(3)
    y = (x @ [1, -2, 0.5] > 0).astype(int)
    df = models.assembled(spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int"), ["a", "b", "c"], "y")
    hashed = df.select(vector_to_array("features").alias("x"), "label").withColumn("u", F.xxhash64("x", "label")).orderBy("u").collect()
    for size in (1 << 13, 32):
        monkeypatch.setattr(sgd, "SHARD", size)
        n, alpha = -(-90 // size), 0.01
        own, taken, w = [[r for r in hashed if r["u"] % n == s] for s in range(n)], 0, np.zeros(4)
        centre, width = x.mean(0), x.std(0)
        for _ in range(3):
            ends, means = [], []
            for rows in own:
                v, seen = w.copy(), []
                for i, r in enumerate(rows):
                    step = 1 / (alpha * (sgd.first_step(alpha, 4) + taken + i))
                    sign, at = (1 if r["label"] else -1), np.array([*(np.array(r["x"]) - centre) / width, 1.0])
                    short = sign * (v @ at) < 1
                    v[:3] *= 1 - step * alpha
                    if short:
                        v += step * sign * at
                    seen.append(v.copy())
                ends.append(v * len(rows))
                means.append(sum(seen))
            w, taken = sum(ends) / 90, taken + min(90, size)
        w = sum(means) / 90
        w = np.array([*w[:3] / width, w[3] - (w[:3] / width) @ centre])
        got = [sgd.fit(df.repartition(k), 2, alpha, 3) for k in (1, 5)]
        assert all(np.allclose([*a[0], b[0]], w) for a, b in got)
    model = models.fit(df, "sgd", {"alpha": 1e-3})
    assert model.transform(df).where("prediction <> label").count() <= 5


def test_landmark_features_approximate_the_kernel(spark):
    """With all points the products are the kernel; with a third of them within 0.1 on the mean, and closer than from as many points at random."""
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2)) * [1, 2] + rng.integers(0, 3, (90, 1)) * 4
    df = models.assembled(spark.createDataFrame([(i, *map(float, a), 0) for i, a in enumerate(x)], "id int, a double, b double, y int").repartition(4), ["a", "b"], "y", ["id"])
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))

    def error(marks):
        rows = models._kernel(df, {"marks": marks, "white": models.whitening(marks, 0.3), "gamma": 0.3}).select("id", vector_to_array("kernel").alias("k")).collect()
        k = np.array([r["k"] for r in sorted(rows, key=lambda r: r["id"])])
        return np.abs(k @ k.T - exact).mean()

    every, some = models.landmarks(df, 200), models.landmarks(df, 30)
    assert len(every) == 90 and error(every) < 1e-6 and len(some) == 30 == len({tuple(m) for m in some})
    assert error(some) < 0.1 and error(some) < np.mean([error(x[rng.permutation(90)[:30]].tolist()) for _ in range(3)])


def test_trials_run_at_once(spark, monkeypatch):
    """The same values and best point with any number of threads; four waits take the time of about one; halving ends on all rows."""
    import time

    df = blobs(spark).selectExpr("id", "x", "cast(y as double) as label")
    from pyspark.ml.functions import array_to_vector

    df = df.select("id", array_to_vector("x").alias("features"), "label").cache()
    one, four = (tune.grid_search(df, "decision_tree", {"max_depth": [1, 2, 3]}, cv=2, parallelism=p)[0].collect() for p in (1, 4))
    assert one == four
    began = time.time()
    assert tune._together([lambda i=i: time.sleep(1) or i for i in range(4)], 4) == [0, 1, 2, 3] and time.time() - began < 3
    trials = tune.halving_search(df, "decision_tree", {"max_depth": [1, 2, 3, 4], "min_samples_leaf": [1, 2]}, factor=2, least_rows=10)[0].collect()
    assert len(trials) == 8 and sum(r["best"] for r in trials) == 1
    assert next(r["value"] for r in trials if r["best"]) >= 0.8
    assert tune.random_search(df, "lda", {}, 5)[0].count() == 1


@pytest.mark.parametrize("p", [1, 2])
def test_cells_leave_no_neighbour_out(spark, monkeypatch, p):
    """Equal to all pairs with clusters, equal points, groups and more blocks than one; far fewer pairs are scored."""
    monkeypatch.setattr(knn, "CELL", 16)
    monkeypatch.setattr(knn, "BLOCK", 40)
    rng = np.random.default_rng(p)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.3 + c for c in ([0, 0], [9, 0], [0, 9], [20, 20], [9, 9])] + [np.zeros((70, 2))]).round(3)
    g = rng.integers(0, 2, len(x)).astype(str)
    df = spark.createDataFrame([(i, list(map(float, a)), b) for i, (a, b) in enumerate(zip(x, g))], "id long, x array<double>, g string").repartition(3)
    far = np.round(np.abs(x[:, None] - x[None]).sum(2) if p == 1 else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    for within in (False, True):
        got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in knn.knn(df, df, 4, within, p=p).collect()}
        assert len(got) == 4 * len(x)
        for i in range(len(x)):
            near = sorted((far[i, j], j) for j in range(len(x)) if j != i and (not within or g[i] == g[j]))[:4]
            assert [got[i, k + 1] for k in range(4)] == [(j, pytest.approx(v)) for v, j in near]
    assert knn.work(df, df, 4, p=p) < 0.5 * len(x) ** 2
    lonely = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "b")], "id long, x array<double>, g string")
    assert knn.knn(lonely, lonely, 3, within=True).count() == 0 and knn.knn(lonely, lonely.where("false"), 3).count() == 0
    assert [tuple(r)[:2] for r in knn.knn(lonely, lonely, 3, exclude_self=False).where("rank = 1").orderBy("id").collect()] == [(1, 1), (2, 2)]
