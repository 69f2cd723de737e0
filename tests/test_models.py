"""Model wrappers on small separable data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from ebbtide.operators import discriminant as da
from ebbtide.operators import models as m
from ebbtide.operators import ranking
from ebbtide.operators.sampling import stratified_split

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(int)
    x = rng.normal(size=(400, 3)) + y[:, None] * np.array([1.6, 0.8, 0.0])
    return pd.DataFrame(np.abs(x) + (x > 0), columns=FEATURES).assign(id=np.arange(400), y=y)


@pytest.fixture(scope="module")
def data(spark, table):
    rows = stratified_split(spark.createDataFrame(table), "id", "y", "s").persist()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def train(data):
    rows = m.with_balance_weight(m.assemble(data.where("split = 'train'"), FEATURES, "y", keep=["id"]), "y").persist()
    yield rows
    rows.unpersist()


def small(name, width=3):
    made = m.candidates(width)[name]
    if name == "boosting":
        return lambda y: GBTClassifier(labelCol=y, featuresCol=m.FEATURES, weightCol=m.WEIGHT, maxIter=5, maxDepth=2, seed=1)
    if name == "linear_svc":
        return lambda y: LinearSVC(labelCol=y, featuresCol=m.FEATURES, weightCol=m.WEIGHT, maxIter=10, regParam=0.1)
    if name == "perceptron":
        return lambda y: MultilayerPerceptronClassifier(labelCol=y, featuresCol=m.FEATURES, layers=[width, 4, 2], maxIter=20, seed=1)
    if name == "random_forest":
        return lambda y: RandomForestClassifier(labelCol=y, featuresCol=m.FEATURES, weightCol=m.WEIGHT, numTrees=10, maxDepth=4, seed=1)
    return made


def auc(scored):
    return ranking.roc_auc(scored, "y", "score").first()["roc_auc"]


def test_balance_weight(train):
    sums = {r["y"]: r["w"] for r in train.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0] == pytest.approx(sums[1])


@pytest.mark.parametrize("name", sorted(m.candidates(3)))
def test_every_family_fits_and_scores(data, train, name):
    model = small(name)("y").fit(train)
    scored = m.score_with(model, m.assemble(data, FEATURES, "y", keep=["id"]))
    assert scored.count() == 400 and set(scored.columns) == {"id", "y", m.FEATURES, "score"}
    if name != "bernoulli_nb":
        assert auc(scored) > 0.6


def test_bagging_stacking_and_calibration(train):
    bag = m.balanced_bagging(train, small("logistic_l2"), "id", "y", draws=2)
    assert auc(m.mean_score(train, bag)) > 0.7
    base, meta = m.stacked(train, {"l": small("logistic_l2"), "t": small("decision_tree")}, "id", "y")
    assert auc(m.stacked_score(train, base, meta)) > 0.7
    _, score = m.calibrated(train, small("linear_svc"), "id", "y")
    top = score(train).agg(F.min("score"), F.max("score")).first()
    assert 0 <= top[0] < top[1] <= 1


def test_out_of_fold_scores_cover_every_row_once(train):
    scores = m.out_of_fold_scores(train, small("logistic_l2"), "id", "y")
    assert scores.count() == train.count() == scores.select("id").distinct().count()


def test_sweep_records_failures(data):
    def broken(label):
        raise RuntimeError("no such library")

    table, fitted = m.sweep(data, {"ok": small("logistic_l2"), "bad": broken}, {"all": FEATURES, "one": ["c"]}, "id", "y")
    rows = table.collect()
    assert {(r["feature_set"], r["model"], r["status"]) for r in rows} == {
        ("all", "ok", "ok"), ("one", "ok", "ok"), ("all", "bad", "failed"), ("one", "bad", "failed")}
    assert {r["error"] for r in rows if r["status"] == "failed"} == {"no such library"} and len(fitted) == 2
    best = {r["feature_set"]: r["roc_auc"] for r in rows if r["status"] == "ok"}
    assert best["all"] > best["one"]


def test_cross_validated_search(train):
    lr = LogisticRegression(labelCol="y", featuresCol=m.FEATURES, maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 10.0]).build()
    found = m.cross_validated(train, lr, grid, "id", "y", folds=3)
    assert len(found.avgMetrics) == 2 and found.bestModel.getRegParam() in (0.01, 10.0)


def test_importance_permutation_and_ablation(spark, data, train):
    model = small("logistic_l2")("y").fit(train)
    table = {r["feature"]: r["importance"] for r in m.importance_table(spark, model, FEATURES, "l").collect()}
    assert set(table) == set(FEATURES) and table["a"] > table["c"]

    def score(rows):
        return m.score_with(model, m.assemble(rows, FEATURES, "y", keep=["id"]))

    drop = {r["feature"]: r["drop"] for r in m.permutation_drop(data.select("id", "y", *FEATURES), FEATURES, score, "id", "y").collect()}
    assert drop["a"] > drop["c"]
    sets = m.ablation_sets({"g1": ["a"], "g2": ["b", "c"]}, ["a", "b", "c"], tops=(1, 2))
    assert sets == {"baseline": ["a", "b", "c"], "remove_group:g1": ["b", "c"], "remove_group:g2": ["a"], "remove_top1": ["b", "c"], "remove_top2": ["c"]}


def test_python_scorer(data):
    scored = m.score_by_function(data.select("id", "y", *FEATURES), lambda f: f["a"] * 2, FEATURES)
    assert scored.where(F.abs(F.col("score") - 2 * F.col("a")) > 1e-12).count() == 0


def test_bundle_round_trip(spark, train, tmp_path):
    model = Pipeline(stages=[small("logistic_l2")("y")]).fit(train)
    m.save_bundle(spark, model, str(tmp_path / "b"), 0.42, FEATURES)
    again, threshold, features = m.load_bundle(spark, str(tmp_path / "b"))
    assert (threshold, features) == (0.42, FEATURES)
    a = m.score_with(model, train).agg(F.sum("score")).first()[0]
    assert m.score_with(again, train).agg(F.sum("score")).first()[0] == pytest.approx(a)
    assert m.decide(m.score_with(again, train), threshold).where("predicted = (score >= 0.42)").count() == train.count()


def test_text_columns_pipeline(spark):
    rows = spark.createDataFrame([(1.0, "x", 0), (2.0, "y", 1), (3.0, "y", 1), (0.5, None, 0)], "n double, t string, y int")
    model = m.feature_pipeline(["n"], ["t"]).fit(rows)
    assert model.transform(rows).select(m.FEATURES).count() == 4


def test_linear_discriminant_matches_the_closed_form(spark, table):
    x, y = table[FEATURES].to_numpy(), table["y"].to_numpy()
    pooled, weights, bias = np.zeros((3, 3)), {}, {}
    for k in (0, 1):
        part = x[y == k]
        z = (part - part.mean(0)) / part.std(0)
        n, p = z.shape
        s = z.T @ z / n
        mu = np.trace(s) / p
        beta = (((z ** 2).sum(1) ** 2).sum() / n - (s ** 2).sum()) / (p * n)
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        w = min(beta, delta) / delta
        shrunk = (1 - w) * s + w * mu * np.eye(p)
        pooled += len(part) / len(x) * (part.std(0)[:, None] * shrunk * part.std(0))
    for k in (0, 1):
        mean = x[y == k].mean(0)
        weights[k] = np.linalg.solve(pooled, mean)
        bias[k] = -0.5 * mean @ weights[k] + np.log((y == k).mean())
    rows = spark.createDataFrame(table).repartition(5)
    fitted = da.fit_linear(rows, FEATURES, "y")
    assert np.allclose(fitted.weights, weights[1] - weights[0]) and fitted.intercept == pytest.approx(bias[1] - bias[0])
    assert auc(rows.withColumn("score", fitted.score())) > 0.7


def test_quadratic_discriminant_matches_the_closed_form(spark, table):
    x, y = table[FEATURES].to_numpy(), table["y"].to_numpy()
    logs = {}
    for k in (0, 1):
        part = x[y == k]
        cov = 0.8 * np.cov(part.T) + 0.2 * np.eye(3)
        c = x - part.mean(0)
        logs[k] = np.log((y == k).mean()) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))
    rows = spark.createDataFrame(table)
    got = rows.withColumn("score", da.fit_quadratic(rows, FEATURES, "y", 0.2).score()).orderBy("id").toPandas()["score"]
    assert np.allclose(got, 1 / (1 + np.exp(logs[0] - logs[1])))
