"""The rare-bucket one-hot stage: columns, unseen and null categories, and a saved bundle that scores alike."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ebbtide.operators import models
from ebbtide.operators.category_stage import RareOneHot, RareOneHotModel


@pytest.fixture(scope="module")
def rows(spark):
    kinds = ["b"] * 9 + ["a"] * 6 + ["rare"] * 4 + [None] * 7
    return spark.createDataFrame([(i, k, float(i % 3), float(k == "a" or i % 5 == 0)) for i, k in enumerate(kinds)], "id int, kind string, x double, y double")


def test_columns_and_the_last_bucket(spark, rows):
    model = RareOneHot(inputCol="kind", outputCol="hot").fit(rows)
    assert model.getOrDefault(model.categories) == ["a", "b"]
    asked = spark.createDataFrame([("a",), ("b",), ("rare",), ("new",), (None,), ("",)], "kind string")
    found = {r["kind"]: r["hot"] for r in model.transform(asked).collect()}
    assert model.transform(asked).columns == ["kind", "hot"]
    assert {k: (v.size, v.indices.tolist(), v.values.tolist()) for k, v in found.items()} == {
        "a": (3, [0], [1.0]), "b": (3, [1], [1.0]), "rare": (3, [2], [1.0]), "new": (3, [2], [1.0]), None: (3, [2], [1.0]), "": (3, [2], [1.0])}


def test_numbers_keep_their_order(spark):
    rows = spark.createDataFrame([(n,) for n in [10, 9, 100] for _ in range(5)] + [(7,)], "zip int")
    model = RareOneHot(inputCol="zip", outputCol="hot").fit(rows)
    assert model.getOrDefault(model.categories) == ["9", "10", "100"]
    assert {r["zip"]: r["hot"].indices.tolist() for r in model.transform(rows).collect()} == {9: [0], 10: [1], 100: [2], 7: [3]}


def test_no_frequent_category_and_too_many(spark, rows):
    model = RareOneHot(inputCol="kind", outputCol="hot", minRows=50).fit(rows)
    assert {(r["hot"].size, *r["hot"].indices.tolist()) for r in model.transform(rows).collect()} == {(1, 0)}
    assert RareOneHot(inputCol="kind", outputCol="hot").fit(rows.limit(0)).transform(rows).count() == rows.count()
    with pytest.raises(ValueError, match="more than 1"):
        RareOneHot(inputCol="kind", outputCol="hot", maxCategories=1).fit(rows)


def test_stage_is_saved_and_loaded(rows, tmp_path):
    stage = RareOneHot(inputCol="kind", outputCol="hot", minRows=3)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    assert RareOneHot.load(str(tmp_path / "stage")).getOrDefault("minRows") == 3
    model = stage.fit(rows)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = RareOneHotModel.load(str(tmp_path / "model"))
    assert again.getOrDefault("categories") == ["a", "b", "rare"]
    assert again.transform(rows).collect() == model.transform(rows).collect()


def test_bundle_with_the_stage_scores_alike(spark, rows, tmp_path):
    pipeline = Pipeline(stages=[
        RareOneHot(inputCol="kind", outputCol="hot"), VectorAssembler(inputCols=["hot", "x"], outputCol="features"),
        LogisticRegression(labelCol="y", maxIter=20)])
    model = pipeline.fit(rows)
    models.save_bundle(spark, model, str(tmp_path / "bundle"), 0.4, ["kind", "x"])
    loaded, threshold, features = models.load_bundle(spark, str(tmp_path / "bundle"))
    assert (threshold, features) == (0.4, ["kind", "x"])
    unseen = rows.withColumn("kind", F.when(F.col("id") % 4 == 0, "never").otherwise(F.col("kind")))
    scores = [{r["id"]: r["score"] for r in models.score_with(m, unseen).collect()} for m in (model, loaded)]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 3
