"""Batch answers, log rows, and a trained bundle that answers alike after it is loaded."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ebbtide.operators import models, payloads, scoring
from ebbtide.sources import files


def customer(name, **more):
    return json.dumps({"customer_id": name, "total_subs": 4, "avg_mobile_revenue": 70, "avg_fix_revenue": 30, "total_revenue": 100,
                       "arpu": 25, "active_subscribers": 2, "not_active_subscribers": 1, "suspended_subscribers": 1} | more)


def given_scores(values):
    def score(rows):
        table = F.coalesce(*[F.when(F.col("request.customer_id") == k, F.lit(v)) for k, v in values.items()], F.lit(0.1))
        return rows.withColumns({"table_probability": table, "sequence_probability": F.lit(None).cast("double"), "trend_probability": table})
    return score


def test_two_customers_one_alert(spark):
    """The published case: probabilities .83 and .44, one alert."""
    batches = spark.createDataFrame([("batch-test", [customer("B2B-1"), customer("B2B-2")])], "batch_id string, bodies array<string>")
    closed = scoring.answered_batches(batches, "batch_id", "bodies", given_scores({"B2B-1": 0.83, "B2B-2": 0.44}), 0.5)
    (row,) = closed.collect()
    assert (row.batch_id, row.total_customers, row.alert_required_count) == ("batch-test", 2, 1)
    first, second = row.predictions
    assert (first.customer_id, first.risk_level, first.alert_required, first.alert_channel, first.suppress_reason) == (
        "B2B-1", "Critical", True, "Slack,Gmail", "")
    assert (second.customer_id, second.alert_required, second.alert_channel, second.suppress_reason) == (
        "B2B-2", False, "None", scoring.QUIET_REASON)
    assert (first.expected_revenue_loss, second.expected_revenue_loss) == (25.0, 0.0)


def test_unreadable_requests_and_empty_batches(spark):
    rows = [(1, ["[]", "no", None, customer("a", history_arpu=[1, 2, 3])]), (2, []), (3, None)]
    closed = scoring.answered_batches(
        spark.createDataFrame(rows, "batch_id int, bodies array<string>"), "batch_id", "bodies", given_scores({"a": 0.9, "": 0.2}), 0.5)
    (row,) = closed.collect()
    assert [p.customer_id for p in row.predictions] == ["", "", "", "a"] and row.alert_required_count == 1
    assert [p.position for p in row.predictions] == [0, 1, 2, 3]


def test_log_is_appended_and_found_again(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        batches = spark.createDataFrame([(day, [customer("a"), customer("b")])], "batch_id string, bodies array<string>")
        closed = scoring.answered_batches(batches, "batch_id", "bodies", given_scores({"a": 0.9}), 0.5)
        files.append_log(scoring.log_rows(closed, "batch_id", F.lit(day).cast("date")), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and log.where("log_day = '2024-01-02' and alert_required").count() == 1


def test_features_of_a_request_are_those_of_training(spark):
    typed = payloads.with_request(spark.createDataFrame([(customer("x"),)], "body string"), "body")
    row = scoring.request_features(typed).first()
    assert row["Suspended_Ratio"] == 0.25 and row["Revenue_per_Active_Sub"] == 50 and row["Inactive_x_Revenue"] == 25
    assert row["Revenue_Balance"] == pytest.approx(30 / (70 + 1e-5)) and row["request"]["customer_id"] == "x"


def test_snapshot_answers_with_group_risk(spark, feeds):
    def score(rows):
        return rows.withColumns({"table_probability": F.col("Inactive_Ratio"), "sequence_probability": F.lit(None).cast("double"),
                                 "trend_probability": F.col("Suspended_Ratio")})

    lines = feeds.crm_accounts()
    found = scoring.answered_snapshot(lines, score, 0.3).toPandas()
    assert len(found) == lines.count()
    top = found.groupby("group")["churn_probability"].transform("max")
    assert (found["group_max_prob"] == top).all() and (found["group_alert"] == (top >= 0.7)).all()
    assert (found["alert_required"] == (found["churn_probability"] >= 0.3)).all() and found["alert_required"].any()


@pytest.fixture(scope="module")
def snapshot(feeds):
    lines = feeds.crm_accounts().withColumn("row_id", F.concat_ws("/", "PID", "EffectiveSegment"))
    return lines.withColumn("y", F.when(F.trim("CHURN") == "Yes", 1.0).when(F.trim("CHURN") == "no", 0.0)).drop("CHURN")


def test_snapshot_to_a_reloaded_bundle(spark, snapshot, tmp_path):
    make = lambda y: LogisticRegression(labelCol=y, featuresCol="features", weightCol="weight", maxIter=10, regParam=0.05)
    trained = scoring.train_churn(snapshot, "row_id", "y", make, mode="engineered", sampler="oversample", scaler="robust", with_pid=True)
    assert 0 <= trained.threshold <= 1 and 0 <= trained.metrics["f1"] <= 1
    trained.save(spark, str(tmp_path / "bundle"))
    loaded = scoring.TrainedChurn.load(spark, str(tmp_path / "bundle"))
    assert loaded.threshold == trained.threshold and loaded.metrics == trained.metrics
    asked = snapshot.limit(60)
    scores = [{r["row_id"]: (r["score"], r["predicted"]) for r in t.score(asked).collect()} for t in (trained, loaded)]
    assert scores[0] == scores[1] and len({s for s, _ in scores[0].values()}) > 5


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame([(i, float(i < 5), float(i), i * i / 7) for i in range(30)], "row_id int, y double, a double, b double")
    return models.assemble(rows, ["a", "b"], "y", keep=["row_id"])


def test_samplers(vectors):
    sizes = {s: {r["y"]: r["count"] for r in scoring.resampled(vectors, s, "row_id", "y", "s").groupBy("y").count().collect()}
             for s in scoring.SAMPLERS}
    assert sizes == {"none": {1.0: 5, 0.0: 25}, "oversample": {1.0: 25, 0.0: 25}, "undersample": {1.0: 5, 0.0: 5}}


def test_scalers(vectors):
    raw = np.array([r["features"].toArray() for r in vectors.orderBy("row_id").collect()])
    for name, centre in (("standard", raw.mean(axis=0)), ("robust", np.median(raw, axis=0))):
        model, done = scoring.scaled(vectors, name)
        got = np.array([r["features"].toArray() for r in done.orderBy("row_id").collect()])
        assert done.columns == ["row_id", "y", "features"]
        spread = raw.std(axis=0, ddof=1) if name == "standard" else np.quantile(raw, 0.75, axis=0) - np.quantile(raw, 0.25, axis=0)
        assert np.allclose(got, (raw - centre) / spread, atol=0.2)
        again = [r["_scaled"].toArray() for r in model.transform(vectors).orderBy("row_id").collect()]
        assert np.allclose(got, again)
    assert scoring.scaled(vectors, "none")[0] is None


def test_unknown_choices(spark, snapshot):
    with pytest.raises(ValueError, match="sampler"):
        scoring.resampled(snapshot, "other", "row_id", "y", "s")
    with pytest.raises(ValueError, match="scaler"):
        scoring.scaled(snapshot, "other")
