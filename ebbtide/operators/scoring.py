"""From requests to answers and log rows, and from a snapshot to a saved model that gives the same answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.ml.feature import RobustScaler, StandardScaler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import decisions as d
from ebbtide.operators import crm, models, payloads, ranking
from ebbtide.operators.feature_builder import AccountFeatures, FittedAccountFeatures
from ebbtide.operators.sampling import balanced_sample, oversample, stratified_split
from ebbtide.session import pin

# Where an alert goes, and why a quiet customer gets none.
ALERT_CHANNELS, NO_CHANNEL = "Slack,Gmail", "None"
QUIET_REASON = "Low-risk customers are logged without Slack/Gmail alerts."

#: Snapshot column of each request field.
SNAPSHOT_COLUMNS = {
    "Total_SUBs": "total_subs", "AvgMobileRevenue": "avg_mobile_revenue", "AvgFIXRevenue": "avg_fix_revenue", "TotalRevenue": "total_revenue",
    "ARPU": "arpu", "Active_subscribers": "active_subscribers", "Not_Active_subscribers": "not_active_subscribers",
    "Suspended_subscribers": "suspended_subscribers", "CRM_PID_Value_Segment": "crm_segment", "EffectiveSegment": "effective_segment",
}
Score = Callable[[DataFrame], DataFrame]


def request_features(requests: DataFrame) -> DataFrame:
    """The account features of training for typed requests; the request itself as struct ``request``."""
    raw = requests.select(
        F.struct(*requests.columns).alias("request"), *[F.col(c).alias(name) for name, c in SNAPSHOT_COLUMNS.items()])
    return crm.account_features(raw, keep=["request"])


def answered(requests: DataFrame, score: Score, threshold: Column | float, keep: Sequence[str] = ()) -> DataFrame:
    """One answer per typed request: scores, decision, risk, expected loss, alert channel, and the reason of a quiet one.

    ``score`` adds table_probability, sequence_probability (null where there is no such model) and trend_probability to the rows of
    ``request_features``. A request without a readable body is answered with the defaults of its fields.
    """
    scored = score(request_features(requests))
    p = d.ensemble_probability(
        F.col("table_probability"), F.col("sequence_probability"), F.col("trend_probability"), F.col("request.history_arpu"))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    blended = scored.withColumn("churn_probability", p).withColumn("prediction_threshold", limit)
    alert = F.coalesce(F.col("churn_probability") >= F.col("prediction_threshold"), F.lit(False))
    return blended.select(
        *[F.col(f"request.{c}").alias(c) for c in dict.fromkeys([*keep, "customer_id"])],
        "table_probability", "sequence_probability", "trend_probability", "churn_probability", "prediction_threshold",
        alert.alias("churn_prediction"), d.risk_level("churn_probability").alias("risk_level"),
        d.expected_loss(alert, F.col("request.arpu")).alias("expected_revenue_loss"), alert.alias("alert_required"),
        F.when(alert, ALERT_CHANNELS).otherwise(NO_CHANNEL).alias("alert_channel"),
        F.when(alert, "").otherwise(QUIET_REASON).alias("suppress_reason"), F.lit(True).alias("log_required"),
    )


def answered_batches(batches: DataFrame, batch: str, bodies: str, score: Score, threshold: Column | float) -> DataFrame:
    """Batches of request texts, answered and closed again: total_customers, alert_required_count and predictions in request order."""
    opened = batches.select(batch, F.posexplode(bodies).alias("position", "_body"))
    requests = payloads.with_request(opened, "_body").drop("_body")
    answers = answered(requests, score, threshold, keep=[batch, "position"])
    return payloads.close_envelope(answers, batch, "alert_required", "position")


def log_rows(closed: DataFrame, batch: str, day: Column) -> DataFrame:
    """One log row per answer of closed batches that asks for one, with the day it is filed under."""
    opened = closed.select(batch, F.inline("predictions"))
    return opened.where("log_required").withColumn("log_day", day)


def answered_snapshot(raw: DataFrame, score: Score, threshold: Column | float, group: str = "KA_name", row_id: str = "PID") -> DataFrame:
    """Every line of a snapshot answered, with the risk of its account group."""
    given = crm.with_columns_present(raw, Suspended_subscribers=F.lit(0.0))
    typed = given.select(
        F.col(row_id).cast("string").alias("customer_id"), F.col(group).alias("group"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(name) if name not in ("crm_segment", "effective_segment")
          else F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(name) for c, name in SNAPSHOT_COLUMNS.items()],
        F.lit(None).cast("array<double>").alias("history_arpu"))
    per_line = F.when((F.col("arpu") == 0) & (F.col("total_subs") > 0), F.col("total_revenue") / F.col("total_subs"))
    typed = typed.withColumn("arpu", F.coalesce(per_line, F.col("arpu")))
    return crm.with_group_risk(answered(typed, score, threshold, keep=["group"]), "group")


# ---- training -----------------------------------------------------------------------

SAMPLERS = ("none", "oversample", "undersample")
SCALERS = {"none": None, "standard": StandardScaler, "robust": RobustScaler}


def resampled(train: DataFrame, sampler: str, row_id: str, label: str, seed: str) -> DataFrame:
    """Training rows as they are, with repeated minority rows, or with as many others as minority rows."""
    if sampler == "oversample":
        return oversample(train, row_id, label, seed).drop("copy")
    if sampler == "undersample":
        return balanced_sample(train, row_id, label, seed)
    if sampler != "none":
        raise ValueError(f"unknown sampler {sampler!r}")
    return train


def scaled(train: DataFrame, scaler: str) -> tuple[Model | None, DataFrame]:
    """A fitted scaler of the feature vector, and the rows with scaled features."""
    if scaler not in SCALERS:
        raise ValueError(f"unknown scaler {scaler!r}")
    kind = SCALERS[scaler]
    if kind is None:
        return None, train
    options = {"withMean": True, "withStd": True} if scaler == "standard" else {"withCentering": True, "withScaling": True}
    model = kind(inputCol=models.FEATURES, outputCol="_scaled", **options).fit(train)
    return model, model.transform(train).drop(models.FEATURES).withColumnRenamed("_scaled", models.FEATURES)


class TrainedChurn:
    """Fitted account features, an optional scaler, a model and its threshold: everything that scoring needs."""

    def __init__(self, features: FittedAccountFeatures, scaler: Model | None, model: Model, threshold: float, metrics: Mapping[str, float]) -> None:
        self.features, self.scaler, self.model = features, scaler, model
        self.threshold, self.metrics = threshold, dict(metrics)

    def score(self, raw: DataFrame, keep: Sequence[str] = (), out: str = "score") -> DataFrame:
        """(row id, score, predicted) of snapshot rows, encoded with what was fitted; the features are written once."""
        encoded = pin(self.features.transform(raw))
        vectors = models.assemble(encoded, self.features.feature_columns, self.features.label, keep=[self.features.row_id])
        return self._decided(vectors, out)

    def _decided(self, vectors: DataFrame, out: str) -> DataFrame:
        if self.scaler is not None:
            vectors = self.scaler.transform(vectors).drop(models.FEATURES).withColumnRenamed("_scaled", models.FEATURES)
        scored = models.score_with(self.model, vectors, out).drop(models.FEATURES)
        return models.decide(scored, self.threshold, out)

    def save(self, spark: SparkSession, path: str) -> None:
        """The bundle: stages, threshold and feature list, the fitted tables, and how the features were built."""
        stages = [s for s in (self.scaler, self.model) if s is not None]
        models.save_bundle(spark, PipelineModel(stages), path, self.threshold, self.features.feature_columns)
        self.features.save_tables(f"{path}/tables")
        f = self.features
        info = {"row_id": f.row_id, "label": f.label, "mode": f.mode, "smoothing": f.smoothing, "folds": f.folds, "prior": f.prior,
                "tables": sorted(f.tables), "scaled": self.scaler is not None, "metrics": self.metrics}
        spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedChurn:
        pipeline, threshold, _ = models.load_bundle(spark, path)
        info = json.loads(spark.read.text(f"{path}/features").first()["value"])
        empty = FittedAccountFeatures(info["row_id"], info["label"], info["mode"], info["smoothing"], info["folds"], info["prior"], {})
        features = empty.with_saved_tables(spark, f"{path}/tables", info["tables"])
        scaler = pipeline.stages[0] if info["scaled"] else None
        return cls(features, scaler, pipeline.stages[-1], threshold, info["metrics"])


def train_churn(
    snapshot: DataFrame, row_id: str, label: str, make: models.Factory, *, mode: str = "encoded", sampler: str = "none",
    scaler: str = "none", with_pid: bool = False, seed: str = "42",
) -> TrainedChurn:
    """From a raw snapshot to a trained model: split, features fitted on training rows, scaling, sampling, fit, threshold.

    Training rows are encoded out of fold; the threshold has the highest F1 on the validation rows and is measured on the
    test rows. Rows without a readable answer take no part. The scaler is fitted before rows are repeated or left out.
    """
    labelled = snapshot.where(F.col(label).isNotNull())
    split = pin(stratified_split(labelled, row_id, label, seed))
    train = split.where("split = 'train'").drop("split")
    features, encoded = AccountFeatures(row_id, label, mode, with_pid=with_pid).fit_transform(train)
    vectors = pin(models.assemble(encoded, features.feature_columns, label, keep=[row_id]))
    fitted_scaler, vectors = scaled(vectors, scaler)
    ready = models.with_balance_weight(resampled(vectors, sampler, row_id, label, seed), label)
    trained = TrainedChurn(features, fitted_scaler, make(label).fit(ready), 0.5, {})
    rest = split.where("split <> 'train'")
    scored = trained.score(rest.drop("split")).join(rest.select(row_id, "split"), row_id)
    measured = ranking.tuned_evaluation(scored, label, "score", "split").first().asDict()
    metrics = {k: float(v) for k, v in measured.items() if v is not None}
    return TrainedChurn(features, fitted_scaler, trained.model, metrics.get("threshold", 0.5), metrics)
