"""Alert decisions over event tables, history lookup, what-if tables, feedback rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import decisions as d
from ebbtide.functions.ordering import latest_before


def with_previous(events: DataFrame, key: str, order: Sequence[str], chunk: Column, fields: Sequence[str]) -> DataFrame:
    """The fields of the event before, per key, as struct ``previous`` (null for the first).

    Works in chunks of the event order, so a customer with very many events is spread out.
    """
    return latest_before(events, [key], order, chunk, F.struct(*fields), "previous")


def decide(events: DataFrame, now: Column, last_alert: Column) -> DataFrame:
    """Apply the alert policy; columns as in the alert request, ``previous_*`` may be null."""
    decision = d.alert_decision(
        F.col("risk_level"), F.col("churn_probability"), last_alert, now, F.col("response_status"),
        F.col("previous_churn_probability"), F.col("previous_risk_level"),
        F.col("is_vip_customer"), F.col("is_high_revenue_customer"))
    return events.withColumn("_d", decision).select(*events.columns, "_d.*")


def latest_history(log: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Newest log row per key, from an aggregate."""
    newest = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("h"))
    return newest.select(key, *[F.col(f"h.{f}").alias(f"last_{f}") for f in fields])


def with_history(customers: DataFrame, log: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return customers.join(latest_history(log, key, order, fields), key, "left")


def what_if(
    rows: DataFrame, scenarios: Sequence[tuple[str, float, float]], score: Callable[[DataFrame], DataFrame],
    keep: Sequence[str], threshold: float = 0.5,
) -> DataFrame:
    """Rescore every row under every scenario (name, ARPU discount, active-line boost).

    ``score`` adds ``probability`` from arpu, total_revenue, active_subscribers. Revenue kept
    is the discounted ARPU of a customer the scenario turns from churn to stay.
    """
    options = F.explode(F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(a)).alias("discount"), F.lit(float(b)).alias("boost")) for n, a, b in scenarios
    ]))
    before = score(rows).withColumnRenamed("probability", "before_probability")
    wide = before.withColumn("_s", options)
    changed = wide.withColumns({
        "arpu": F.greatest(F.lit(0.0), F.col("arpu") - F.col("_s.discount")),
        "total_revenue": F.greatest(F.lit(0.0), F.col("total_revenue") - F.col("_s.discount")),
        "active_subscribers": F.col("active_subscribers") + F.col("_s.boost"),
    })
    after = score(changed)
    was, now = F.col("before_probability"), F.col("probability")
    kept = (was >= threshold) & (now < threshold)
    return after.select(
        *keep, F.col("_s.scenario").alias("scenario"), was.alias("before_probability"), now.alias("after_probability"),
        (now - was).alias("delta"), (now - was < 0).alias("success"),
        F.when(kept, F.col("arpu")).otherwise(F.lit(0.0)).alias("expected_saved_revenue"))


def feedback(actions: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Action log rows with the outcome that became known, for retraining."""
    return actions.join(outcomes, key, "left")
