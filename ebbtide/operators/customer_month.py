"""The customer-month table: one labelled row per entity at a snapshot day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import sanitised
from ebbtide.operators.windows_agg import (
    age_in_range,
    billing_profile,
    billing_rate_exprs,
    recency_exprs,
    usage_rate_exprs,
    usage_windows,
)


def member_profile(members: DataFrame, key: str = "entity_id") -> DataFrame:
    return members.select(
        key,
        "city",
        "region",
        F.coalesce("gender", F.lit("unknown")).alias("gender"),
        age_in_range("bd").alias("age"),
    )


def customer_month(
    labels: DataFrame,
    logs: DataFrame,
    transactions: DataFrame,
    members: DataFrame,
    *,
    usage_cutoff: str,
    usage_days: Sequence[int],
    usage_pairs: Sequence[tuple[int, int]],
    billing_cutoff: str,
    billing_days: Sequence[int],
    billing_pairs: Sequence[tuple[int, int]],
) -> DataFrame:
    """Left-join every source onto the labels, all on the same key.

    Each log is aggregated before the join, so rows of unlabelled entities shrink to one
    row per entity and disappear in the join; raw log rows are never shuffled.
    """
    wide = (
        labels.join(usage_windows(logs, usage_cutoff, usage_days), "entity_id", "left")
        .join(billing_profile(transactions, billing_cutoff, billing_days), "entity_id", "left")
        .join(member_profile(members), "entity_id", "left")
    )
    usage_recency = recency_exprs(usage_cutoff, ["first_log_date", "last_log_date"])
    billing_recency = recency_exprs(billing_cutoff, ["first_txn_date", "last_txn_date"], "max_expire_date")
    rates = usage_rate_exprs(usage_days, usage_pairs) | billing_rate_exprs(billing_days, billing_pairs)
    dates = ["first_log_date", "last_log_date", "first_txn_date", "last_txn_date", "max_expire_date", "latest_txn_date"]
    derived = usage_recency | billing_recency | rates
    full = wide.select(
        "entity_id",
        F.col("is_churn").alias("churn_next"),
        F.lit(billing_cutoff[:7]).alias("snapshot_month"),
        *[c for c in wide.columns if c not in {"entity_id", "is_churn", *dates}],
        *[expr.alias(name) for name, expr in derived.items()],
    )
    return sanitised(full, keep=["entity_id", "churn_next", "snapshot_month"])
