"""The column set shared by all source domains, and how domains are mapped onto it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.numeric import finite

# The 39 shared feature columns, all double.
COMMON_COLUMNS = (
    "monthly_revenue", "mobile_revenue", "fixed_revenue", "total_revenue", "arpu", "tenure", "total_subs",
    "active_subs", "inactive_subs", "suspended_subs", "active_ratio", "inactive_ratio", "suspended_ratio",
    "revenue_per_active_sub", "inactive_x_revenue", "revenue_balance", "usage_minutes", "usage_seconds",
    "usage_frequency", "sms_frequency", "distinct_contacts", "skip_rate", "completion_rate", "diversity_score",
    "dropped_calls", "blocked_calls", "unanswered_calls", "customer_care_calls", "revenue_change",
    "minutes_change", "complaints", "retention_calls", "contract_risk", "service_status", "customer_value",
    "age", "zip_code", "segment_code", "dataset_code",
)


def common_schema(label: str = "churn") -> T.StructType:
    fields = [T.StructField(c, T.DoubleType()) for c in COMMON_COLUMNS]
    return T.StructType([*fields, T.StructField(label, T.IntegerType())])


def to_common(source: DataFrame, mapping: Mapping[str, Column | str], keep: Sequence[str] = (), fill: bool = False) -> DataFrame:
    """Project a source onto the shared columns in their fixed order.

    Columns outside the mapping are null. ``fill`` removes NaN and infinities and puts 0
    in every gap, as the wide anonymous sources want it.
    """
    unknown = set(mapping) - set(COMMON_COLUMNS)
    if unknown:
        raise ValueError(f"not shared columns: {sorted(unknown)}")
    out = []
    for name in COMMON_COLUMNS:
        value = mapping.get(name)
        expr = F.lit(None) if value is None else F.expr(value) if isinstance(value, str) else value
        expr = expr.cast("double")
        if fill:
            expr = F.coalesce(finite(expr), F.lit(0.0))
        out.append(expr.alias(name))
    return source.select(*keep, *out)


def empty_common(spark: SparkSession, label: str = "churn") -> DataFrame:
    """What an absent optional source contributes: no rows, the right columns."""
    return spark.createDataFrame([], common_schema(label))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all sources; columns one source lacks are null there."""
    if not frames:
        raise ValueError("no source to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def signal_pool(parts: Sequence[DataFrame], prefix: str = "fusion_", keep: Sequence[str] = ()) -> DataFrame:
    """Signal tables of several domains under one prefix, gaps as 0."""
    pool = union_sources(parts)
    return pool.select(*keep, *[
        F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(prefix + c) for c in pool.columns if c not in keep
    ])
