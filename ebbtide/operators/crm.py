"""Account-snapshot cleaning and feature expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.numeric import (
    balance,
    flag,
    log1p_positive,
    numbers,
    or_zero,
    ratio,
    share,
    sqrt_positive,
)
from ebbtide.functions.text import filled_category, joined, yes_no, zip_text
from ebbtide.session import pin

NUMBERS = (
    "Billing_ZIP", "Active_subscribers", "Not_Active_subscribers", "Suspended_subscribers", "Total_SUBs",
    "AvgMobileRevenue", "AvgFIXRevenue", "TotalRevenue", "ARPU",
)
SEGMENTS = ("CRM_PID_Value_Segment", "EffectiveSegment", "KA_name")


def tidy_header(frame: DataFrame) -> DataFrame:
    """Strip names, make a double space single, then spaces to underscores."""
    return frame.toDF(*[c.strip().replace("  ", " ").replace(" ", "_") for c in frame.columns])


def with_columns_present(frame: DataFrame, **defaults: Column) -> DataFrame:
    """Create the named columns a snapshot may lack."""
    missing = {name: value for name, value in defaults.items() if name not in frame.columns}
    return frame.withColumns(missing) if missing else frame


def account_features(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Clean snapshot columns for training and scoring alike.

    ARPU is filled from revenue per line where lines exist; ratios are 0 for a zero or
    missing denominator and limited to [0, 1]; categories are filled; the target is 1/0
    or null for an unreadable answer.
    """
    df = with_columns_present(raw, Suspended_subscribers=F.lit(0.0))
    lines, revenue = F.col("Total_SUBs"), F.col("TotalRevenue")
    arpu = F.when(F.col("ARPU").isNull() & (lines > 0), revenue / lines).otherwise(F.col("ARPU"))
    inactive = or_zero("Not_Active_subscribers")
    inactive_ratio = share(inactive, lines)
    target = [yes_no("CHURN").alias("y")] if "CHURN" in df.columns else []
    return df.select(
        *keep,
        lines.cast("double").alias("Total_SUBs"),
        F.col("AvgMobileRevenue"),
        F.col("AvgFIXRevenue"),
        revenue.alias("TotalRevenue"),
        arpu.alias("ARPU"),
        share("Active_subscribers", lines).alias("Active_Ratio"),
        inactive.alias("Not_Active_subscribers"),
        share("AvgMobileRevenue", revenue).alias("Mobile_Revenue_Ratio"),
        inactive_ratio.alias("Inactive_Ratio"),
        share(or_zero("Suspended_subscribers"), lines).alias("Suspended_Ratio"),
        ratio(revenue, "Active_subscribers").alias("Revenue_per_Active_Sub"),
        (inactive_ratio * or_zero(revenue)).alias("Inactive_x_Revenue"),
        balance("AvgMobileRevenue", "AvgFIXRevenue").alias("Revenue_Balance"),
        F.coalesce("CRM_PID_Value_Segment", F.lit("Unknown")).alias("CRM_PID_Value_Segment"),
        F.coalesce("EffectiveSegment", F.lit("Unknown")).alias("EffectiveSegment"),
        *target,
    )


def labelled_accounts(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Training rows: those with a readable answer."""
    return account_features(raw, keep).where(F.col("y").isNotNull())


def prepared(raw: DataFrame) -> DataFrame:
    """Numbers coerced, gaps flagged before they are filled, categories and crosses added."""
    df = raw.withColumns(numbers(raw, NUMBERS))
    df = df.withColumns({
        "not_active_missing": F.col("Not_Active_subscribers").isNull().cast("double"),
        "suspended_missing": F.col("Suspended_subscribers").isNull().cast("double"),
        "arpu_missing": F.col("ARPU").isNull().cast("double"),
        "billing_zip_missing": F.col("Billing_ZIP").isNull().cast("double"),
    })
    df = df.withColumns({
        "Not_Active_subscribers": or_zero("Not_Active_subscribers"),
        "Suspended_subscribers": or_zero("Suspended_subscribers"),
        "ARPU": F.coalesce("ARPU", ratio("TotalRevenue", "Total_SUBs")),
        **{c: filled_category(c) for c in SEGMENTS},
        "zip_text": zip_text("Billing_ZIP"),
        "account_id": filled_category("PID"),
    })
    return df.withColumns(zip_parts() | crosses())


def zip_parts() -> dict[str, Column]:
    return {
        "zip_prefix_1": F.substring("zip_text", 1, 1),
        "zip_prefix_2": F.substring("zip_text", 1, 2),
        "zip_bucket": F.floor(F.coalesce("Billing_ZIP", F.lit(-1.0)) / 100.0).cast("double"),
    }


def crosses() -> dict[str, Column]:
    crm, effective, account, area = "CRM_PID_Value_Segment", "EffectiveSegment", "KA_name", "zip_text"
    return {
        "crm_effective": joined([crm, effective]),
        "crm_account": joined([crm, account]),
        "effective_account": joined([effective, account]),
        "account_zip": joined([account, area]),
        "segment_zip": joined([crm, area]),
        "crm_effective_account": joined([crm, effective, account]),
    }


CATEGORIES = (
    "CRM_PID_Value_Segment", "EffectiveSegment", "zip_text", "KA_name", "crm_effective", "crm_account",
    "effective_account", "account_zip", "segment_zip", "crm_effective_account",
)
CATEGORY_MODES = {
    "core": CATEGORIES[:2],
    "encoded": CATEGORIES,
    "encoded_without_account": tuple(c for c in CATEGORIES if "account" not in c and c != "KA_name"),
    "encoded_compact": ("CRM_PID_Value_Segment", "EffectiveSegment", "zip_text", "crm_effective", "segment_zip"),
}


def derived_features() -> dict[str, Column]:
    """Ratios, differences and flags over a prepared snapshot."""
    active, inactive, suspended = (F.col(c) for c in ("Active_subscribers", "Not_Active_subscribers", "Suspended_subscribers"))
    lines, mobile, fixed = F.col("Total_SUBs"), F.col("AvgMobileRevenue"), F.col("AvgFIXRevenue")
    revenue, arpu = F.col("TotalRevenue"), F.col("ARPU")
    dormant = inactive + suspended
    per_line = ratio(revenue, lines)
    return {
        "dormant_subscribers": dormant,
        "active_ratio": share(active, lines),
        "inactive_ratio": share(inactive, lines),
        "suspended_ratio": share(suspended, lines),
        "dormant_ratio": share(dormant, lines),
        "mobile_revenue_ratio": share(mobile, revenue),
        "fixed_revenue_ratio": share(fixed, revenue),
        "mobile_to_fixed_ratio": ratio(mobile, fixed),
        "fixed_to_mobile_ratio": ratio(fixed, mobile),
        "revenue_per_sub": per_line,
        "revenue_per_active": ratio(revenue, active),
        "mobile_per_sub": ratio(mobile, lines),
        "fixed_per_sub": ratio(fixed, lines),
        "mobile_per_active": ratio(mobile, active),
        "fixed_per_active": ratio(fixed, active),
        "inactive_x_revenue": share(inactive, lines) * or_zero(revenue),
        "suspended_x_revenue": share(suspended, lines) * or_zero(revenue),
        "revenue_balance": balance(mobile, fixed),
        "arpu_minus_revenue_per_sub": arpu - per_line,
        "arpu_ratio_to_calc": ratio(arpu, per_line),
        "active_minus_dormant": active - dormant,
        "inactive_minus_suspended": inactive - suspended,
        "active_to_dormant_ratio": ratio(active, dormant),
        "subs_minus_active": lines - active,
        "has_inactive": flag(inactive > 0),
        "has_suspended": flag(suspended > 0),
        "has_dormant": flag(dormant > 0),
        "multi_subscriber": flag(lines > 1),
        "large_account": flag(lines >= 10),
        "zero_fixed_revenue": flag(fixed == 0),
        "zero_mobile_revenue": flag(mobile == 0),
        "mobile_only": flag((mobile > 0) & (fixed == 0)),
        "fixed_only": flag((fixed > 0) & (mobile == 0)),
        "revenue_zero": flag(revenue == 0),
    }


SCALED = {
    "active_subscribers": "Active_subscribers",
    "not_active_subscribers": "Not_Active_subscribers",
    "suspended_subscribers": "Suspended_subscribers",
    "dormant_subscribers": "dormant_subscribers",
    "total_subs": "Total_SUBs",
    "avg_mobile_revenue": "AvgMobileRevenue",
    "avg_fix_revenue": "AvgFIXRevenue",
    "total_revenue": "TotalRevenue",
    "arpu": "ARPU",
    "revenue_per_sub": "revenue_per_sub",
    "revenue_per_active": "revenue_per_active",
}


def with_derived(df: DataFrame) -> DataFrame:
    """Add the derived columns and the log/root forms of the skewed ones."""
    wide = df.withColumns(derived_features())
    shaped = {f"log1p_{n}": log1p_positive(c) for n, c in SCALED.items()}
    shaped |= {f"sqrt_{n}": sqrt_positive(c) for n, c in SCALED.items()}
    return wide.withColumns(shaped)


# ---- account-level aggregates -------------------------------------------------------

PID_SUMS = {
    "pid_active_sum": "Active_subscribers",
    "pid_not_active_sum": "Not_Active_subscribers",
    "pid_suspended_sum": "Suspended_subscribers",
    "pid_subs_sum": "Total_SUBs",
    "pid_mobile_sum": "AvgMobileRevenue",
    "pid_fixed_sum": "AvgFIXRevenue",
    "pid_revenue_sum": "TotalRevenue",
}
PID_DISTINCT = {
    "pid_zip_distinct": "zip_text",
    "pid_account_distinct": "KA_name",
    "pid_value_segment_distinct": "CRM_PID_Value_Segment",
    "pid_effective_segment_distinct": "EffectiveSegment",
}


def pid_aggregates(df: DataFrame, key: str = "account_id", only: Column | None = None) -> DataFrame:
    """Statistics per account id over a prepared snapshot: all rows, or those where ``only`` holds (training rows).

    One pass over the snapshot sums each combination of an account and its four categories; the combinations are written once. They,
    not the rows, are then listed once per category, so that each value of an account is counted once: no set of
    values is gathered, and an account with most of the rows is summed where its rows are. Deviations are taken from the
    account's mean, part by part.
    """
    values, revenue = list(PID_DISTINCT.values()), F.col("TotalRevenue").cast("double")
    parts = pin((df if only is None else df.where(only)).groupBy(key, *values).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in PID_SUMS.items()],
        F.count("Total_SUBs").alias("n_subs"), F.max("Total_SUBs").alias("max_subs"),
        F.count(revenue).alias("n_revenue"), F.avg(revenue).alias("mean_revenue"), F.max(revenue).alias("max_revenue"),
        (F.var_pop(revenue) * F.count(revenue)).alias("spread"),
        F.count("ARPU").alias("n_arpu"), F.sum("ARPU").alias("sum_arpu"), F.max("ARPU").alias("max_arpu"),
    ))
    means = parts.groupBy(key).agg(F.try_divide(F.sum(F.col("n_revenue") * F.col("mean_revenue")), F.sum("n_revenue")).alias("_mean"))
    apart = F.col("mean_revenue") - F.col("_mean")
    spread = F.col("spread") + F.col("n_revenue") * apart * apart
    parts = parts.join(means.withColumnRenamed(key, "_of"), F.col(key).eqNullSafe(F.col("_of"))).withColumn("spread", spread)
    sums, tops = ["n", *PID_SUMS, "n_subs", "n_revenue", "spread", "n_arpu", "sum_arpu"], ["max_subs", "max_revenue", "max_arpu"]
    # the sums go along with the first category
    listed = F.explode(F.array(*[
        F.struct(F.lit(i).alias("which"), F.col(c).cast("string").alias("value"),
                 *[(F.col(m) if i == 0 else F.lit(None).cast(parts.schema[m].dataType)).alias(m) for m in [*sums, *tops]])
        for i, c in enumerate(values)])).alias("p")
    once = parts.select(key, listed).select(key, "p.*").groupBy(key, "which", "value").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in tops])
    base = once.groupBy(key).agg(
        F.sum("n").cast("double").alias("pid_row_count"),
        *[or_zero(F.sum(n)).alias(n) for n in PID_SUMS],
        or_zero(F.try_divide(F.sum("pid_subs_sum"), F.sum("n_subs"))).alias("pid_subs_mean"),
        or_zero(F.max("max_subs")).alias("pid_subs_max"),
        or_zero(F.try_divide(F.sum("pid_revenue_sum"), F.sum("n_revenue"))).alias("pid_revenue_mean"),
        or_zero(F.max("max_revenue")).alias("pid_revenue_max"),
        or_zero(F.when(F.sum("n_revenue") > 1, F.sqrt(F.sum("spread") / (F.sum("n_revenue") - 1)))).alias("pid_revenue_std"),
        or_zero(F.try_divide(F.sum("sum_arpu"), F.sum("n_arpu"))).alias("pid_arpu_mean"),
        or_zero(F.max("max_arpu")).alias("pid_arpu_max"),
        *[F.count_if((F.col("which") == i) & F.col("value").isNotNull()).cast("double").alias(n) for i, n in enumerate(PID_DISTINCT)],
    )
    return base.withColumns(_pid_ratios())


def _pid_ratios() -> dict[str, Column]:
    dormant = F.col("pid_not_active_sum") + F.col("pid_suspended_sum")
    return {
        "pid_multi_row": flag(F.col("pid_row_count") > 1),
        "pid_dormant_sum": dormant,
        "pid_dormant_ratio": share(dormant, "pid_subs_sum"),
        "pid_mobile_ratio": share("pid_mobile_sum", "pid_revenue_sum"),
        "pid_fixed_ratio": share("pid_fixed_sum", "pid_revenue_sum"),
    }


def pid_row_fallback() -> dict[str, Column]:
    """The same columns from a single row, for ids that were not aggregated."""
    own = {n: F.col(c) for n, c in PID_SUMS.items()}
    own |= {
        "pid_row_count": F.lit(1.0),
        "pid_subs_mean": F.col("Total_SUBs"),
        "pid_subs_max": F.col("Total_SUBs"),
        "pid_revenue_mean": F.col("TotalRevenue"),
        "pid_revenue_max": F.col("TotalRevenue"),
        "pid_revenue_std": F.lit(0.0),
        "pid_arpu_mean": F.col("ARPU"),
        "pid_arpu_max": F.col("ARPU"),
        "pid_multi_row": F.lit(0.0),
        **{n: F.lit(1.0) for n in PID_DISTINCT},
    }
    dormant = F.col("Not_Active_subscribers") + F.col("Suspended_subscribers")
    own |= {
        "pid_dormant_sum": dormant,
        "pid_dormant_ratio": share(dormant, "Total_SUBs"),
        "pid_mobile_ratio": share("AvgMobileRevenue", "TotalRevenue"),
        "pid_fixed_ratio": share("AvgFIXRevenue", "TotalRevenue"),
    }
    return own


def with_pid_features(df: DataFrame, aggregates: DataFrame, key: str = "account_id") -> DataFrame:
    """Attach the aggregates, fall back to row values, then shares and deviations."""
    fallback = pid_row_fallback()
    wide = df.join(aggregates, key, "left")
    filled = wide.withColumns({n: F.coalesce(F.col(n), or_zero(e)) for n, e in fallback.items()})
    return filled.withColumns({
        "pid_revenue_share": share("TotalRevenue", "pid_revenue_sum"),
        "pid_subs_share": share("Total_SUBs", "pid_subs_sum"),
        "pid_revenue_vs_mean": or_zero(F.col("TotalRevenue") - F.col("pid_revenue_mean")),
        "pid_arpu_vs_mean": or_zero(F.col("ARPU") - F.col("pid_arpu_mean")),
        **{f"log1p_{n}": log1p_positive(n) for n in
           ("pid_row_count", "pid_subs_sum", "pid_revenue_sum", "pid_mobile_sum", "pid_fixed_sum")},
    })


# ---- group risk ---------------------------------------------------------------------

GROUP_ALERT = 0.70


def group_risk(scored: DataFrame, group: str, probability: str = "churn_probability") -> DataFrame:
    return scored.groupBy(group).agg(
        F.avg(probability).alias("group_avg_prob"),
        F.max(probability).alias("group_max_prob"),
        F.count(F.lit(1)).alias("group_size"),
        (F.max(probability) >= GROUP_ALERT).alias("group_alert"),
    )


def with_group_risk(scored: DataFrame, group: str, probability: str = "churn_probability") -> DataFrame:
    """Group statistics on every row; an aggregate and a join, so a hot group is pre-reduced."""
    return scored.join(group_risk(scored, group, probability), group, "left")


# ---- column selection ---------------------------------------------------------------

# The published column groups, in this engine's column names.
FEATURE_GROUPS: dict[str, tuple[str, ...]] = {
    "revenue_size": (
        "Total_SUBs", "AvgMobileRevenue", "AvgFIXRevenue", "TotalRevenue", "ARPU", "mobile_revenue_ratio",
        "fixed_revenue_ratio", "revenue_per_sub", "revenue_per_active", "mobile_to_fixed_ratio",
        "fixed_to_mobile_ratio", "mobile_only", "fixed_only",
    ),
    "subscriber_status": (
        "Active_subscribers", "Not_Active_subscribers", "Suspended_subscribers", "active_ratio", "inactive_ratio",
        "suspended_ratio", "dormant_ratio", "has_inactive", "has_suspended",
    ),
    "customer_profile": ("CRM_PID_Value_Segment", "EffectiveSegment", "Billing_ZIP", "KA_name"),
    "geography": (
        "postal_code", "zip_found", "place_count", "place_name", "admin_name", "admin_code", "latitude", "longitude",
        "accuracy", "km_sofia", "km_plovdiv", "km_varna", "km_burgas", "min_city_km",
    ),
}
# Groups of all columns that begin with one of these.
PREFIX_GROUPS: dict[str, tuple[str, ...]] = {"public_demographics": ("district_", "municipality_")}


def present_groups(
    frame: DataFrame, groups: dict[str, tuple[str, ...]] | None = None, prefixes: dict[str, tuple[str, ...]] | None = None
) -> dict[str, list[str]]:
    """Groups reduced to the columns a frame has; without given groups the published ones."""
    if groups is None and prefixes is None:
        groups, prefixes = FEATURE_GROUPS, PREFIX_GROUPS
    found = {g: [c for c in cols if c in frame.columns] for g, cols in (groups or {}).items()}
    found |= {g: [c for c in frame.columns if c.startswith(begins)] for g, begins in (prefixes or {}).items()}
    return {g: cols for g, cols in found.items() if cols}


def split_by_type(frame: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and other columns, in the given order."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    numeric = [c for c in columns if isinstance(kinds[c], T.NumericType)]
    return numeric, [c for c in columns if c not in numeric]


# Name parts that mark a column as time dependent.
TEMPORAL_TOKENS = (
    "_6", "_7", "_8", "_9", "month", "date", "history", "usage_drop", "payment_failure", "inquiry",
)


def temporal_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if any(t in c.lower() for t in TEMPORAL_TOKENS)]


#: Begins the fitted codes, frequencies and rates of the value segment, which is named like an id and is none.
SEGMENT_CODES = "CRM_PID_Value_Segment_"


def assert_no_ids(columns: Sequence[str], ids: Sequence[str] = ("PID", "account_id", "CHURN", "y")) -> None:
    """Refuse a feature list that holds the account id, another id column or the target."""
    leaked = [c for c in columns if c in ids or c.upper() == "PID" or c.upper().startswith("CRM_PID")]
    if leaked:
        raise ValueError(f"id or target columns among the features: {leaked}")

