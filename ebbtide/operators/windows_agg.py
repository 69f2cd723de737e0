"""Look-back aggregates of usage and billing logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import col, or_zero, ratio_or_null


def window_start(cutoff: str, days: int) -> Column:
    """First day of a look-back window that includes the cutoff day."""
    return F.date_sub(F.lit(cutoff).cast("date"), days - 1)


def lookback_exprs(date: str, cutoff: str, windows: Sequence[int], measures: Mapping[str, Column]) -> list[Column]:
    """``measure_Nd`` for each window and ``measure_all``; missing values count as 0."""
    out = []
    for name, value in measures.items():
        out.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"{name}_all"))
        for days in windows:
            inside = F.when(F.col(date) >= window_start(cutoff, days), value)
            out.append(F.coalesce(F.sum(inside), F.lit(0)).alias(f"{name}_{days}d"))
    return out


def until(rows: DataFrame, date: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(date) <= F.lit(cutoff).cast("date"))


def plays() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("num_50", "num_75", "num_985", "num_100")),
               F.coalesce(F.col("num_25"), F.lit(0)))


def usage_measures() -> dict[str, Column]:
    return {
        "log_days": F.lit(1),
        "total_secs": or_zero("total_secs"),
        "total_plays": plays(),
        "complete_plays": F.col("num_100"),
        "short_plays": F.col("num_25"),
        "num_unq": F.col("num_unq"),
    }


def billing_measures() -> dict[str, Column]:
    return {
        "txn_count": F.lit(1),
        "plan_days": F.coalesce(F.col("plan_days"), F.lit(0)),
        "plan_price": or_zero("list_price"),
        "paid_amount": or_zero("paid"),
        "auto_renew": F.coalesce(F.col("is_auto_renew"), F.lit(0)),
        "cancel": F.coalesce(F.col("is_cancel"), F.lit(0)),
    }


def usage_windows(logs: DataFrame, cutoff: str, windows: Sequence[int]) -> DataFrame:
    return until(logs, "log_date", cutoff).groupBy("entity_id").agg(
        *lookback_exprs("log_date", cutoff, windows, usage_measures()),
        F.min("log_date").alias("first_log_date"),
        F.max("log_date").alias("last_log_date"),
    )


def expiry() -> Column:
    """Day on which a paid plan runs out."""
    return F.date_add("txn_date", F.col("plan_days"))


LATEST_FIELDS = ("payment_method_id", "plan_days", "list_price", "paid", "is_auto_renew", "is_cancel", "txn_date")


def latest_struct() -> Column:
    """The newest transaction; equal days fall back to the transaction id.

    An aggregate, so a key with very many rows is reduced before the shuffle.
    """
    return F.max_by(F.struct("txn_id", *LATEST_FIELDS), F.struct("txn_date", "txn_id"))


def _billing_exprs(cutoff: str, windows: Sequence[int]) -> list[Column]:
    return [
        *lookback_exprs("txn_date", cutoff, windows, billing_measures()),
        F.min("txn_date").alias("first_txn_date"),
        F.max("txn_date").alias("last_txn_date"),
        F.max(expiry()).alias("max_expire_date"),
    ]


def billing_windows(transactions: DataFrame, cutoff: str, windows: Sequence[int]) -> DataFrame:
    return until(transactions, "txn_date", cutoff).groupBy("entity_id").agg(*_billing_exprs(cutoff, windows))


def latest_transaction(transactions: DataFrame, cutoff: str) -> DataFrame:
    newest = until(transactions, "txn_date", cutoff).groupBy("entity_id").agg(latest_struct().alias("t"))
    return newest.select(
        "entity_id", F.col("t.txn_id").alias("latest_txn_id"), *[F.col(f"t.{f}").alias(f"latest_{f}") for f in LATEST_FIELDS]
    )


def billing_profile(transactions: DataFrame, cutoff: str, windows: Sequence[int]) -> DataFrame:
    """Windows and newest transaction in one pass and one shuffle."""
    both = until(transactions, "txn_date", cutoff).groupBy("entity_id").agg(
        *_billing_exprs(cutoff, windows), latest_struct().alias("t")
    )
    return both.select(
        *[c for c in both.columns if c != "t"], *[F.col(f"t.{f}").alias(f"latest_{f}") for f in LATEST_FIELDS]
    )


def usage_rate_exprs(windows: Sequence[int], pairs: Sequence[tuple[int, int]]) -> dict[str, Column]:
    """Per-day usage and play shares of each window, and changes between windows."""
    out: dict[str, Column] = {}
    for d in windows:
        out[f"daily_secs_{d}d"] = F.col(f"total_secs_{d}d") / F.lit(float(d))
        out[f"daily_plays_{d}d"] = F.col(f"total_plays_{d}d") / F.lit(float(d))
        out[f"completion_rate_{d}d"] = ratio_or_null(f"complete_plays_{d}d", f"total_plays_{d}d")
        out[f"short_play_rate_{d}d"] = ratio_or_null(f"short_plays_{d}d", f"total_plays_{d}d")
    for a, b in pairs:
        near, far = out[f"daily_secs_{a}d"], out[f"daily_secs_{b}d"]
        out[f"usage_change_{a}_vs_{b}"] = near - far
        out[f"usage_ratio_{a}_vs_{b}"] = ratio_or_null(near, far)
    return out


def billing_rate_exprs(windows: Sequence[int], pairs: Sequence[tuple[int, int]]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for d in windows:
        count = F.col(f"txn_count_{d}d")
        out[f"avg_paid_{d}d"] = ratio_or_null(f"paid_amount_{d}d", count)
        out[f"avg_plan_price_{d}d"] = ratio_or_null(f"plan_price_{d}d", count)
        out[f"renew_rate_{d}d"] = ratio_or_null(f"auto_renew_{d}d", count)
        out[f"cancel_rate_{d}d"] = ratio_or_null(f"cancel_{d}d", count)
    for a, b in pairs:
        out[f"paid_change_{a}_vs_{b}"] = out[f"avg_paid_{a}d"] - out[f"avg_paid_{b}d"]
    return out


def recency_exprs(cutoff: str, dates: Sequence[str], expire: str | None = None) -> dict[str, Column]:
    day = F.lit(cutoff).cast("date")
    out = {f"days_since_{c}": F.datediff(day, col(c)) for c in dates}
    if expire:
        left = F.datediff(col(expire), day)
        out["days_until_expire"] = left
        out["expired_by_cutoff"] = F.coalesce((left < 0).cast("double"), F.lit(0.0))
    return out


def age_in_range(value: Column | str) -> Column:
    return F.when(col(value).between(1, 100), col(value))
