"""Streaming forms of the look-back aggregates and the daily energy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.windows_agg import billing_measures, lookback_exprs, until, usage_measures


def usage_totals(logs: DataFrame, cutoff: str, windows: Sequence[int]) -> DataFrame:
    """Look-back sums kept as streaming state, the same expressions as in batch.

    One small state row per entity; write in update or complete mode. Merging micro-batches
    adds sums, takes the smaller first day and the larger last day.
    """
    return _totals(until(logs, "log_date", cutoff), "log_date", cutoff, windows, usage_measures())


def billing_totals(transactions: DataFrame, cutoff: str, windows: Sequence[int]) -> DataFrame:
    return _totals(until(transactions, "txn_date", cutoff), "txn_date", cutoff, windows, billing_measures())


def _totals(rows: DataFrame, date: str, cutoff: str, windows: Sequence[int], measures: Mapping[str, Column]) -> DataFrame:
    first, last = f"first_{date}", f"last_{date}"
    return rows.groupBy("entity_id").agg(
        *lookback_exprs(date, cutoff, windows, measures), F.min(date).alias(first), F.max(date).alias(last))


def daily_energy(events: DataFrame, entity: str, time: str, value: str, late: str = "2 days") -> DataFrame:
    """Event-time daily sums; a day is final, and later rows are dropped, once ``late`` has passed."""
    day = F.window(F.col(time), "1 day")
    return (
        events.withWatermark(time, late)
        .groupBy(F.col(entity).alias("entity_id"), day.alias("w"))
        .agg(F.sum(value).alias("energy"))
        .select("entity_id", F.to_date("w.start").alias("day"), "energy")
    )
