"""Ordering of metric rows. These tables hold one row per model, not per customer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(table: DataFrame, metrics: Sequence[str], name: str, status: str = "status", top: int | None = None) -> DataFrame:
    """Best first by several metrics, rows that failed last."""
    order = [(F.col(status) != "ok").asc(), *[F.col(m).desc_nulls_last() for m in metrics], F.col(name).asc()]
    placed = table.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return placed.where(F.col("place") <= top) if top else placed


def best_per_group(table: DataFrame, group: Sequence[str], metrics: Sequence[str], name: str) -> DataFrame:
    order = [*[F.col(m).desc() for m in metrics], F.col(name).asc()]
    ranked = table.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def best_per_family(table: DataFrame, family: str, metrics: Sequence[str], name: str, limit: int = 8) -> DataFrame:
    """The best row of each family, then the ``limit`` best families."""
    return best_per_group(table, [family], metrics, name).orderBy(*[F.col(m).desc() for m in metrics], name).limit(limit)


def grouped_importance(importance: DataFrame, groups: Mapping[str, Sequence[str]], feature: str = "feature") -> DataFrame:
    """Importances summed per feature group; features outside every group are "other"."""
    pairs = {f: g for g, features in groups.items() for f in features}
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    group = F.coalesce(F.try_element_at(lookup, F.col(feature)), F.lit("other"))
    return importance.groupBy("model", group.alias("feature_group")).agg(F.sum("importance").alias("importance"))


def linear_contributions(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution weight x (value - mean) of each feature of a linear model."""
    means = rows.agg(*[F.avg(c).alias(c) for c in weights])
    centred = rows.withColumn("_m", means.select(F.struct(*weights)).scalar())
    wide = centred.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.col(f"_m.{c}")))).alias(c) for c, w in weights.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("contribution")) for c in weights]))
    return wide.select(pairs.alias("p")).select("p.feature", "p.contribution")


def delta(table: DataFrame, key: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Each row minus the baseline row, metric by metric."""
    base = table.where(F.col(key) == baseline).select(F.struct(*metrics)).scalar()
    return table.withColumn("_base", base).withColumns(
        {f"delta_{m}": F.col(m) - F.col(f"_base.{m}") for m in metrics}).drop("_base")
