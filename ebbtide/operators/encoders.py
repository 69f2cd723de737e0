"""Category encoders and numeric preparation, fitted on training rows only.

Fitted state is a small table per column; it is joined back with a plain left join, so
Spark decides from its real size whether to broadcast it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.numeric import logit
from ebbtide.functions.ordering import column_quantiles, one_row, sorted_codes


def lookup(rows: DataFrame, table: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Left join on a category with a default for unseen ones."""
    wide = rows.join(table, key, "left")
    return wide.withColumns({name: F.coalesce(F.col(name), default) for name, default in values.items()})


def frequency_table(train: DataFrame, column: str, out: str) -> DataFrame:
    counts = train.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.withColumn("_total", total).select(column, (F.col("_n") / F.col("_total")).alias(out))


def frequency_encode(rows: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    return lookup(rows, frequency_table(train, column, out), column, {out: F.lit(0.0)})


def smoothed(total: Column, count: Column, prior: Column, smoothing: float) -> Column:
    return (total + smoothing * prior) / (count + smoothing)


def target_table(train: DataFrame, column: str, label: str, smoothing: float, prefix: str) -> DataFrame:
    """Smoothed target mean and its logit per category."""
    stats = train.groupBy(column).agg(F.sum(label).cast("double").alias("_s"), F.count(F.lit(1)).alias("_n"))
    prior = stats.agg(F.sum("_s") / F.sum("_n")).scalar()
    rate = smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), smoothing)
    return stats.withColumn("_prior", prior).select(
        column, F.col("_n").alias(f"{prefix}_rows"), rate.alias(f"{prefix}_rate"), logit(rate).alias(f"{prefix}_woe"))


def target_encode(rows: DataFrame, train: DataFrame, column: str, label: str, smoothing: float, prefix: str) -> DataFrame:
    """Apply a fitted target encoding; unseen categories get the training mean."""
    table = target_table(train, column, label, smoothing, prefix).drop(f"{prefix}_rows")
    prior = train.agg(F.avg(label)).scalar()
    wide = rows.join(table, column, "left").withColumn("_prior", prior)
    return wide.withColumns({
        f"{prefix}_rate": F.coalesce(f"{prefix}_rate", "_prior"),
        f"{prefix}_woe": F.coalesce(F.col(f"{prefix}_woe"), logit("_prior")),
    }).drop("_prior")


def out_of_fold_table(
    train: DataFrame, column: str, label: str, fold: str, smoothing: float, prefix: str, fold_prior: bool = False
) -> DataFrame:
    """Encoding of each (category, fold) from the rows of the other folds.

    One aggregate by (category, fold); what the other folds hold is the category total
    minus the own fold. The prior is the mean of all training rows, or with
    ``fold_prior`` the mean of the other folds.
    """
    cells = train.groupBy(column, fold).agg(F.sum(label).cast("double").alias("_s"), F.count(F.lit(1)).alias("_n"))
    of_category = Window.partitionBy(column)  # at most one row per fold
    rest = cells.select(
        column, fold,
        (F.sum("_s").over(of_category) - F.col("_s")).alias("_s"),
        (F.sum("_n").over(of_category) - F.col("_n")).alias("_n"),
    )
    folds = cells.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    whole = Window.partitionBy(F.lit(0))  # over the fold totals, one row per fold
    all_s, all_n = F.sum("_fs").over(whole), F.sum("_fn").over(whole)
    prior = (all_s - F.col("_fs")) / (all_n - F.col("_fn")) if fold_prior else all_s / all_n
    priors = folds.select(fold, prior.alias("_prior"))
    rate = smoothed(F.col("_s"), F.col("_n"), F.col("_prior"), smoothing)
    return rest.join(priors, fold).select(column, fold, rate.alias(f"{prefix}_rate"), logit(rate).alias(f"{prefix}_woe"))


def out_of_fold_target(
    train: DataFrame, column: str, label: str, fold: str, smoothing: float, prefix: str, fold_prior: bool = False
) -> DataFrame:
    """Encode each training row from the rows of the other folds.

    For several columns build each ``out_of_fold_table`` from the same rows and join them:
    a chain of calls would read the rows twice as often with every link.
    """
    table = out_of_fold_table(train, column, label, fold, smoothing, prefix, fold_prior)
    return train.join(table, [column, fold], "left")


def ordinal_encode(rows: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """Sorted training categories as 0, 1, ...; unseen ones -1."""
    return lookup(rows, sorted_codes(train, column, out), column, {out: F.lit(-1).cast("bigint")})


def frequent_codes(train: DataFrame, column: str, out: str, min_rows: int = 5) -> DataFrame:
    """Sorted codes of the categories with at least ``min_rows`` training rows."""
    frequent = train.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    return sorted_codes(frequent, column, out)


def one_hot_index(rows: DataFrame, train: DataFrame, column: str, out: str, min_rows: int = 5) -> DataFrame:
    """Index for a one-hot vector; rare and unseen categories share the index after the last."""
    codes = frequent_codes(train, column, out, min_rows)
    size = codes.agg(F.count(F.lit(1))).scalar()
    wide = rows.join(codes, column, "left").withColumn("_size", size)
    return wide.withColumn(out, F.coalesce(F.col(out), F.col("_size"))).withColumn(
        f"{out}_rare", F.col(out) == F.col("_size")).drop("_size")


def safe_column(category: str) -> str:
    """A category as part of a column name."""
    return "".join(c if c.isalnum() else "_" for c in category) or "Unknown"


def one_hot_columns(rows: DataFrame, column: str, prefix: str, categories: Sequence[str]) -> DataFrame:
    """One 0/1 column per listed category, for short fixed lists."""
    return rows.withColumns({
        f"{prefix}_{safe_column(c)}": F.col(column).eqNullSafe(F.lit(c)).cast("double") for c in categories
    })


def impute_and_scale(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact training medians into gaps, then (x - mean) / population deviation, deviation 0 as 1."""
    medians = one_row(column_quantiles(train, columns, {"mid": 0.5}), "feature", columns, ["mid"])

    def filled(frame: DataFrame) -> DataFrame:
        with_fit = frame.withColumn("_mid", medians)
        return with_fit.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_mid.{c}__mid")) for c in columns}).drop("_mid")

    stats = filled(train).agg(*[
        e for c in columns for e in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__dev"))])
    fit = stats.select(F.struct(*stats.columns)).scalar()
    ready = filled(rows).withColumn("_fit", fit)
    return ready.withColumns({c: (F.col(c) - F.col(f"_fit.{c}__mean")) / _one_if_zero(F.col(f"_fit.{c}__dev")) for c in columns}).drop("_fit")


def robust_scale(rows: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range, range 0 as 1; gaps stay null."""
    quartiles = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    fit = one_row(column_quantiles(train, columns, quartiles), "feature", columns, list(quartiles))
    ready = rows.withColumn("_fit", fit)
    return ready.withColumns({
        c: (F.col(c).cast("double") - F.col(f"_fit.{c}__q2")) / _one_if_zero(F.col(f"_fit.{c}__q3") - F.col(f"_fit.{c}__q1"))
        for c in columns
    }).drop("_fit")


def _one_if_zero(value: Column) -> Column:
    return F.when(value == 0, 1.0).otherwise(value)
