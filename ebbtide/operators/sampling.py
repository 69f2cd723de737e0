"""Splits, folds, samples and weights, reproducible from a seed and the row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import clip
from ebbtide.functions.ordering import hash_rank
from ebbtide.functions.text import hash_number, hash_token, hash_unit


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def stratified_split(
    rows: DataFrame, row_id: str, label: str, seed: str, test: float = 0.2, validation: float = 0.25, out: str = "split"
) -> DataFrame:
    """Exact train/val/test shares per class: ``test`` of all, then ``validation`` of the rest."""
    ranked = hash_rank(rows, row_id, seed, [label], out="_rank", size_out="_size")
    n_test = round_half_up(F.col("_size") * test)
    n_val = round_half_up((F.col("_size") - n_test) * validation)
    part = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn(out, part).drop("_rank", "_size")


def hashed_split(rows: DataFrame, row_id: str, seed: str, test: float = 0.2, validation: float = 0.25, out: str = "split") -> DataFrame:
    """Shares that hold on average; needs no shuffle, for tables too large to rank."""
    u = hash_unit(hash_token(seed, row_id))
    part = F.when(u < test, "test").when(u < test + (1 - test) * validation, "val").otherwise("train")
    return rows.withColumn(out, part)


def stratified_folds(rows: DataFrame, row_id: str, label: str, seed: str, folds: int, out: str = "fold") -> DataFrame:
    """Fold numbers 0..folds-1, even within each class."""
    ranked = hash_rank(rows, row_id, seed, [label], out="_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def stratified_cap(rows: DataFrame, row_id: str, label: str, seed: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` rows with the class shares kept; all rows if they fit."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(rows, row_id, seed, [label], out="_rank", size_out="_size").withColumn("_total", total)
    quota = F.bround(F.col("_size") * (F.lit(float(max_rows)) / F.col("_total")), 0)
    return ranked.where((F.col("_total") <= max_rows) | (F.col("_rank") <= quota)).drop("_rank", "_size", "_total")


def balanced_sample(rows: DataFrame, row_id: str, label: str, seed: str, minority: int = 1) -> DataFrame:
    """All minority rows and the same number of rows of all other classes together; rows without a label are left out."""
    known = rows.where(F.col(label).isNotNull()).withColumn("_few", F.col(label) == minority)
    wanted = known.agg(F.count_if("_few")).scalar()
    ranked = hash_rank(known, row_id, seed, ["_few"], out="_rank").withColumn("_wanted", wanted)
    return ranked.where(F.col("_few") | (F.col("_rank") <= F.col("_wanted"))).drop("_rank", "_wanted", "_few")


def copies_needed(rank: Column, size: Column, extra: Column) -> Column:
    """How many of ``extra`` copies fall on the row with this rank among ``size`` rows."""
    return F.floor(extra / size) + (rank <= extra % size).cast("bigint")


def with_class_sizes(rows: DataFrame, label: str, minority: int) -> DataFrame:
    sizes = rows.agg(
        F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many"))
    both = sizes.select(F.struct("few", "many")).scalar()
    return rows.withColumn("_sizes", both)


def oversample(rows: DataFrame, row_id: str, label: str, seed: str, minority: int = 1, out: str = "copy") -> DataFrame:
    """Repeat minority rows until both classes have the same size; copy 0 is the original."""
    ranked = with_class_sizes(hash_rank(rows, row_id, seed, [label], out="_rank"), label, minority)
    few, many = F.col("_sizes.few"), F.col("_sizes.many")
    extra = F.greatest(many - few, F.lit(0))
    copies = F.when(F.col(label) == minority, copies_needed(F.col("_rank"), few, extra)).otherwise(F.lit(0))
    return ranked.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), copies)).alias(out))


def hash_sample(rows: DataFrame, row_id: str, seed: str, n: int, complete: Sequence[str] = ()) -> DataFrame:
    """``n`` rows in hash order, after dropping rows with gaps in ``complete``."""
    full = rows.dropna(subset=list(complete)) if complete else rows
    return hash_rank(full, row_id, seed, out="_rank").where(F.col("_rank") <= n).drop("_rank")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in an explicit order. An aggregate, so hot keys shrink early."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*rows.columns)


def attach_random(rows: DataFrame, row_id: str, pool: DataFrame, pool_id: str, seed: str) -> DataFrame:
    """Give every row one pool row, drawn by hash with replacement.

    Pool rows are numbered without gaps, so each is drawn with the same chance and the
    equi join spreads evenly.
    """
    numbered = hash_rank(pool, pool_id, seed, out="_number")
    size = pool.agg(F.count(F.lit(1))).scalar()
    drawn = rows.withColumn("_pool_size", size).withColumn(
        "_number", hash_number(hash_token(seed, row_id), 15) % F.col("_pool_size") + 1)
    return drawn.join(numbered, "_number").drop("_number", "_pool_size")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows, balanced weight and share of each class; the positive-class weight ratio on every row."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    overall = counts.agg(
        F.sum("rows").alias("total"), F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("rows"))), F.lit(0)).alias("positives"),
    ).select(F.struct("total", "classes", "positives")).scalar()
    wide = counts.withColumn("_all", overall)
    total, positives = F.col("_all.total"), F.col("_all.positives")
    return wide.select(
        label, "rows",
        (total / (F.col("_all.classes") * F.col("rows"))).alias("balanced_weight"),
        (F.col("rows") / total).alias("share"),
        ((total - positives) / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )


def with_source_weight(target: DataFrame, auxiliary: DataFrame, weight: float, out: str = "weight") -> DataFrame:
    """Target rows at weight 1 over auxiliary rows at a smaller weight."""
    return target.withColumn(out, F.lit(1.0)).unionByName(auxiliary.withColumn(out, F.lit(float(weight))), allowMissingColumns=True)


FOCAL_MODES = ("none", "focal_positive", "focal_balanced", "ambiguous_positive")


def focal_weight(label: Column, score: Column, scale: Column | float, mode: str, gamma: float = 2.0) -> Column:
    """Unnormalised row weight that stresses hard rows, limited to [0.05, 4 x scale]."""
    if mode not in FOCAL_MODES:
        raise ValueError(f"unknown weight mode {mode!r}")
    if mode == "none":
        return F.lit(1.0)
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    p = clip(score, 1e-6, 1 - 1e-6)
    positive = label == 1
    if mode == "ambiguous_positive":
        weight = F.when(positive & (p < 0.25), s * 3.5).when(positive & (p <= 0.65), s * 2.5).when(positive, s).otherwise(1.0)
    else:
        weight = F.when(positive, s * F.pow(1 - p, F.lit(gamma))).otherwise(F.pow(p, F.lit(gamma)))
        if mode == "focal_balanced":
            weight = weight * F.when(p.between(0.35, 0.65), 2.0).otherwise(1.0)
    return F.least(F.greatest(weight, F.lit(0.05)), s * 4.0)


def with_focal_weight(
    rows: DataFrame, label: str, score: str, scale: Column | float, mode: str, out: str = "weight"
) -> DataFrame:
    """Focal weights scaled to a mean of 1 over all rows."""
    raw = rows.withColumn(out, focal_weight(F.col(label), F.col(score), scale, mode))
    if mode == "none":
        return raw
    return raw.withColumn("_mean", raw.agg(F.avg(out)).scalar()).withColumn(out, F.col(out) / F.col("_mean")).drop("_mean")
