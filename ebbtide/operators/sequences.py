"""Entity time series: momentum, fixed-length sequences, history channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.numeric import clip

# Fixed values of the sequence definition.
ENERGY_EPSILON = 1e-5
STEPS = 30
HEALTHY_ACTIVE_RATIO = 0.8
MONTHLY_DECAY = 0.95
DROP_LIMIT = 0.4


def with_momentum(daily: DataFrame, entity: str, time: str, energy: str) -> DataFrame:
    """Add ``momentum`` (ratio to the step before) and ``acceleration`` (its change).

    ``daily`` holds one row per entity and day, so an entity's window is bounded by the
    calendar however many raw events it has; aggregate raw events first.
    """
    w = Window.partitionBy(entity).orderBy(time)
    momentum = F.col(energy) / (F.lag(energy).over(w) + ENERGY_EPSILON)
    stepped = daily.withColumn("_momentum", momentum)
    change = F.col("_momentum") - F.lag("_momentum").over(w)
    return stepped.select(
        *daily.columns,
        F.coalesce("_momentum", F.lit(0.0)).alias("momentum"),
        F.coalesce(change, F.lit(0.0)).alias("acceleration"),
    )


def last_steps(
    rows: DataFrame, entity: str, order: Sequence[str], channels: Sequence[str], steps: int, carry: Sequence[str] = ()
) -> DataFrame:
    """The newest ``steps`` rows per entity as one ordered ``array<array<double>>``.

    The row-number filter is applied before and after the shuffle, so at most ``steps``
    rows per entity and map task travel, and the collected list is bounded.
    """
    newest = Window.partitionBy(entity).orderBy(*[F.col(c).desc() for c in order])
    kept = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= steps)
    point = F.struct((-F.col("_rn")).alias("at"), F.array(*[F.col(c).cast("double") for c in channels]).alias("v"))
    return kept.groupBy(entity).agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p["v"]).alias("sequence"),
        *[F.max(c).alias(c) for c in carry],
    )


def pad_right(sequences: DataFrame, steps: int, width: int, column: str = "sequence") -> DataFrame:
    """Zero rows behind short sequences and their true ``length``."""
    zeros = F.array(*[F.lit(0.0)] * width)
    length = F.size(column)
    return sequences.withColumn("length", length).withColumn(
        column, F.concat(F.col(column), F.array_repeat(zeros, F.lit(steps) - length))
    )


def channel_scale(sequences: DataFrame, channels: int, column: str = "sequence") -> Column:
    """Mean and population deviation per channel over all rows and steps, as one scalar struct."""
    steps = sequences.select(F.explode(column).alias("s"))
    stats = steps.agg(*[
        e for i in range(channels)
        for e in (F.avg(F.col("s")[i]).alias(f"m{i}"), F.stddev_pop(F.col("s")[i]).alias(f"d{i}"))
    ])
    return stats.select(F.struct(*stats.columns)).scalar()


def scale_sequences(sequences: DataFrame, fitted_on: DataFrame, channels: int, column: str = "sequence") -> DataFrame:
    """Standardise each channel with statistics of ``fitted_on``; a zero deviation counts as 1."""
    with_stats = sequences.withColumn("_fit", channel_scale(fitted_on, channels, column))
    scaled = F.transform(column, lambda s: F.array(*[
        (s[i] - F.col(f"_fit.m{i}")) / F.when(F.col(f"_fit.d{i}") == 0, 1.0).otherwise(F.col(f"_fit.d{i}"))
        for i in range(channels)
    ]))
    return with_stats.withColumn(column, scaled).drop("_fit")


def history_energy(history: Column, arpu: Column, active: Column, total: Column, steps: int = STEPS) -> Column:
    """The given history padded at the front with its first value, else a modelled one."""
    recent = F.when(F.size(history) > steps, F.slice(history, -steps, steps)).otherwise(history)
    padded = F.concat(F.array_repeat(F.element_at(recent, 1), F.lit(steps) - F.size(recent)), recent)
    active_ratio = active / F.greatest(total, F.lit(1)).cast("double")
    decay = F.when(active_ratio > HEALTHY_ACTIVE_RATIO, 1.0).otherwise(MONTHLY_DECAY)
    modelled = F.transform(F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1)), lambda i: arpu / F.pow(decay, i))
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, padded).otherwise(modelled)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def history_momentum(energy: Column) -> Column:
    mean = array_mean(energy)
    base = F.when(mean == 0, 1.0).otherwise(mean)
    return F.transform(energy, lambda x: x / base)


def first_difference(values: Column) -> Column:
    return F.transform(values, lambda x, i: F.when(i == 0, 0.0).otherwise(x - F.get(values, i - 1)))


def dropped_sharply(history: Column) -> Column:
    first, last = F.try_element_at(history, F.lit(1)), F.try_element_at(history, F.lit(-1))
    return F.coalesce((F.size(history) >= 2) & (first > 0) & (last / first <= DROP_LIMIT), F.lit(False))


def behaviour_channels(logs: DataFrame, plays: Column) -> DataFrame:
    """Energy and the three behaviour rates of a usage log."""
    return logs.select(
        "entity_id", "log_date", F.col("total_secs").alias("energy"),
        clip(F.col("num_25") / (F.col("num_unq") + 1e-5), 0.0, 1.0).alias("skip_rate"),
        clip(F.col("num_100") / (F.col("num_unq") + 1e-5), 0.0, 1.0).alias("completion_rate"),
        clip(F.col("num_unq") / (plays + 1e-5), 0.0, 1.0).alias("diversity_score"),
    )


CHANNELS = ("energy", "momentum", "acceleration", "skip_rate", "completion_rate", "diversity_score")


def present_channels(frame: DataFrame, wanted: Sequence[str] = CHANNELS) -> list[str]:
    """Channels a frame really has; none at all is an error."""
    found = [c for c in wanted if c in frame.columns]
    if not found:
        raise ValueError(f"no sequence channel among {frame.columns}")
    return found


def sequence_table(
    series: DataFrame, labels: DataFrame | None, entity: str, time: str, steps: int = STEPS,
    channels: Sequence[str] = CHANNELS, label: str = "is_churn",
) -> DataFrame:
    """Padded sequences with length and label; entities without a label get 0."""
    used = present_channels(series, channels)
    table = pad_right(last_steps(series, entity, [time], used, steps), steps, len(used))
    if labels is None:
        return table.withColumn(label, F.lit(0))
    return table.join(labels, entity, "left").withColumn(label, F.coalesce(label, F.lit(0)))

