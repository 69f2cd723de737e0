"""Statistics across the many columns of a wide row, held as one array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block(values: Column, start: int, stop: int) -> Column:
    """Elements start..stop-1, counted from 0."""
    return F.slice(values, start + 1, stop - start)


def known(values: Column) -> Column:
    return F.array_compact(values)


def row_sum(values: Column) -> Column:
    return F.aggregate(known(values), F.lit(0.0), lambda a, x: a + x)


def row_mean(values: Column) -> Column:
    """Mean of the known elements, 0 without any."""
    return F.coalesce(F.try_divide(row_sum(values), F.size(known(values)).cast("double")), F.lit(0.0))


def row_median(values: Column) -> Column:
    ordered = F.sort_array(known(values))
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.coalesce((low + high) / 2.0, F.lit(0.0))


def row_count(values: Column, keep) -> Column:
    return F.size(F.filter(values, keep)).cast("double")


def missing_count(values: Column) -> Column:
    return row_count(values, lambda x: x.isNull())


def negative_count(values: Column) -> Column:
    return row_count(values, lambda x: F.coalesce(x < 0, F.lit(False)))


def nonzero_count(values: Column) -> Column:
    return row_count(values, lambda x: F.coalesce(x != 0, F.lit(False)))


def abs_sum(values: Column) -> Column:
    return row_sum(F.transform(values, F.abs))


def distinct_count(values: Column, missing: str = "__missing__") -> Column:
    """Different values in a row of categories; a missing one counts as a value."""
    return F.size(F.array_distinct(F.transform(values, lambda x: F.coalesce(x, F.lit(missing))))).cast("double")
