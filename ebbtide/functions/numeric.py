"""Numeric column expressions with explicit null, zero and infinity rules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must match the published feature definitions.
PAIR_EPSILON = 1e-5
LOGIT_EPSILON = 1e-5
SIGMOID_LIMIT = 20.0


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """NaN and both infinities become null; other values pass (NaN sorts above infinity)."""
    x = col(value)
    return F.when(F.abs(x) < float("inf"), x)


def to_double(value: Column | str) -> Column:
    """Text to double; blank or unreadable text becomes null, also NaN and infinities."""
    return finite(F.nullif(F.trim(col(value).cast("string")), F.lit("")).try_cast("double"))


def numbers(frame: DataFrame, columns: Iterable[str]) -> dict[str, Column]:
    """Columns as clean doubles; only text columns are parsed."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return {
        c: finite(F.col(c).cast("double")) if isinstance(kinds[c], T.NumericType) else to_double(c) for c in columns
    }


def or_zero(value: Column | str) -> Column:
    return F.coalesce(col(value).cast("double"), F.lit(0.0))


def ratio_or_null(top: Column | str, bottom: Column | str) -> Column:
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division where a zero or missing denominator yields 0."""
    return F.coalesce(ratio_or_null(top, bottom), F.lit(0.0))


def clip(value: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value and keep nulls null (``least``/``greatest`` alone would drop them)."""
    x = col(value)
    out = x
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    return out


def share(top: Column | str, bottom: Column | str) -> Column:
    return clip(ratio(top, bottom), 0.0, 1.0)


def balance(a: Column | str, b: Column | str) -> Column:
    """Smaller over larger part of a pair, 0 when one side is missing."""
    x, y = or_zero(a), or_zero(b)
    return clip(F.least(x, y) / (F.greatest(x, y) + PAIR_EPSILON), 0.0, 1.0)


def flag(condition: Column) -> Column:
    """Condition to 1.0 / 0.0, unknown counts as 0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def logit(value: Column | str) -> Column:
    p = clip(value, LOGIT_EPSILON, 1.0 - LOGIT_EPSILON)
    return F.ln(p / (1.0 - p))


def sigmoid(value: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(value, -SIGMOID_LIMIT, SIGMOID_LIMIT)))


def log1p_positive(value: Column | str) -> Column:
    return F.log1p(F.greatest(or_zero(finite(value)), F.lit(0.0)))


def sqrt_positive(value: Column | str) -> Column:
    return F.sqrt(F.greatest(or_zero(finite(value)), F.lit(0.0)))


def sum_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.sum(col(value)), F.lit(0))


def rounded(frame: DataFrame, places: int = 6, money: Mapping[str, int] | Iterable[str] = ()) -> DataFrame:
    """Round every floating column, ``money`` columns to fewer places."""
    special = dict(money) if isinstance(money, Mapping) else {name: 2 for name in money}
    out = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), special.get(field.name, places)).alias(field.name)
        out.append(c)
    return frame.select(*out)


def sanitised(frame: DataFrame, keep: Iterable[str] = (), text: str = "unknown") -> DataFrame:
    """Numbers: NaN, infinity and null to 0. Strings: null to ``text``."""
    kept = set(keep)
    out = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in kept:
            out.append(c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.coalesce(finite(c), F.lit(0.0)).alias(field.name))
        elif isinstance(field.dataType, T.NumericType):
            out.append(F.coalesce(c, F.lit(0).cast(field.dataType)).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit(text)).alias(field.name))
        else:
            out.append(c)
    return frame.select(*out)
