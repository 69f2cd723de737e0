"""Order-dependent operators that never put a whole table or group into one task.

Spark's own ``Window.orderBy`` needs every row of a partition key in one task. The
functions below cut the ordered rows into cells, work inside the cells and add what
the earlier cells contribute, so one key may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.text import hash_token


#: Range cells and hash cells per shuffle partition, at least; fewer than this many cells are not worth a border.
FEW_CELLS, HASH_CELLS = 8, 4


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _hash_digits(frame: DataFrame) -> int:
    """Hex digits that cut a hash into clearly more cells than there are shuffle partitions."""
    return max(2, -(-(HASH_CELLS * _partitions(frame) - 1).bit_length() // 4))


def _borders(sample: DataFrame, order: str) -> DataFrame:
    """One row: the sorted distinct values of a sample in slices of about the square root of their number, and the first of each."""
    sorted_ = sample.agg(F.sort_array(F.array_distinct(F.collect_list(order))).alias("_all"))
    sized = sorted_.withColumn("_width", F.greatest(F.ceil(F.sqrt(F.size("_all"))), F.lit(1)).cast("int"))
    begins = F.filter(F.sequence(F.lit(0), F.size("_all"), F.col("_width")), lambda i: i < F.size("_all"))
    slices = sized.select("_width", F.transform(begins, lambda i: F.slice("_all", i + 1, F.col("_width"))).alias("fine"))
    return slices.select(F.struct(F.col("_width").alias("width"), "fine", F.transform("fine", lambda s: s[0]).alias("coarse")).alias("b"))


def _smaller(values: Column, value: Column) -> Column:
    """How many of sorted distinct values are smaller than one: its place among them, without a lambda.

    A lambda here would confuse the optimizer's inference of join filters from the equality of both sides' cells.
    """
    return F.array_position(F.sort_array(F.array_append(values, value)), value) - 1


def with_range_cell(rows: DataFrame, order: str, cells: int | None = None, out: str = "_cell") -> DataFrame:
    """Number the rows by range of ``order``.

    The borders are the ``order`` values of the rows with the smallest hashes: a uniform sample, about one per shuffle
    partition, that depends on the data only, so a recomputed task draws the same borders. Every column is hashed to let
    Spark reuse the shuffle below ``rows``. A value is looked up among the first borders of the slices, then in its slice.
    """
    wanted = cells or max(FEW_CELLS, _partitions(rows))
    sample = rows.orderBy(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col(order)).limit(wanted - 1)
    wide = rows.withColumn("_borders", _borders(sample, order).scalar())
    value = F.col(order)
    wide = wide.withColumn("_slice", _smaller(F.col("_borders.coarse"), value).cast("int"))
    inside = _smaller(F.try_element_at(F.col("_borders.fine"), F.greatest("_slice", F.lit(1))), value)
    place = F.when(F.col("_slice") == 0, F.lit(1)).otherwise((F.col("_slice") - 1) * F.col("_borders.width") + inside + 1)
    return wide.select(*[F.col(c) for c in rows.columns], F.when(value.isNull(), F.lit(0)).otherwise(place.cast("int")).alias(out))


def _same_group(by: Sequence[str], cell: str, right: DataFrame) -> tuple[DataFrame, Column]:
    """The right side under other names, and the condition: equal cells of one group, where null is a group."""
    same = F.col(cell) == F.col(f"_of_{cell}")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return right.withColumnsRenamed({c: f"_of_{c}" for c in [*by, cell]}), same


def running_totals(
    rows: DataFrame,
    order: str,
    totals: Mapping[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    cells: int | None = None,
    overall: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of columns, ``{output: input}``, along ``order``.

    ``rows`` holds one row per (``by``, ``order``), ``order`` never null: aggregate first,
    which also removes hot values. A null ``by`` is a group of its own. ``overall`` adds sums over all rows of each ``by``.
    """
    overall = overall or {}
    tagged = with_range_cell(rows, order, cells)
    by = list(by)

    def sort(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = Window.partitionBy(*by, "_cell").orderBy(sort(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(src).over(inside).alias(f"_in_{out}") for out, src in totals.items()])
    summed = {out: src for out, src in [*totals.items(), *overall.items()]}
    per_cell = tagged.groupBy(*by, "_cell").agg(*[F.sum(src).alias(f"_sum_{out}") for out, src in summed.items()])
    # windows over the cells: a bounded number of rows per key
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = whole.orderBy(sort("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *by, "_cell",
        *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_off_{out}") for out in totals],
        *[F.sum(f"_sum_{out}").over(whole).alias(out) for out in overall],
    )
    joined = local.join(*_same_group(by, "_cell", offsets))
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[(F.col(f"_in_{out}") + F.col(f"_off_{out}")).alias(out) for out in totals],
        *overall,
    )


def sorted_codes(keys: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys numbered 0, 1, ... in sort order."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(distinct, key, {out: "_one"})
    return ranked.select(key, (F.col(out) - 1).cast("bigint").alias(out))


def hash_rank(
    rows: DataFrame,
    row_id: str,
    seed: str,
    strata: Sequence[str] = (),
    out: str = "rank",
    size_out: str | None = None,
    prefix: int | None = None,
) -> DataFrame:
    """1-based position of every row in the pseudo-random order of its stratum.

    Exact, also when one stratum holds nearly all rows: the leading hex digits of the
    hash cut each stratum into 16**prefix even cells. ``size_out`` adds the stratum size.
    """
    strata = list(strata)
    digits = prefix or _hash_digits(rows)
    tagged = rows.withColumn("_token", hash_token(seed, row_id)).withColumn("_cell", F.substring("_token", 1, digits))
    inside = Window.partitionBy(*strata, "_cell").orderBy("_token", row_id)
    local = tagged.withColumn("_in", F.row_number().over(inside))
    per_cell = tagged.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(strata or [F.lit(0)]))
    earlier = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # strata may be null: their rows are a stratum of their own
    keys = [f"_of_{i}" for i in range(len(strata))]
    offsets = per_cell.select(
        *[F.col(c).alias(k) for c, k in zip(strata, keys)],
        F.col("_cell").alias("_of_cell"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(whole).alias("_size"),
    )
    sized = [F.col("_size").alias(size_out)] if size_out else []
    same = F.col("_cell") == F.col("_of_cell")
    for c, k in zip(strata, keys):
        same &= F.col(c).eqNullSafe(F.col(k))
    return local.join(offsets, same).select(
        *[F.col(c) for c in rows.columns], (F.col("_in") + F.col("_off")).alias(out), *sized
    )


def latest_before(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
    inclusive: bool = False,
) -> DataFrame:
    """The most recent non-null ``value`` in the earlier rows of each key.

    ``chunk`` must not fall as ``order`` rises (a day, a block of row numbers); it bounds
    what one task sorts, so a hot key spreads over its chunks. With a value that is never
    null this is a lag; with gaps it carries the last value forward. A null key is a key of its own.
    """
    by = list(by)
    tagged = rows.withColumn("_carry_chunk", chunk).withColumn("_carried", value)
    inside = (
        Window.partitionBy(*by, "_carry_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = tagged.withColumn("_near", F.last("_carried", ignorenulls=True).over(inside))
    chunks = tagged.groupBy(*by, "_carry_chunk").agg(
        F.max_by("_carried", F.when(F.col("_carried").isNotNull(), F.struct(*order))).alias("_tail")
    )
    before = Window.partitionBy(*by).orderBy("_carry_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*by, "_carry_chunk", F.last("_tail", ignorenulls=True).over(before).alias("_far"))
    return local.join(*_same_group(by, "_carry_chunk", carried), "left").select(
        *[F.col(c) for c in rows.columns], F.coalesce("_near", "_far").alias(out)
    )


#: Accuracy of the sketches that bracket a quantile: ranks are off by one in this many rows, brackets reach out eight times as far.
SKETCH, REACH = 10_000, 8


def _matched(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the one row of ``groups`` of their ``by`` as ``_g``, where null is a group; without ``by`` the only row."""
    packed = groups.select(*by, F.struct(*[c for c in groups.columns if c not in by]).alias("_g"))
    if not by:
        return rows.withColumn("_g", packed.select("_g").scalar())
    other = packed.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    return rows.join(other, same).drop(*[f"_of_{i}" for i in range(len(by))])


def _quantile_table(rows: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles of many columns: ``by``, _feature (its number) and a column per quantile.

    A sketch of every column brackets its quantiles. A second pass counts exactly what lies below and up to each bracket, and
    opens a bracket that missed to all values. Only the values inside the brackets are ordered, about one in a thousand.
    """
    by, names = list(by), list(quantiles)
    slots = [(i, j) for i in range(len(columns)) for j in range(len(names))]
    typed = rows.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    reach = REACH / SKETCH
    marks = [m for q in quantiles.values() for m in (max(0.0, q - reach), min(1.0, q + reach))]
    sketch = typed.groupBy(*by).agg(*[
        e for i in range(len(columns))
        for e in (F.count(f"_v{i}").alias(f"n{i}"), F.percentile_approx(f"_v{i}", marks, SKETCH).alias(f"p{i}"))
    ])
    near = _matched(typed, sketch, by)
    low, high = (lambda i, j: F.col(f"_g.p{i}")[2 * j]), (lambda i, j: F.col(f"_g.p{i}")[2 * j + 1])
    counted = near.groupBy(*by).agg(
        *[F.max(f"_g.n{i}").alias(f"n{i}") for i in range(len(columns))],
        *[e for i, j in slots for e in (
            F.max(low(i, j)).alias(f"low{i}_{j}"), F.max(high(i, j)).alias(f"high{i}_{j}"),
            F.count_if(F.col(f"_v{i}") < low(i, j)).alias(f"below{i}_{j}"), F.count_if(F.col(f"_v{i}") <= high(i, j)).alias(f"upto{i}_{j}"))],
    )
    places = {j: [F.lit(float(quantiles[name])) * (F.col(f"n{i}") - 1) for i in range(len(columns))] for j, name in enumerate(names)}
    fits = {(i, j): (F.col(f"below{i}_{j}") <= F.floor(places[j][i])) & (F.col(f"upto{i}_{j}") > F.ceil(places[j][i])) for i, j in slots}
    brackets = counted.select(*by, *[f"n{i}" for i in range(len(columns))], *[e for i, j in slots for e in (
        F.when(fits[i, j], F.col(f"low{i}_{j}")).alias(f"low{i}_{j}"), F.when(fits[i, j], F.col(f"high{i}_{j}")).alias(f"high{i}_{j}"),
        F.when(fits[i, j], F.col(f"below{i}_{j}")).otherwise(F.lit(0)).alias(f"below{i}_{j}"))])
    inside = _matched(typed, brackets, by).select(*by, F.explode(F.array_compact(F.array(*[
        F.when(
            F.col(f"_v{i}").isNotNull() & (F.coalesce(F.col(f"_v{i}") >= F.col(f"_g.low{i}_{j}"), F.lit(True)))
            & F.coalesce(F.col(f"_v{i}") <= F.col(f"_g.high{i}_{j}"), F.lit(True)),
            F.struct(F.lit(i).alias("feature"), F.lit(j).alias("which"), F.col(f"_v{i}").alias("value"),
                     F.col(f"_g.below{i}_{j}").alias("below"), F.col(f"_g.n{i}").alias("size")))
        for i, j in slots]))).alias("_x"))
    counts = inside.groupBy(
        *by, F.col("_x.feature").alias("_feature"), F.col("_x.which").alias("_which"), F.col("_x.value").alias("_value")
    ).agg(F.count(F.lit(1)).alias("_n"), F.max("_x.below").alias("_below"), F.max("_x.size").alias("_size"))
    ranked = running_totals(counts, "_value", {"_in": "_n"}, by=[*by, "_feature", "_which"]).withColumn("_upto", F.col("_in") + F.col("_below"))
    picks = []
    for j, name in enumerate(names):
        mine, place = F.col("_which") == j, F.lit(float(quantiles[name])) * (F.col("_size") - 1)
        low_, high_ = (F.min(F.when(mine & (F.col("_upto") > f(place)), F.col("_value"))) for f in (F.floor, F.ceil))
        weight = F.max(F.when(mine, place - F.floor(place)))
        picks.append((low_ + (high_ - low_) * weight).alias(name))
    return ranked.groupBy(*by, "_feature").agg(*picks)


def exact_quantiles(
    rows: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact interpolated quantiles per group; a group without values has no row."""
    return _quantile_table(rows.where(F.col(value).isNotNull()), [value], quantiles, by).drop("_feature")


def column_quantiles(rows: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of many columns at once, one row per column name; a column without values has none."""
    table = _quantile_table(rows, columns, quantiles, [])
    names = F.array(*[F.lit(c) for c in columns])
    return table.select(F.element_at(names, F.col("_feature") + 1).alias("feature"), *quantiles)


def one_row(stats: DataFrame, feature: str, columns: Sequence[str], names: Sequence[str]) -> Column:
    """Turn per-feature statistics into one struct, usable as a scalar in any plan."""
    fields = [
        F.max(F.when(F.col(feature) == c, F.col(n))).alias(f"{c}__{n}") for c in columns for n in names
    ]
    row = stats.agg(*fields)
    return row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns])).scalar()
