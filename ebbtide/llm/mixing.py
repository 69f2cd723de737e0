"""Mix sources to target weights by fitting exact document lengths into each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.ordering import sorted_codes
from ebbtide.session import pin

#: Leaves of the hash order of documents of one source and length; the last leaf that is taken from is ranked.
LEAVES = 1 << 16
#: Words of a budget that the knapsack table fits.
RESERVE = 1 << 16


def word_count(text: str = "text") -> Column:
    """Words of a text, a null text has none."""
    spaced = F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(spaced == "", F.lit(0)).otherwise(F.size(F.split(spaced, " +"))).cast("bigint")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that the lengths sum up as near to ``budget`` as can be.

    All but ``RESERVE`` words of the budget (four of the longest documents, if that is more) are an even share of every
    length. The words that the shares leave over beyond the reserve go to the longest documents that fit. The reserve is
    filled by an exact bounded-knapsack table over the documents still free, so a smaller budget is fitted exactly.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    reserve = min(budget, max(RESERVE, 4 * int(lengths.max())))
    take = np.array([int(c) * (budget - reserve) // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        more = min(int(counts[i] - take[i]), max(0, rest - reserve) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    return take + _knapsack(lengths, counts - take, rest)


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over reachable sums, kept as the bits of one integer.

    ``first[s]`` is the item by which s was reached first; every earlier sum of its chain was reached by
    an earlier item, so walking back uses each item once.
    """
    top = budget + int(lengths.max())
    full = (1 << (top + 1)) - 1
    reach, goal = 1, 1 << budget
    first = np.full(top + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        length, left, size = int(lengths[i]), min(int(free[i]), top // int(lengths[i])), 1
        while left > 0 and not reach & goal:
            copies = min(size, left)
            new = (reach << (length * copies)) & full & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[:top + 1])] = len(items)
                reach |= new
            items.append((i, copies))
            left -= copies
            size *= 2
    sums = np.flatnonzero(first >= 0)
    sums = np.append(sums, 0)
    best = int(sums[np.lexsort((sums, np.abs(sums - budget)))[0]])
    take = np.zeros(len(lengths), dtype=np.int64)
    while best > 0:
        i, copies = items[first[best]]
        take[i] += copies
        best -= copies * int(lengths[i])
    return take


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn. Targets share the total by weight, but end at
    ``most`` times the source's size; what is cut off is shared again by weight among the others until none is above.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = pin(sums)
    codes = sorted_codes(sums, "source", "_code")
    last = sums.agg(F.count("source")).first()[0]
    listed = F.array(*[F.lit(float(w)) for w in weights])
    place = F.coalesce("_code", F.lit(last)) % len(weights) + 1
    ranked = pin(sums.join(codes, "source", "left").select(
        "source", "source_size", F.element_at(listed, place.cast("int")).alias("weight")
    ))
    limit = F.lit(float(most)) * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        # the level rises until no further source is above its limit; each turn caps one more source at least
        above = F.col("weight") * F.lit(level) > limit
        n, spent, weight = ranked.agg(
            F.count_if(above), F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(~above, F.col("weight")).otherwise(0.0))
        ).first()
        if n == capped:
            break
        capped = n
        if weight:
            level = (total - spent) / weight
    target = F.when(above, limit).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the ``carry`` columns.

    Whole copies of a source fill its target as far as they fit; for the rest, documents are counted by exact length,
    ``fit_lengths`` says how many of each length to add, and a seeded hash of id and text picks them: first whole
    leaves of the hash order, then by rank in the one leaf that is taken in part. Rows with the same id and text
    are interchangeable. A null source is a source, null and blank texts have size 0 and are never taken. Only sums per
    source and counts per source and length are joined; other columns do not take part.
    """
    kept = [f"_carry_{i}" for i in range(len(carry))]
    token = F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text)))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        token.alias("_token"), F.shiftrightunsigned(token, 64 - (LEAVES - 1).bit_length()).cast("int").alias("_leaf"),
        *[F.col(c).alias(k) for c, k in zip(carry, kept)],
    )
    slim = pin(slim)
    targets = pin(source_targets(slim, weights, most))
    lengths = slim.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("_n"))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    # whole passes over the source, then a rest below one pass
    passes = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))
    budgets = lengths.alias("s").join(targets.alias("t"), same).select(
        F.col("s.source"), "size", "_n", passes.cast("int").alias("_passes"),
        F.round(F.col("target") - passes * F.col("source_size")).cast("bigint").alias("_budget"),
    )

    def fit(frame: pa.Table) -> pa.Table:
        size = frame["size"].to_numpy()
        order = np.argsort(size)
        chosen = fit_lengths(size[order], frame["_n"].to_numpy()[order], frame["_budget"][0].as_py())
        took = np.empty(len(order), dtype=np.int64)
        took[order] = chosen
        return pa.table({n: frame[n] for n in ("source", "size", "_passes")} | {"_take": pa.array(took)})

    # a row per distinct length: the greatest document bounds what a task holds of a source
    plan = pin(budgets.groupBy("source").applyInArrow(fit, "source string, size long, _passes int, _take long"))
    leaves = slim.where("size > 0").groupBy("source", "size", "_leaf").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("source", "size").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    key = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    open_ = leaves.alias("l").join(plan.alias("p"), key("l", "p")).select(
        F.col("l.source"), F.col("l.size"), "_leaf", "_passes", (F.col("_take") - F.col("_before")).alias("_left"), "_n"
    )
    joined = slim.alias("d").join(open_.alias("o"), key("d", "o") & (F.col("d._leaf") == F.col("o._leaf")), "left").select(
        "doc_id", "d.source", "d.size", "_token", "d._leaf", F.coalesce("_passes", F.lit(0)).alias("_passes"),
        F.coalesce("_left", F.lit(0)).alias("_left"), F.coalesce("_n", F.lit(0)).alias("_n"), *kept,
    )
    partly = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    inside = Window.partitionBy("source", "size", "_leaf").orderBy("_token", "doc_id", *kept)
    ranked = joined.where(partly).withColumn("_more", (F.row_number().over(inside) <= F.col("_left")).cast("int"))
    rest = joined.where(~partly).withColumn("_more", ((F.col("_n") > 0) & (F.col("_left") >= F.col("_n"))).cast("int"))
    chosen = ranked.unionByName(rest)
    t = F.broadcast(targets) if _few(targets) else targets
    return chosen.alias("s").join(t.alias("t"), same, "left").select(
        "doc_id", "s.source", "size", "source_size", "target",
        (F.col("size") * (F.col("_passes") + F.col("_more"))).alias("taken"),
        *[F.col(k).alias(c) for c, k in zip(carry, kept)],
    )


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    """A checked bound for a broadcast; beyond it the join shuffles."""
    return len(rows.select(F.lit(1)).take(most + 1)) <= most
