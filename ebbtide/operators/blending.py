"""Score normalisation, weighted blends and their selection."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.numeric import clip
from ebbtide.functions.ordering import running_totals
from ebbtide.operators.ranking import best_f1, f1_of

RANGE_EPSILON = 1e-12


def member_scores(rows: DataFrame, members: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per row and member; a missing score counts as 0."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("member"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("score")) for m in members
    ]))
    return rows.select(*keep, pairs.alias("p")).select(*keep, "p.member", "p.score")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Place a score in the fitted range, limited to [0, 1]; an empty range gives 0."""
    wide = high - low
    return F.when(wide < RANGE_EPSILON, F.lit(0.0)).otherwise(clip(F.try_divide(value - low, wide), 0.0, 1.0))


def score_ranges(rows: DataFrame, members: Sequence[str]) -> Column:
    """Minimum and maximum of each member as one scalar struct."""
    stats = rows.agg(*[e for m in members for e in (F.min(m).alias(f"{m}_low"), F.max(m).alias(f"{m}_high"))])
    return stats.select(F.struct(*stats.columns)).scalar()


def with_normalised(rows: DataFrame, fitted_on: DataFrame, members: Sequence[str], suffix: str = "_norm") -> DataFrame:
    wide = rows.withColumn("_range", score_ranges(fitted_on, members))
    return wide.withColumns({
        f"{m}{suffix}": min_max(F.col(m), F.col(f"_range.{m}_low"), F.col(f"_range.{m}_high")) for m in members
    }).drop("_range")


def weighted_average(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """Average with weights scaled to sum 1, limited to [0, 1]."""
    if len(values) != len(weights):
        raise ValueError("one weight per member is needed")
    total = float(sum(weights))
    if abs(total) < RANGE_EPSILON:
        raise ValueError("weights must not sum to zero")
    return clip(sum((v * (w / total) for v, w in list(zip(values, weights))[1:]), values[0] * (weights[0] / total)), 0.0, 1.0)


def auxiliary_blend(main: Column, first: Column, second: Column, weight: float = 0.04, share: float = 0.5) -> Column:
    """A main score with two small auxiliary scores."""
    return main * (1 - weight) + first * (weight * share) + second * (weight * (1 - share))


def percentile_scores(long: DataFrame, reference: Column) -> DataFrame:
    """Share of the member's reference scores that are at most each score.

    ``long`` has ``member`` and ``score``; reference rows are marked by a condition.
    """
    counts = long.groupBy("member", "score").agg(F.count_if(reference).alias("_ref"))
    ranked = running_totals(counts, "score", {"_upto": "_ref"}, by=["member"], overall={"_size": "_ref"})
    table = ranked.select(
        "member", "score", F.coalesce(F.try_divide(F.col("_upto").cast("double"), F.col("_size").cast("double")), F.lit(0.0)).alias("percentile"))
    return long.join(table, ["member", "score"])


def blend_specs(spec_rows: DataFrame, long: DataFrame, keep: Sequence[str], value: str) -> DataFrame:
    """Weighted sum of member values per blend; ``spec_rows`` has blend, member, weight.

    The specification is a handful of rows and joins on the member name.
    """
    return long.join(spec_rows, "member").groupBy("blend", *keep).agg(
        clip(F.sum(F.col(value) * F.col("weight")), 0.0, 1.0).alias("score"))


def ranked_members(validation: DataFrame, label: str) -> DataFrame:
    """Members by their best validation F1, name as tie-break."""
    best = best_f1(validation, label, "score", ["member"])
    # a window over one row per member
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("best_f1").desc(), "member"))
    return best.select("member", "best_f1", place.alias("place"))


def top_k_specs(members: DataFrame, largest: int) -> DataFrame:
    """Blends of the best 1..largest members, weighted by validation F1."""
    strength = F.greatest("best_f1", F.lit(1e-6))
    spread = members.where(F.col("place") <= largest).select(
        "member", strength.alias("_f"), F.explode(F.sequence("place", F.lit(largest))).alias("_k"))
    within = Window.partitionBy("_k")
    return spread.select(F.concat(F.lit("top"), F.col("_k").cast("string")).alias("blend"), "member",
                         (F.col("_f") / F.sum("_f").over(within)).alias("weight"))


def primary_auxiliary_specs(primary: Sequence[str], auxiliary: Sequence[str], weights: Sequence[float]) -> dict[str, dict[str, float]]:
    """Blends that give the auxiliary members together a small fixed weight."""
    out: dict[str, dict[str, float]] = {}
    for w in weights:
        parts = {m: (1 - w) / len(primary) for m in primary}
        for m in auxiliary:
            parts[m] = parts.get(m, 0.0) + w / len(auxiliary)
        out[f"aux_{w:.2f}"] = parts
    return out


def weighted_candidates(rows: DataFrame, members: Sequence[str], candidates: Mapping[str, Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """Every candidate weighting applied to every row, ``blend`` and ``score``."""
    scored = F.explode(F.array(*[
        F.struct(F.lit(name).alias("blend"), weighted_average([F.col(m) for m in members], list(w)).alias("score"))
        for name, w in candidates.items()
    ]))
    return rows.select(*keep, scored.alias("s")).select(*keep, "s.blend", "s.score")


def candidate_weights(members: int, draws: int, seed: int = 42) -> dict[str, list[float]]:
    """Equal, single, sparse and dense weightings; Dirichlet draws from a fixed seed."""
    rng = random.Random(seed)

    def dirichlet(size: int, alpha: float) -> list[float]:
        parts = [rng.gammavariate(alpha, 1.0) + 1e-12 for _ in range(size)]
        return [p / sum(parts) for p in parts]

    out = {"equal": [1.0 / members] * members}
    for i in range(members):
        out[f"only_{i}"] = [1.0 if j == i else 0.0 for j in range(members)]
    for i in range(draws):
        if i % 2 and members > 2:
            size = rng.randint(2, min(5, members))
            weights = [0.0] * members
            for place, w in zip(rng.sample(range(members), size), dirichlet(size, 1.0)):
                weights[place] = w
        else:
            weights = dirichlet(members, (0.25, 0.5, 1.0, 2.0)[i // 2 % 4])
        out[f"draw_{i:05d}"] = weights
    return out


def best_weights(validation: DataFrame, label: str) -> DataFrame:
    """The candidate with the highest validation F1, name as tie-break, with its threshold."""
    each = best_f1(validation, label, "score", ["blend"])
    top = each.agg(F.min_by(F.struct("blend", "threshold", "best_f1"), F.struct(-F.col("best_f1"), F.col("blend"))).alias("b"))
    return top.select("b.*")


class WeightGrid:
    """Candidate weightings as a matrix, and the scores they give to rows of member scores."""

    def __init__(self, candidates: Mapping[str, Sequence[float]], digits: int, bins: int) -> None:
        self.names = sorted(candidates)
        weights = np.array([candidates[n] for n in self.names], dtype=float)
        total = weights.sum(axis=1, keepdims=True)
        if (np.abs(total) < RANGE_EPSILON).any():
            raise ValueError("weights must not sum to zero")
        self.weights, self.digits, self.bins = weights / total, digits, bins

    def scores(self, members: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
        """Rows x candidates, limited to [0, 1] and rounded; a row gives the same bits in every batch."""
        weights = self.weights if chosen is None else self.weights[chosen]
        total = np.multiply.outer(members[:, 0], weights[:, 0])
        for m in range(1, weights.shape[1]):
            total += np.multiply.outer(members[:, m], weights[:, m])
        return np.round(np.clip(total, 0.0, 1.0), self.digits)

    def bin(self, scores: np.ndarray) -> np.ndarray:
        return np.minimum((scores * self.bins).astype(np.int64), self.bins - 1)


def _labelled(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member scores and labels of complete rows, at most ``step`` rows at a time."""
    for batch in batches:
        table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        table = table[~np.isnan(table).any(axis=1)]
        for at in range(0, len(table), step):
            yield table[at:at + step, :-1], table[at:at + step, -1] > 0


def _histograms(rows: DataFrame, grid: WeightGrid) -> DataFrame:
    """(candidate, counts): positives and negatives of every score bin of every candidate, summed over all rows.

    A partition sends one row per candidate, however many rows it has.
    """
    count, bins = len(grid.names), grid.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, 2, bins), dtype=np.int64)
        base = np.arange(count) * 2 * bins
        for members, positive in _labelled(batches, max(1, (1 << 21) // count)):
            place = grid.bin(grid.scores(members)) + base + np.where(positive, 0, bins)[:, None]
            sums += np.bincount(place.ravel(), minlength=sums.size).reshape(sums.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(count, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())], ["candidate", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table({"candidate": table["candidate"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    spec = "candidate int, counts binary"
    return rows.mapInArrow(run, spec).groupBy("candidate").applyInArrow(add, spec)


def open_bins(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For candidates x (positives, negatives) x bins: the bins that can hold the highest F1 of all, and the counts above each bin.

    A threshold at the lowest score of a bin has a known F1. Inside a bin no threshold is better than one with all
    its positives and none of its negatives. Bins that stay below the best known F1 are closed.
    """
    above = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1] - counts
    positives = counts[:, 0].sum(axis=1)[:, None]
    f1 = lambda tp, fp: 2 * tp / np.maximum(tp + fp + positives, 1)
    filled = counts.sum(axis=1) > 0
    known = np.where(filled, f1(above[:, 0] + counts[:, 0], above[:, 1] + counts[:, 1]), -1.0)
    most = np.where(filled, f1(above[:, 0] + counts[:, 0], above[:, 1]), -1.0)
    return filled & (most >= known.max(initial=0.0) - 1e-12), above[:, 0], above[:, 1]


def searched_weights(
    validation: DataFrame, members: Sequence[str], candidates: Mapping[str, Sequence[float]], label: str, digits: int = 9, bins: int = 1024
) -> DataFrame:
    """blend, threshold, best_f1 of the weighting with the highest validation F1 over all its scores.

    The lowest threshold wins a tie inside a weighting, the first name one between weightings. Rows with a missing member score or
    label are left out. One pass counts the rows of each weighting in ``bins`` score bins; exact F1 is computed only in
    the bins that can still hold the highest one, from the rows that fall into them. The counts, candidates x bins, are all that
    reaches the driver.
    """
    grid = WeightGrid(candidates, digits, bins)
    rows = validation.select(
        *[F.col(m).cast("double").alias(f"_{i}") for i, m in enumerate(members)], (F.col(label) == 1).cast("double").alias("_y"))
    counts = np.zeros((len(grid.names), 2, bins), dtype=np.int64)
    for r in _histograms(rows, grid).collect():
        counts[r.candidate] = np.frombuffer(r.counts, np.int64).reshape(2, bins)
    open_, tp_above, fp_above = open_bins(counts)
    chosen = np.flatnonzero(open_.any(axis=1))
    wanted = open_[chosen]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, positive in _labelled(batches, max(1, (1 << 21) // max(1, len(chosen)))):
            scores = grid.scores(part, chosen)
            place = grid.bin(scores)
            row, column = np.nonzero(wanted[np.arange(len(chosen))[None, :], place])
            yield pa.RecordBatch.from_arrays([
                pa.array(chosen[column].astype(np.int32)), pa.array(place[row, column].astype(np.int32)), pa.array(scores[row, column]),
                pa.array(positive[row]),
            ], ["candidate", "bin", "score", "positive"])

    near = rows.mapInArrow(exact, "candidate int, bin int, score double, positive boolean")
    values = near.groupBy("candidate", "bin", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    curve = running_totals(values, "score", {"tp": "pos", "fp": "neg"}, by=["candidate", "bin"], descending=True)
    # one row per open bin
    offsets = [
        (int(c), int(b), grid.names[c], int(tp_above[c, b]), int(fp_above[c, b]), int(counts[c, 0].sum()))
        for c in chosen for b in np.flatnonzero(open_[c])
    ]
    above = validation.sparkSession.createDataFrame(
        offsets, "candidate int, bin int, blend string, tp_above bigint, fp_above bigint, positives bigint")
    tp, fp = F.col("tp") + F.col("tp_above"), F.col("fp") + F.col("fp_above")
    points = curve.join(above, ["candidate", "bin"]).select(
        "blend", F.col("score").alias("threshold"), f1_of(tp, fp, F.col("positives") - tp).alias("best_f1"))
    order = F.struct(-F.col("best_f1"), F.col("blend"), F.col("threshold"))
    return points.agg(F.min_by(F.struct("blend", "threshold", "best_f1"), order).alias("b")).where("b is not null").select("b.*")


def family_specs(members: DataFrame, tops: Sequence[int] = (3, 5, 10, 20), families: int = 8) -> DataFrame:
    """(blend, member, weight): the blends of a comparison, each with equal weights and with weights by validation F1.

    ``members`` has member, feature_set, family and best_f1, one row each, a bounded table. There is a blend of the best k members for every k that
    there are enough for; of the best five of a feature set with at least three; and of the best member of each
    family, up to ``families``, with at least three of them. The first name wins ties.
    """
    best = [F.col("best_f1").desc(), F.col("member")]
    whole = Window.partitionBy(F.lit(0))
    placed = members.select("*", F.row_number().over(whole.orderBy(*best)).alias("_place"), F.count(F.lit(1)).over(whole).alias("_all"))
    within = Window.partitionBy("feature_set")
    placed = placed.select("*", F.row_number().over(within.orderBy(*best)).alias("_in_set"), F.count(F.lit(1)).over(within).alias("_of_set"))
    first = placed.withColumn("_in_family", F.row_number().over(Window.partitionBy("family").orderBy(*best))).where("_in_family = 1")
    first = first.select("*", F.row_number().over(whole.orderBy(*best)).alias("_nth"), F.count(F.lit(1)).over(whole).alias("_kinds"))
    parts = [
        placed.where((F.col("_place") <= k) & (F.col("_all") >= k)).select(F.lit(f"top{k}").alias("blend"), "member", "best_f1") for k in tops
    ]
    parts.append(placed.where("_in_set <= 5 and _of_set >= 3").select(F.concat(F.lit("set_"), "feature_set").alias("blend"), "member", "best_f1"))
    parts.append(first.where((F.col("_nth") <= families) & (F.least("_kinds", F.lit(families)) >= 3)).select(
        F.lit("families").alias("blend"), "member", "best_f1"))
    specs = reduce(DataFrame.unionByName, parts).withColumn("_f", F.greatest("best_f1", F.lit(1e-6)))
    of = Window.partitionBy("blend")
    both = specs.select("blend", "member", (1 / F.count(F.lit(1)).over(of)).alias("_mean"), (F.col("_f") / F.sum("_f").over(of)).alias("_strong"))
    kinds = F.explode(F.array(
        F.struct(F.concat(F.lit("mean_"), "blend").alias("blend"), F.col("_mean").alias("weight")),
        F.struct(F.concat(F.lit("weighted_"), "blend").alias("blend"), F.col("_strong").alias("weight"))))
    return both.select("member", kinds.alias("k")).select("k.blend", "member", "k.weight")


def spec_rows(spark: SparkSession, specs: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(blend, member, weight) of blends given by name, such as ``primary_auxiliary_specs``."""
    rows = [(b, m, float(w)) for b, parts in specs.items() for m, w in parts.items()]
    return spark.createDataFrame(rows, "blend string, member string, weight double")
