"""Classifier metrics and threshold choice over score tables.

Scores are reduced to one row per distinct value before anything is ordered, and the
ordered part runs in range cells, so no step sorts all scores in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.numeric import ratio
from ebbtide.functions.ordering import running_totals
from ebbtide.session import pin


def f1_of(tp: Column | str, fp: Column | str, fn: Column | str) -> Column:
    """F1 from counts, 0 where it is undefined; counts make ties exact."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion_exprs(label: str, predicted: Column) -> list[Column]:
    y = F.col(label) == 1
    hit = F.coalesce(predicted, F.lit(False))
    return [
        F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and predicted share from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1_of(tp, fp, fn),
        "pred_pos_rate": ratio(tp + fp, tp + fp + fn + tn),
    })


def metrics_at(rows: DataFrame, label: str, score: str, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return with_rates(rows.groupBy(*by).agg(*confusion_exprs(label, F.col(score) >= limit)))


def score_counts(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    known = rows.where(F.col(score).isNotNull())
    return known.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_auc(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, equal scores count half, one class alone gives null."""
    counts = score_counts(rows, label, score, by)
    ranked = running_totals(counts, score, {"neg_upto": "neg"}, by=by)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") * 0.5))
    summed = ranked.groupBy(*by).agg(wins.alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return summed.select(*by, F.try_divide(F.col("_w"), (F.col("_p") * F.col("_n")).cast("double")).alias("roc_auc"))


def precision_recall(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score as threshold (score >= threshold is positive)."""
    return curve_of(score_counts(rows, label, score, by), score, by)


def curve_of(counts: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    full = running_totals(counts, score, {"tp": "pos", "fp": "neg"}, by=by, descending=True,
                          overall={"all_pos": "pos", "all_neg": "neg"})
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp")
    return full.select(
        *by, F.col(score).alias("threshold"), "pos", "neg", "all_pos", "tp", "fp", fn.alias("fn"),
        (F.col("all_neg") - fp).alias("tn"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("all_pos")).alias("recall"), f1_of(tp, fp, fn).alias("f1"),
    )


def average_precision(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    curve = precision_recall(rows, label, score, by)
    gained = F.try_divide(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    return curve.groupBy(*by).agg(F.sum(gained * F.col("precision")).alias("average_precision"))


def best_f1(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest F1 among all scores, the lowest one on a tie."""
    curve = precision_recall(rows, label, score, by)
    top = curve.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b"))
    return top.select(*by, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("best_f1"))


def fold_metrics(scores: DataFrame, label: str, score: str, candidate: str, fold: str, threshold: float = 0.5) -> DataFrame:
    """F1 and recall at a threshold and average precision of every (candidate, fold), all in one grouped pass.

    A fold without positives has an F1 and recall of 0 and no average precision. Rows without score or label are left out.
    """
    by = [candidate, fold]
    curve = curve_of(score_counts(scores.where(F.col(label).isNotNull()), label, score, by), score, by)
    hit = F.col("threshold") >= threshold
    gained = F.try_divide(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    summed = curve.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("_fp"), F.max("all_pos").alias("_p"),
        F.sum(gained * F.col("precision")).alias("average_precision"))
    return summed.select(
        *by, f1_of(F.col("_tp"), F.col("_fp"), F.col("_p") - F.col("_tp")).alias("f1"), ratio("_tp", "_p").alias("recall"), "average_precision")


def metric_means(folds: DataFrame, candidate: str) -> DataFrame:
    """Means over the folds of every candidate, and how many folds it has."""
    return folds.groupBy(candidate).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("f1").alias("mean_f1"), F.avg("recall").alias("mean_recall"),
        F.avg("average_precision").alias("mean_average_precision"))


def threshold_sweep(
    rows: DataFrame, label: str, score: str, first: int, last: int, per_one: int, by: Sequence[str] = ()
) -> DataFrame:
    """Metrics at every threshold first/per_one .. last/per_one (integers avoid drift).

    Each score is counted once in the cell of the highest threshold it reaches; the
    counts of at most ``last - first + 2`` cells are then summed from above.
    """
    by = list(by)
    s, den = F.col(score), F.lit(float(per_one))
    guess = F.floor(s * den)
    step = (F.when((guess + 1) / den <= s, guess + 1).when(guess / den > s, guess - 1).otherwise(guess))
    cell = F.greatest(F.lit(first - 1), F.least(F.lit(last), F.coalesce(step, F.lit(first - 1))))
    counts = rows.groupBy(*by, cell.cast("bigint").alias("step")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    steps = F.explode(F.sequence(F.lit(first - 1).cast("bigint"), F.lit(last).cast("bigint"))).alias("step")
    grid = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).select(
        *by, "all_pos", "all_neg", steps)
    from_above = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(counts, [*by, "step"], "left")
    summed = filled.select(
        *by, "step", "all_pos", "all_neg",
        F.sum(F.coalesce("pos", F.lit(0))).over(from_above).alias("tp"),
        F.sum(F.coalesce("neg", F.lit(0))).over(from_above).alias("fp"),
    ).where(F.col("step") >= first)
    counted = summed.select(
        *by, (F.col("step") / den).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"),
        (F.col("all_neg") - F.col("fp")).alias("tn"))
    return with_rates(counted)


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), min_recall: float | None = None) -> DataFrame:
    """Highest F1, then recall, then the lowest threshold.

    A recall floor is ignored when no threshold reaches it.
    """
    fields = ["threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn"]
    order = F.struct("f1", "recall", -F.col("threshold"))
    row = F.struct(*fields)
    picked = F.max_by(row, order)
    if min_recall is not None:
        picked = F.coalesce(F.max_by(row, F.when(F.col("recall") >= min_recall, order)), picked)
    return sweep.groupBy(*by).agg(picked.alias("b")).select(*by, *[F.col(f"b.{f}").alias(f) for f in fields])


def fixed_threshold_report(rows: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """One row with precision, recall and F1 at each given threshold, from one pass."""
    y = F.col(label) == 1
    aggs = [F.count_if(y).alias("positives")]
    for i, t in enumerate(thresholds):
        hit = F.coalesce(F.col(score) >= t, F.lit(False))
        aggs += [F.count_if(y & hit).alias(f"tp{i}"), F.count_if(~y & hit).alias(f"fp{i}")]
    c = rows.agg(*aggs)
    out = []
    for i, t in enumerate(thresholds):
        name = f"{round(t * 100):02d}"
        tp, fp = F.col(f"tp{i}"), F.col(f"fp{i}")
        out += [ratio(tp, tp + fp).alias(f"precision_{name}"), ratio(tp, "positives").alias(f"recall_{name}"),
                f1_of(tp, fp, F.col("positives") - tp).alias(f"f1_{name}")]
    return c.select(*out)


def tuned_evaluation(
    rows: DataFrame, label: str, score: str, split: str, by: Sequence[str] = (), fit: str = "val", held: str = "test"
) -> DataFrame:
    """Threshold tuned on one split and measured on the other, plus the optimistic best there.

    Both splits share one precision-recall curve: every metric is an aggregate over it.
    The counts per distinct score are written once, because the curve reads them several
    times and scores usually end a long plan.
    """
    by = list(by)
    used = rows.where(F.col(split).isin(fit, held)).select(*by, split, label, score)
    counts = pin(score_counts(used, label, score, [*by, split]))
    curve = curve_of(counts, score, [*by, split])
    on_fit, on_held = F.col(split) == fit, F.col(split) == held
    point, order = F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))
    gained = F.try_divide(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    # negatives strictly below a score, plus half of those that share it
    beaten = F.col("tn") + 0.5 * F.col("neg")
    pairs = (F.col("all_pos") * (F.col("tn") + F.col("fp"))).cast("double")
    summary = curve.groupBy(*by).agg(
        F.max_by(point, F.when(on_fit, order)).alias("tuned"),
        F.max_by(point, F.when(on_held, order)).alias("oracle"),
        F.try_divide(F.sum(F.when(on_held, F.col("pos") * beaten)), F.max(F.when(on_held, pairs))).alias("roc_auc"),
        F.sum(F.when(on_held, gained * F.col("precision"))).alias("average_precision"),
        F.max(F.when(on_held, F.col("all_pos"))).alias("_pos"),
        F.max(F.when(on_held, F.col("tn") + F.col("fp"))).alias("_neg"),
    )
    held_curve = curve.where(on_held).select(*by, "threshold", "tp", "fp")
    if by:
        limits = held_curve.join(summary.select(*by, F.col("tuned.threshold").alias("_limit")), by)
    else:
        limits = held_curve.withColumn("_limit", summary.select("tuned.threshold").scalar())
    at_limit = limits.where(F.col("threshold") >= F.col("_limit")).groupBy(*by).agg(
        F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    if by:
        both = summary.join(at_limit, by, "left")
    else:
        both = summary.withColumn("_a", at_limit.select(F.struct("tp", "fp")).scalar()).select("*", "_a.tp", "_a.fp")
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    counted = both.select(
        *by, F.col("tuned.threshold").alias("threshold"), F.col("tuned.f1").alias("val_best_f1"),
        tp.alias("tp"), fp.alias("fp"), (F.col("_pos") - tp).alias("fn"), (F.col("_neg") - fp).alias("tn"),
        F.col("oracle.threshold").alias("oracle_threshold"), F.col("oracle.f1").alias("oracle_f1"),
        "roc_auc", "average_precision")
    return with_rates(counted)
