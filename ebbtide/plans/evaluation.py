"""Plans over labelled score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import rounded
from ebbtide.operators import blending, crm, leaderboard as boards, ranking
from ebbtide.plans.accounts import PREPARED, sql_ratio, sql_share
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.session import pin
from ebbtide.sources.feeds import Feeds

MEMBERS = ("s1", "s2", "s3")

RATES = """CASE WHEN tp + fp = 0 THEN 0e0 ELSE ROUND(tp / CAST(tp + fp AS DOUBLE), 6) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0e0 ELSE ROUND(tp / CAST(tp + fn AS DOUBLE), 6) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE ROUND(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) END AS f1"""
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END"
SHARE = "ROUND((tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS pred_pos_rate"


def confusion_sql(source: str, score: str, threshold: str, group: str = "") -> str:
    head, tail = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    hit = f"COALESCE({score} >= {threshold}, FALSE)"
    return (f"SELECT {head}COUNT(*) FILTER (y = 1 AND {hit}) AS tp, COUNT(*) FILTER (y <> 1 AND {hit}) AS fp, "
            f"COUNT(*) FILTER (y = 1 AND NOT {hit}) AS fn, COUNT(*) FILTER (y <> 1 AND NOT {hit}) AS tn FROM {source}{tail}")


def curve_sql(source: str, score: str, group: str = "") -> str:
    """One row per distinct score with the counts at that threshold."""
    part = f"PARTITION BY {group} " if group else ""
    head = f"{group}, " if group else ""
    return (f"SELECT {head}t AS threshold, pos, SUM(pos) OVER ({part.strip()}) AS all_pos, SUM(neg) OVER ({part.strip()}) AS all_neg, "
            f"SUM(pos) OVER ({part}ORDER BY t DESC) AS tp, SUM(neg) OVER ({part}ORDER BY t DESC) AS fp, "
            f"SUM(pos) OVER ({part.strip()}) - SUM(pos) OVER ({part}ORDER BY t DESC) AS fn, "
            f"SUM(neg) OVER ({part}ORDER BY t) - neg AS neg_below, neg "
            f"FROM (SELECT {head}{score} AS t, COUNT(*) FILTER (y = 1) AS pos, COUNT(*) FILTER (y <> 1) AS neg "
            f"FROM {source} WHERE {score} IS NOT NULL GROUP BY {head}{score})")


def best_sql(curve: str, group: str = "") -> str:
    head, part = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    return (f"SELECT {head}threshold, f1 AS best_f1 FROM (SELECT *, ROW_NUMBER() OVER ({part}ORDER BY f1 DESC, threshold) AS rn "
            f"FROM (SELECT *, {F1} AS f1 FROM {curve})) WHERE rn = 1")


@query(statement("scores", f"SELECT split, tp, fp, fn, tn, {RATES}, {SHARE} FROM c",
                 c=confusion_sql("scores", "s1", "0.5e0", "split")))
def confusion_metrics(feeds: Feeds) -> DataFrame:
    """Confusion counts and rates per split at 0.5."""
    return rounded(ranking.metrics_at(feeds.scores(), "y", "s1", 0.5, ["split"]))


_LONG = " UNION ALL ".join(f"SELECT row_id, y, split, '{m}' AS member, COALESCE({m}, 0) AS score FROM scores" for m in MEMBERS)


def long_scores(feeds: Feeds) -> DataFrame:
    return blending.member_scores(feeds.scores(), MEMBERS, ["row_id", "y", "split"])


@query(statement("scores", """SELECT member, ROUND(SUM(pos * (neg_below + 0.5e0 * neg)) / (ANY_VALUE(all_pos) * ANY_VALUE(all_neg)), 6) AS roc_auc
FROM c GROUP BY member""", long=_LONG, c=curve_sql("long", "score", "member")))
def roc_auc(feeds: Feeds) -> DataFrame:
    """Exact rank statistic per member, ties half."""
    return rounded(ranking.roc_auc(long_scores(feeds), "y", "score", ["member"]))


@query(statement("scores", """SELECT member, ROUND(SUM(pos / CAST(all_pos AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))), 6) AS average_precision
FROM c GROUP BY member""", long=_LONG, c=curve_sql("long", "score", "member")))
def average_precision(feeds: Feeds) -> DataFrame:
    """Sum of recall steps times precision per member."""
    return rounded(ranking.average_precision(long_scores(feeds), "y", "score", ["member"]))


@query(statement("scores", f"""SELECT ROUND(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, {RATES} FROM c""", c=curve_sql("scores", "s1")))
def pr_curve(feeds: Feeds) -> DataFrame:
    """Precision and recall at every distinct score."""
    curve = ranking.precision_recall(feeds.scores(), "y", "s1")
    return rounded(curve.select("threshold", "tp", "fp", "fn", "precision", "recall", "f1"))


def sweep_sql(first: int, last: int, per_one: int) -> str:
    hit = "s1 >= g.i / CAST({} AS DOUBLE)".format(per_one)
    return (f"SELECT g.i / CAST({per_one} AS DOUBLE) AS threshold, COUNT(*) FILTER (y = 1 AND {hit}) AS tp, "
            f"COUNT(*) FILTER (y <> 1 AND {hit}) AS fp, COUNT(*) FILTER (y = 1 AND NOT {hit}) AS fn, "
            f"COUNT(*) FILTER (y <> 1 AND NOT {hit}) AS tn FROM scores CROSS JOIN generate_series({first}, {last}) g(i) GROUP BY g.i")


@query(statement("scores", f"SELECT ROUND(threshold, 6) AS threshold, tp, fp, fn, tn, {RATES}, {SHARE} FROM w", w=sweep_sql(20, 140, 200)))
def threshold_sweep(feeds: Feeds) -> DataFrame:
    """Metrics at 0.100, 0.105, ... 0.700."""
    return rounded(ranking.threshold_sweep(feeds.scores(), "y", "s1", 20, 140, 200))


@query(statement("scores", f"""SELECT ROUND(threshold, 6) AS threshold, {RATES}, tp, fp, fn, tn
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ok DESC, {F1} DESC, tp DESC, threshold) AS rn
      FROM (SELECT *, tp / CAST(tp + fn AS DOUBLE) >= 0.75e0 AS ok FROM w)) WHERE rn = 1""", w=sweep_sql(20, 70, 100)))
def best_threshold(feeds: Feeds) -> DataFrame:
    """Highest F1 with recall of at least 0.75 on a 0.20..0.70 grid."""
    sweep = ranking.threshold_sweep(feeds.scores(), "y", "s1", 20, 70, 100)
    return rounded(ranking.best_threshold(sweep, min_recall=0.75))


@query(statement("scores", "SELECT member, ROUND(threshold, 6) AS threshold, ROUND(best_f1, 6) AS best_f1 FROM b",
                 long=_LONG, c=curve_sql("long", "score", "member"), b=best_sql("c", "member")))
def pr_best_f1(feeds: Feeds) -> DataFrame:
    """Best F1 over all scores per member."""
    return rounded(ranking.best_f1(long_scores(feeds), "y", "score", ["member"]))


_FIXED = (0.3, 0.35, 0.4, 0.5)


@query(statement("scores", "SELECT " + ", ".join(
    f"ROUND(COALESCE(tp{i} / CAST(NULLIF(tp{i} + fp{i}, 0) AS DOUBLE), 0), 6) AS precision_{round(t * 100)}, "
    f"ROUND(tp{i} / CAST(p AS DOUBLE), 6) AS recall_{round(t * 100)}, "
    f"ROUND(2 * tp{i} / CAST(tp{i} + fp{i} + p AS DOUBLE), 6) AS f1_{round(t * 100)}" for i, t in enumerate(_FIXED)) + " FROM c",
                 c="SELECT COUNT(*) FILTER (y = 1) AS p, " + ", ".join(
                     f"COUNT(*) FILTER (y = 1 AND s1 >= {t}e0) AS tp{i}, COUNT(*) FILTER (y <> 1 AND s1 >= {t}e0) AS fp{i}"
                     for i, t in enumerate(_FIXED)) + " FROM scores"))
def fixed_thresholds(feeds: Feeds) -> DataFrame:
    """Precision, recall and F1 at four fixed thresholds in one row."""
    return rounded(ranking.fixed_threshold_report(feeds.scores(), "y", "s1", _FIXED))


def tuned_steps(source: str, group: str) -> dict[str, str]:
    """Named subqueries for a threshold tuned on val and measured on test."""
    return {
        "fit": f"SELECT * FROM {source} WHERE split = 'val'", "held": f"SELECT * FROM {source} WHERE split = 'test'",
        "fc": curve_sql("fit", "score", group), "tb": best_sql("fc", group),
        "hc": curve_sql("held", "score", group), "ob": best_sql("hc", group),
        "m": confusion_sql(f"(SELECT held.*, tb.threshold FROM held JOIN tb ON tb.{group} = held.{group})", "score", "threshold", group),
        "tuned": f"""SELECT m.{group}, ROUND(tb.threshold, 6) AS threshold, ROUND(tb.best_f1, 6) AS val_best_f1, tp, fp, fn, tn, {RATES}, {SHARE},
  ROUND(ob.threshold, 6) AS oracle_threshold, ROUND(ob.best_f1, 6) AS oracle_f1, a.roc_auc, a.average_precision
FROM m JOIN tb ON tb.{group} = m.{group} JOIN ob ON ob.{group} = m.{group}
JOIN (SELECT {group}, ROUND(SUM(pos * (neg_below + 0.5e0 * neg)) / (ANY_VALUE(all_pos) * ANY_VALUE(all_neg)), 6) AS roc_auc,
  ROUND(SUM(pos / CAST(all_pos AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))), 6) AS average_precision FROM hc GROUP BY {group}) a
  ON a.{group} = m.{group}""",
    }


@query(statement("scores", "SELECT * FROM tuned", long=_LONG, **tuned_steps("long", "member")))
def tuned_eval(feeds: Feeds) -> DataFrame:
    """Tuned on validation, measured on test, with the optimistic best and ranking metrics."""
    return rounded(ranking.tuned_evaluation(long_scores(feeds), "y", "score", "split", ["member"]))


@query(statement("scores", """SELECT row_id, split, ROUND(s1, 6) AS score, s1 >= (SELECT threshold FROM b) AS predicted, y FROM scores
WHERE split = 'test'""", c=curve_sql("(SELECT * FROM scores WHERE split = 'val')", "s1"), b=best_sql("c")))
def monitoring_predictions(feeds: Feeds) -> DataFrame:
    """Test predictions at the validation threshold with their ids for monitoring."""
    rows = feeds.scores().select("row_id", "split", "y", "s1")
    limit = ranking.best_f1(rows.where(F.col("split") == "val"), "y", "s1").select("threshold").scalar()
    held = rows.where(F.col("split") == "test").withColumn("_limit", limit)
    return rounded(held.select("row_id", "split", F.col("s1").alias("score"), (F.col("s1") >= F.col("_limit")).alias("predicted"), "y"))


@query(statement("scores", f"""SELECT ROUND(b.threshold, 6) AS best_threshold, ROUND(b.f1 - d.f1, 6) + 0 AS delta_f1,
  ROUND(b.recall - d.recall, 6) + 0 AS delta_recall, ROUND(b.precision - d.precision, 6) + 0 AS delta_precision, b.tp - d.tp AS delta_tp
FROM (SELECT threshold, tp, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, {F1} AS f1,
  ROW_NUMBER() OVER (ORDER BY {F1} DESC, tp DESC, threshold) AS rn FROM w) b
JOIN (SELECT tp, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, {F1} AS f1 FROM w
  WHERE threshold = 0.5e0) d ON b.rn = 1""", w=sweep_sql(20, 70, 100)))
def threshold_delta(feeds: Feeds) -> DataFrame:
    """Best grid threshold against the default 0.5."""
    sweep = ranking.threshold_sweep(feeds.scores(), "y", "s1", 20, 70, 100)
    order, row = F.struct("f1", "recall", -F.col("threshold")), F.struct("threshold", "f1", "recall", "precision", "tp")
    both = sweep.agg(F.max_by(row, order).alias("b"), F.max_by(row, F.when(F.col("threshold") == 0.5, order)).alias("d"))
    diffs = [(F.col(f"b.{m}") - F.col(f"d.{m}")).alias(f"delta_{m}") for m in ("f1", "recall", "precision", "tp")]
    out = rounded(both.select(F.col("b.threshold").alias("best_threshold"), *diffs))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("delta_f1", "delta_recall", "delta_precision")})


# ---- blends -------------------------------------------------------------------------

@query(statement("scores", """SELECT row_id, ROUND((s1 + s2 + COALESCE(s3, 0)) / (2 + CASE WHEN s3 IS NULL THEN 0 ELSE 1 END), 6) AS score,
  (s1 + s2 + COALESCE(s3, 0)) / (2 + CASE WHEN s3 IS NULL THEN 0 ELSE 1 END) >= 0.5 AS predicted FROM scores"""))
def score_average(feeds: Feeds) -> DataFrame:
    """Soft vote: mean of the members present."""
    present = F.array_compact(F.array(*MEMBERS))
    mean = F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)
    return rounded(feeds.scores().select("row_id", mean.alias("score"), (mean >= 0.5).alias("predicted")))


_FILLED = "SELECT row_id, y, split, s1, s2, COALESCE(s3, 0) AS s3 FROM scores"


def _norm(m: str) -> str:
    return f"LEAST(GREATEST(({m} - v.{m}l) / (v.{m}h - v.{m}l), 0), 1)"


_NORM_STEPS = {
    "fl": _FILLED,
    "v": "SELECT " + ", ".join(f"MIN({m}) AS {m}l, MAX({m}) AS {m}h" for m in MEMBERS) + " FROM fl WHERE split = 'val'",
    "nm": "SELECT row_id, y, split, " + ", ".join(f"{_norm(m)} AS {m}" for m in MEMBERS) + " FROM fl, v",
}


def filled_scores(feeds: Feeds) -> DataFrame:
    return feeds.scores().withColumn("s3", F.coalesce("s3", F.lit(0.0)))


def normalised_scores(feeds: Feeds) -> DataFrame:
    rows = filled_scores(feeds)
    wide = blending.with_normalised(rows, rows.where(F.col("split") == "val"), MEMBERS)
    return wide.select("row_id", "y", "split", *[F.col(f"{m}_norm").alias(m) for m in MEMBERS])


@query(statement("scores", """SELECT row_id, ROUND(s1, 6) AS s1_norm, ROUND(s2, 6) AS s2_norm, ROUND(s3, 6) AS s3_norm,
  ROUND(s1 * 0.5e0 + s2 * 0.3e0 + s3 * 0.2e0, 6) AS weighted, ROUND(0.96e0 * s1 + 0.02e0 * s2 + 0.02e0 * s3, 6) AS with_auxiliary
FROM nm""", **_NORM_STEPS))
def score_minmax_blend(feeds: Feeds) -> DataFrame:
    """Scores placed in their validation range, a weighted and an auxiliary blend."""
    rows = normalised_scores(feeds)
    s = [F.col(m) for m in MEMBERS]
    return rounded(rows.select(
        "row_id", *[F.col(m).alias(f"{m}_norm") for m in MEMBERS],
        blending.weighted_average(s, [5, 3, 2]).alias("weighted"), blending.auxiliary_blend(*s).alias("with_auxiliary")))


@query(statement("scores", """SELECT l.row_id, ROUND(SUM(p.pct) / 3, 6) AS score
FROM long l JOIN (SELECT member, score, (SELECT COUNT(*) FROM long r WHERE r.split = 'val' AND r.member = d.member AND r.score <= d.score)
  / CAST((SELECT COUNT(*) FROM scores WHERE split = 'val') AS DOUBLE) AS pct
  FROM (SELECT DISTINCT member, score FROM long) d) p ON p.member = l.member AND p.score = l.score GROUP BY l.row_id""", long=_LONG))
def percentile_blend(feeds: Feeds) -> DataFrame:
    """Mean percentile of the members against their validation scores."""
    ranked = blending.percentile_scores(long_scores(feeds), F.col("split") == "val")
    return rounded(ranked.groupBy("row_id").agg((F.sum("percentile") / 3).alias("score")))


_NORM_LONG = " UNION ALL ".join(f"SELECT row_id, y, split, '{m}' AS member, {m} AS score FROM nm" for m in MEMBERS)
_TOPK_STEPS = _NORM_STEPS | {
    "nl": _NORM_LONG,
    "vc": curve_sql("(SELECT * FROM nl WHERE split = 'val')", "score", "member"), "vb": best_sql("vc", "member"),
    "rk": "SELECT member, GREATEST(best_f1, 1e-6) AS f, ROW_NUMBER() OVER (ORDER BY best_f1 DESC, member) AS place FROM vb",
    "sp": "SELECT 'top' || k AS blend, member, f / SUM(f) OVER (PARTITION BY k) AS weight FROM rk JOIN generate_series(1, 3) g(k) ON place <= k",
}


def _blend_step() -> str:
    return ("SELECT sp.blend, nl.row_id, nl.y, nl.split, ROUND(LEAST(GREATEST(SUM(nl.score * sp.weight), 0), 1), 9) AS score "
            "FROM nl JOIN sp ON sp.member = nl.member GROUP BY ALL")


def _blend_scores(specs: DataFrame, long: DataFrame) -> DataFrame:
    blended = blending.blend_specs(specs, long, ["row_id", "y", "split"], "score")
    # sums of floats depend on their order: rounding makes equal blends equal scores
    return blended.withColumn("score", F.round("score", 9))


@query(statement("scores", "SELECT * FROM tuned", **_TOPK_STEPS, bl=_blend_step(), **tuned_steps("bl", "blend")))
def blend_topk(feeds: Feeds) -> DataFrame:
    """Blends of the best one to three members by validation F1, tuned and measured."""
    long = blending.member_scores(normalised_scores(feeds), MEMBERS, ["row_id", "y", "split"])
    members = blending.ranked_members(long.where(F.col("split") == "val"), "y")
    blended = _blend_scores(blending.top_k_specs(members, 3), long)
    return rounded(ranking.tuned_evaluation(blended, "y", "score", "split", ["blend"]))


#: 500 weightings: nine by hand, the others drawn.
_CANDIDATES = {
    "equal": (1, 1, 1), "only_s1": (1, 0, 0), "only_s2": (0, 1, 0), "only_s3": (0, 0, 1), "a": (0.5, 0.3, 0.2),
    "b": (0.2, 0.5, 0.3), "c": (0.1, 0.1, 0.8), "d": (0.7, 0.3, 0), "e": (0.25, 0, 0.75),
} | {n: tuple(w) for n, w in blending.candidate_weights(3, 491).items() if n.startswith("draw_")}
_CAND_ROWS = ", ".join(f"('{n}', {w[0] / sum(w)!r}, {w[1] / sum(w)!r}, {w[2] / sum(w)!r})" for n, w in _CANDIDATES.items())
_CAND_SQL = ("SELECT row_id, y, split, blend, ROUND(LEAST(GREATEST(s1 * w1 + s2 * w2 + s3 * w3, 0), 1), 9) AS score FROM nm "
             "CROSS JOIN (SELECT blend, CAST(w1 AS DOUBLE) AS w1, CAST(w2 AS DOUBLE) AS w2, CAST(w3 AS DOUBLE) AS w3 "
             f"FROM (VALUES {_CAND_ROWS}) t(blend, w1, w2, w3))")


@query(statement("scores", """SELECT blend, ROUND(threshold, 6) AS threshold, ROUND(best_f1, 6) AS best_f1 FROM cb
ORDER BY cb.best_f1 DESC, blend LIMIT 1""", **_NORM_STEPS, cl=_CAND_SQL,
                 cc=curve_sql("(SELECT * FROM cl WHERE split = 'val')", "score", "blend"), cb=best_sql("cc", "blend")))
def blend_weight_search(feeds: Feeds) -> DataFrame:
    """The weighting with the highest validation F1 among 500 candidates."""
    rows = normalised_scores(feeds).where(F.col("split") == "val")
    return rounded(blending.searched_weights(rows, MEMBERS, _CANDIDATES, "y"))


#: Eight members made of the normalised scores, with a feature set and a family each.
_DERIVED = {
    "m1": ("s1", "a", "raw"), "m2": ("s2", "b", "raw"), "m3": ("s3", "b", "raw"), "m4": ("1 - s1", "a", "turned"),
    "m5": ("1 - s2", "b", "turned"), "m6": ("(s1 + s2) / 2", "a", "mixed"), "m7": ("s1 * s2", "a", "product"), "m8": ("(s1 + s3) / 2", "b", "mixed"),
}
_FAMILY_STEPS = _NORM_STEPS | {
    "nl": " UNION ALL ".join(f"SELECT row_id, y, split, '{m}' AS member, {e} AS score FROM nm" for m, (e, _, _) in _DERIVED.items()),
    "vc": curve_sql("(SELECT * FROM nl WHERE split = 'val')", "score", "member"), "vb": best_sql("vc", "member"),
    "mt": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', '{f}')" for m, (_, s, f) in _DERIVED.items()) + ") t(member, feature_set, family)",
    "rk": """SELECT vb.member, feature_set, family, best_f1, ROW_NUMBER() OVER (ORDER BY best_f1 DESC, vb.member) AS place, COUNT(*) OVER () AS n,
  ROW_NUMBER() OVER (PARTITION BY feature_set ORDER BY best_f1 DESC, vb.member) AS in_set, COUNT(*) OVER (PARTITION BY feature_set) AS of_set,
  ROW_NUMBER() OVER (PARTITION BY family ORDER BY best_f1 DESC, vb.member) AS in_family FROM vb JOIN mt ON mt.member = vb.member""",
    "ff": "SELECT *, ROW_NUMBER() OVER (ORDER BY best_f1 DESC, member) AS nth, COUNT(*) OVER () AS kinds FROM rk WHERE in_family = 1",
    "pt": """SELECT 'top' || k AS blend, member, best_f1 FROM rk JOIN (VALUES (3), (5), (10), (20)) g(k) ON place <= k AND n >= k
  UNION ALL SELECT 'set_' || feature_set, member, best_f1 FROM rk WHERE in_set <= 5 AND of_set >= 3
  UNION ALL SELECT 'families', member, best_f1 FROM ff WHERE nth <= 8 AND kinds >= 3""",
    "sp": """SELECT 'mean_' || blend AS blend, member, 1e0 / COUNT(*) OVER (PARTITION BY blend) AS weight FROM pt
  UNION ALL SELECT 'weighted_' || blend, member, GREATEST(best_f1, 1e-6) / SUM(GREATEST(best_f1, 1e-6)) OVER (PARTITION BY blend) FROM pt""",
}


@query(statement("scores", "SELECT * FROM tuned", **_FAMILY_STEPS, bl=_blend_step(), **tuned_steps("bl", "blend")))
def blend_families(feeds: Feeds) -> DataFrame:
    """Blends of the best members, of each feature set and of the best of each family, evenly and by strength, tuned and measured."""
    rows = normalised_scores(feeds).select("row_id", "y", "split", *[F.expr(e).alias(m) for m, (e, _, _) in _DERIVED.items()])
    long = pin(blending.member_scores(rows, list(_DERIVED), ["row_id", "y", "split"]))
    best = ranking.best_f1(long.where(F.col("split") == "val"), "y", "score", ["member"])
    kinds = rows.sparkSession.createDataFrame([(m, s, f) for m, (_, s, f) in _DERIVED.items()], "member string, feature_set string, family string")
    specs = blending.family_specs(pin(best.join(kinds, "member")))
    return rounded(ranking.tuned_evaluation(_blend_scores(specs, long), "y", "score", "split", ["blend"]))


_AUX_WEIGHTS = (0.02, 0.04, 0.1)
_AUX_STEPS = _NORM_STEPS | {
    "nl": _NORM_LONG,
    "sp": " UNION ALL ".join(
        f"SELECT 'aux_{w:.2f}' AS blend, 's1' AS member, {1 - w!r}e0 AS weight UNION ALL SELECT 'aux_{w:.2f}', 's2', {w / 2!r}e0 "
        f"UNION ALL SELECT 'aux_{w:.2f}', 's3', {w / 2!r}e0" for w in _AUX_WEIGHTS),
}


@query(statement("scores", "SELECT * FROM tuned", **_AUX_STEPS, bl=_blend_step(), **tuned_steps("bl", "blend")))
def blend_auxiliary(feeds: Feeds) -> DataFrame:
    """A primary member with two auxiliary ones at small weights, tuned and measured."""
    long = blending.member_scores(normalised_scores(feeds), MEMBERS, ["row_id", "y", "split"])
    specs = blending.spec_rows(long.sparkSession, blending.primary_auxiliary_specs(["s1"], ["s2", "s3"], _AUX_WEIGHTS))
    return rounded(ranking.tuned_evaluation(_blend_scores(specs, long), "y", "score", "split", ["blend"]))


# ---- search -------------------------------------------------------------------------

@query(statement("scores", f"""SELECT c.member, COUNT(*) AS folds, ROUND(AVG(c.f1), 6) AS mean_f1, ROUND(AVG(c.recall), 6) AS mean_recall,
  ROUND(AVG(a.ap), 6) AS mean_average_precision
FROM (SELECT member, fold, {F1} AS f1, COALESCE(tp / CAST(NULLIF(tp + fn, 0) AS DOUBLE), 0) AS recall FROM f) c
LEFT JOIN (SELECT member, fold, SUM(pos / CAST(NULLIF(all_pos, 0) AS DOUBLE) * (tp / CAST(tp + fp AS DOUBLE))) AS ap FROM v GROUP BY member, fold) a
  ON a.member = c.member AND a.fold = c.fold GROUP BY c.member""",
                 long=_LONG, lf="SELECT *, row_id % 5 AS fold FROM long", f=confusion_sql("lf", "score", "0.5e0", "member, fold"),
                 v=curve_sql("lf", "score", "member, fold")))
def cv_metric_means(feeds: Feeds) -> DataFrame:
    """Fold means of F1, recall and average precision of each member over five folds."""
    folded = long_scores(feeds).withColumn("fold", F.col("row_id") % 5)
    return rounded(ranking.metric_means(ranking.fold_metrics(folded, "y", "score", "member", "fold"), "member"))


# ---- leaderboards -------------------------------------------------------------------

_BOARD = f"""SELECT member, 'ok' AS status, {F1} AS f1, tp / CAST(tp + fn AS DOUBLE) AS recall FROM c
UNION ALL SELECT 'no_scores_' || lang, 'failed', NULL, NULL FROM documents GROUP BY lang"""


@query(statement("scores", """SELECT member, status, ROUND(f1, 6) AS f1, ROUND(recall, 6) AS recall, ROUND(SQRT(f1 * recall), 6) AS balance,
  CAST(ROW_NUMBER() OVER (ORDER BY status <> 'ok', f1 DESC NULLS LAST, recall DESC NULLS LAST, member) AS INT) AS place FROM t""",
                 long=_LONG, c=confusion_sql("long", "score", "0.5e0", "member"), t=_BOARD))
def leaderboard(feeds: Feeds) -> DataFrame:
    """Members by F1 and recall, failed candidates last."""
    ok = ranking.metrics_at(long_scores(feeds), "y", "score", 0.5, ["member"]).select(
        "member", F.lit("ok").alias("status"), "f1", "recall")
    failed = feeds.table("documents").select(F.concat(F.lit("no_scores_"), F.col("lang")).alias("member")).distinct().select(
        "member", F.lit("failed").alias("status"), F.lit(None).cast("double").alias("f1"), F.lit(None).cast("double").alias("recall"))
    table = ok.unionByName(failed).withColumn("balance", F.sqrt(F.greatest("f1", F.lit(0.0)) * F.greatest("recall", F.lit(0.0))))
    table = table.withColumn("balance", F.when(F.col("status") == "ok", F.col("balance")))
    return rounded(boards.leaderboard(table, ["f1", "recall"], "member"))


def lang_scores(feeds: Feeds) -> DataFrame:
    langs = feeds.table("documents").select(F.col("doc_id").alias("row_id"), "lang")
    return long_scores(feeds).join(langs, "row_id")


@query(statement("scores", f"""SELECT 'experiment' AS kind, lang AS name, member, ROUND(f1, 6) AS f1 FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY lang ORDER BY f1 DESC, member) AS rn FROM t) WHERE rn = 1
UNION ALL SELECT * FROM (SELECT 'family', member, member, ROUND(f1, 6) AS f1 FROM (SELECT member, MAX(f1) AS f1 FROM t GROUP BY member)
  ORDER BY 4 DESC, 2 LIMIT 2)""",
                 long=_LONG, lg="SELECT long.*, d.lang FROM long JOIN documents d ON d.doc_id = long.row_id",
                 c=confusion_sql("lg", "score", "0.5e0", "lang, member"), t=f"SELECT lang, member, {F1} AS f1 FROM c"))
def best_per_group(feeds: Feeds) -> DataFrame:
    """Best member per experiment, and the best row of the two best families."""
    table = ranking.metrics_at(lang_scores(feeds), "y", "score", 0.5, ["lang", "member"])
    each = boards.best_per_group(table, ["lang"], ["f1"], "member").select(
        F.lit("experiment").alias("kind"), F.col("lang").alias("name"), "member", "f1")
    families = boards.best_per_family(table, "member", ["f1"], "member", limit=2).select(
        F.lit("family").alias("kind"), F.col("member").alias("name"), "member", "f1")
    return rounded(each.unionByName(families))


_WEIGHTS = {"active_ratio": -1.4, "inactive_ratio": 0.9, "suspended_ratio": 0.7, "mobile_revenue_ratio": 0.25, "large_account": -0.3,
            "revenue_per_sub": 0.00001}
_FEATURE_SQL = {"active_ratio": sql_share("active", "subs"), "inactive_ratio": sql_share("inactive", "subs"),
                "suspended_ratio": sql_share("suspended", "subs"), "mobile_revenue_ratio": sql_share("mobile", "revenue"),
                "large_account": "CASE WHEN subs >= 10 THEN 1 ELSE 0 END", "revenue_per_sub": sql_ratio("revenue", "subs")}
_FEATURES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FEATURE_SQL.items()) + " FROM p"


def _contribution_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, AVG(ABS({w}e0 * ({c} - (SELECT AVG({c}) FROM ft)))) AS contribution FROM ft" if "e" not in repr(w)
        else f"SELECT '{c}' AS feature, AVG(ABS({w} * ({c} - (SELECT AVG({c}) FROM ft)))) AS contribution FROM ft"
        for c, w in _WEIGHTS.items())


@query(statement("crm_accounts", "SELECT feature, ROUND(contribution, 6) AS contribution FROM lc", p=PREPARED, ft=_FEATURES, lc=_contribution_sql()))
def linear_contribution(feeds: Feeds) -> DataFrame:
    """Mean absolute contribution of the features of a linear score."""
    df = crm.with_derived(crm.prepared(feeds.crm_accounts()))
    return rounded(boards.linear_contributions(df, _WEIGHTS))


_IMPORTANCE_GROUPS = {"subscriber_status": ["active_ratio", "inactive_ratio", "suspended_ratio"],
                      "revenue_size": ["mobile_revenue_ratio", "revenue_per_sub"]}


@query(statement("crm_accounts", """SELECT 'linear' AS model, CASE WHEN feature IN ('active_ratio', 'inactive_ratio', 'suspended_ratio')
  THEN 'subscriber_status' WHEN feature IN ('mobile_revenue_ratio', 'revenue_per_sub') THEN 'revenue_size' ELSE 'other' END AS feature_group,
  ROUND(SUM(contribution), 6) AS importance FROM lc GROUP BY 2""", p=PREPARED, ft=_FEATURES, lc=_contribution_sql()))
def group_importance(feeds: Feeds) -> DataFrame:
    """Importances summed by feature group."""
    df = crm.with_derived(crm.prepared(feeds.crm_accounts()))
    table = boards.linear_contributions(df, _WEIGHTS).select(
        F.lit("linear").alias("model"), "feature", F.col("contribution").alias("importance"))
    return rounded(boards.grouped_importance(table, _IMPORTANCE_GROUPS))


_ABLATIONS = {"baseline": MEMBERS, **{f"remove:{m}": tuple(x for x in MEMBERS if x != m) for m in MEMBERS}}
_ABLATION_SQL = " UNION ALL ".join(
    f"SELECT row_id, y, split, '{n}' AS blend, ROUND(({' + '.join(ms)}) / {len(ms)}, 9) AS score FROM nm" for n, ms in _ABLATIONS.items())


@query(statement("scores", """SELECT blend, f1, roc_auc, ROUND(f1 - (SELECT f1 FROM tuned WHERE blend = 'baseline'), 6) + 0 AS delta_f1,
  ROUND(roc_auc - (SELECT roc_auc FROM tuned WHERE blend = 'baseline'), 6) + 0 AS delta_roc_auc FROM tuned""",
                 **_NORM_STEPS, ab=_ABLATION_SQL, **tuned_steps("ab", "blend")))
def ablation_delta(feeds: Feeds) -> DataFrame:
    """What leaving out each member changes on the test split."""
    rows = normalised_scores(feeds)
    means = {n: reduce(lambda a, b: a + b, [F.col(m) for m in ms]) / len(ms) for n, ms in _ABLATIONS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("blend"), F.round(e, 9).alias("score")) for n, e in means.items()]))
    scored = rows.select("row_id", "y", "split", each.alias("s")).select("row_id", "y", "split", "s.blend", "s.score")
    # two readers below, and a rounded metric table is tiny: write it once
    table = pin(rounded(ranking.tuned_evaluation(scored, "y", "score", "split", ["blend"])))
    out = rounded(boards.delta(table, "blend", "baseline", ["f1", "roc_auc"]).select("blend", "f1", "roc_auc", "delta_f1", "delta_roc_auc"))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("delta_f1", "delta_roc_auc")})
