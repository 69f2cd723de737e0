"""Weight search by brackets, blend families, fold metrics, seeded draws and boosting on balanced draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import blending, models, ranking
from ebbtide.operators.sampling import balanced_sample


def plain_best(members, y, candidates, digits=9):
    """blend, threshold, F1 by trying every score of every weighting."""
    best = None
    for name in sorted(candidates):
        w = np.array(candidates[name], float) / sum(candidates[name])
        scores = np.round(np.clip(sum(members[:, m] * w[m] for m in range(len(w))), 0, 1), digits)
        for t in np.unique(scores):
            hit = scores >= t
            tp, fp, fn = (hit & y).sum(), (hit & ~y).sum(), (~hit & y).sum()
            key = (-(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0), name, t)
            best = key if best is None or key < best else best
    return best


@pytest.fixture(scope="module")
def member_rows():
    rng = np.random.default_rng(12)
    y = rng.random(700) < 0.2
    members = np.clip(0.35 * y[:, None] + rng.normal(0.3, 0.25, (700, 3)), 0, 1)
    members[:100] = np.round(members[:100], 1)  # equal scores
    return members, y


@pytest.mark.parametrize("bins", [4, 64, 1024])
def test_weight_search_equals_trying_all(spark, member_rows, bins):
    members, y = member_rows
    frame = pd.DataFrame({"a": members[:, 0], "b": members[:, 1], "c": members[:, 2], "y": y.astype(int)})
    rows = spark.createDataFrame(frame).repartition(5)
    gaps = spark.createDataFrame([(None, 0.5, 0.5, 1), (0.5, 0.5, 0.5, None)], "a double, b double, c double, y int")
    candidates = blending.candidate_weights(3, 40)
    got = blending.searched_weights(rows.unionByName(gaps.withColumn("y", F.col("y").cast("bigint"))), ["a", "b", "c"], candidates, "y", bins=bins)
    (row,) = got.collect()
    f1, name, threshold = plain_best(members, y, candidates)
    assert (row["blend"], row["threshold"], row["best_f1"]) == (name, pytest.approx(threshold), pytest.approx(-f1))
    with pytest.raises(ValueError, match="zero"):
        blending.searched_weights(rows, ["a", "b", "c"], {"x": [1.0, -1.0, 0.0]}, "y")


def test_weight_search_without_rows_or_positives(spark):
    rows = spark.createDataFrame([(0.5, 0.2, 0), (0.1, 0.4, 0)], "a double, b double, y int")
    (row,) = blending.searched_weights(rows, ["a", "b"], {"x": [1, 1], "w": [1, 0]}, "y").collect()
    assert (row["blend"], row["best_f1"], row["threshold"]) == ("w", 0.0, 0.1)
    assert blending.searched_weights(rows.limit(0), ["a", "b"], {"x": [1, 1]}, "y").count() == 0


def test_what_the_histogram_sends_does_not_grow_with_the_rows(spark, member_rows):
    members, y = member_rows
    frame = pd.DataFrame({"a": members[:, 0], "b": members[:, 1], "y": y.astype(float)})
    grid = blending.WeightGrid({"x": [1, 1], "w": [1, 0], "v": [0, 1]}, 9, 32)
    rows = spark.createDataFrame(frame).repartition(4)
    sums = [{r.candidate: np.frombuffer(r.counts, np.int64) for r in blending._histograms(d, grid).collect()} for d in (rows, rows.union(rows))]
    assert all(len(c) == 64 for c in sums[0].values()) and len(sums[0]) == 3
    assert all((sums[1][k] == 2 * v).all() for k, v in sums[0].items())


def test_open_bins_keep_every_place_of_the_best():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (6, 2, 10))
    open_, tp_above, fp_above = blending.open_bins(counts)
    positives = counts[:, 0].sum(1)
    best = max(2 * counts[c, 0, b:].sum() / (counts[c, 0, b:].sum() + counts[c, 1, b:].sum() + positives[c]) for c in range(6) for b in range(10))
    for c in range(6):
        for b in range(10):
            tp, fp = counts[c, 0, b + 1:].sum(), counts[c, 1, b + 1:].sum()
            assert (tp_above[c, b], fp_above[c, b]) == (tp, fp)
            most = 2 * (tp + counts[c, 0, b]) / max(tp + counts[c, 0, b] + fp + positives[c], 1)
            assert open_[c, b] == (counts[c, :, b].sum() > 0 and most >= best - 1e-12)


def test_family_specs(spark):
    rows = [(f"m{i}", "ab"[i % 2] if i < 8 else "c", f"f{i % 3}", 1 - i / 100) for i in range(10)]
    specs = blending.family_specs(spark.createDataFrame(rows, "member string, feature_set string, family string, best_f1 double")).toPandas()
    of = {b: dict(zip(g["member"], g["weight"])) for b, g in specs.groupby("blend")}
    assert set(of) == {f"{k}_{b}" for k in ("mean", "weighted") for b in ("top3", "top5", "top10", "set_a", "set_b", "families")}
    assert of["mean_set_a"] == pytest.approx({f"m{i}": 0.25 for i in (0, 2, 4, 6)}) and set(of["mean_families"]) == {"m0", "m1", "m2"}
    total = 1 + 0.99 + 0.98
    assert of["weighted_top3"] == pytest.approx({"m0": 1 / total, "m1": 0.99 / total, "m2": 0.98 / total})
    assert all(sum(w.values()) == pytest.approx(1) for w in of.values())


def test_fold_metrics_and_means(spark):
    rows = [("a", 0, 1, 0.9), ("a", 0, 0, 0.6), ("a", 0, 1, 0.4), ("a", 1, 0, 0.7), ("a", 1, 0, 0.1), ("b", 0, 1, 0.5), ("b", 0, None, 0.9), ("b", 0, 0, None)]
    frame = spark.createDataFrame(rows, "candidate string, fold int, y int, score double")
    folds = {(r["candidate"], r["fold"]): r for r in ranking.fold_metrics(frame, "y", "score", "candidate", "fold").collect()}
    assert folds["a", 0]["f1"] == pytest.approx(0.5) and folds["a", 0]["recall"] == pytest.approx(0.5)
    assert folds["a", 0]["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert (folds["a", 1]["f1"], folds["a", 1]["recall"], folds["a", 1]["average_precision"]) == (0, 0, None)
    assert folds["b", 0]["f1"] == 1
    means = {r["candidate"]: r for r in ranking.metric_means(ranking.fold_metrics(frame, "y", "score", "candidate", "fold"), "candidate").collect()}
    assert means["a"]["folds"] == 2 and means["a"]["mean_f1"] == pytest.approx(0.25)
    assert means["a"]["mean_average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_parameter_draws():
    ranges = {"depth": (2, 4, "int"), "rate": (0.01, 0.1, "float"), "penalty": (1e-4, 10.0, "log")}
    drawn = models.parameter_draws(ranges, 300, seed=5)
    assert drawn == models.parameter_draws(ranges, 300, seed=5) != models.parameter_draws(ranges, 300, seed=6)
    assert {d["depth"] for d in drawn.values()} == {2, 3, 4}
    assert all(0.01 <= d["rate"] <= 0.1 and 1e-4 <= d["penalty"] <= 10 for d in drawn.values())
    assert 100 < sum(d["penalty"] < math.sqrt(1e-3) for d in drawn.values()) < 200
    with pytest.raises(ValueError, match="kind"):
        models.parameter_draws({"x": (0, 1, "other")}, 1)
    assert models.weight_grid([3, 5.5], {"max_depth": 5}) == {
        "weight_3": {"max_depth": 5, "scale_pos_weight": 3.0}, "weight_5.5": {"max_depth": 5, "scale_pos_weight": 5.5}}


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 2))
    y = ((x[:, 0] + 0.3 * rng.normal(size=240)) > 0.8).astype(float)
    frame = pd.DataFrame({"id": np.arange(240), "a": x[:, 0], "b": x[:, 1], "y": y})
    return models.assemble(spark.createDataFrame(frame), ["a", "b"], "y", keep=["id"]).persist()


def test_search_over_draws_and_class_weights(training):
    settings = models.weight_grid([1, 4], {"max_depth": 2, "learning_rate": 0.3}) | {"broken": {"max_depth": -1}}
    make = lambda setting, label: models.boosting_of(setting, label, rounds=3)
    means, failures = models.searched(training, settings, "id", "y", folds=3, make=make)
    rows = {r["candidate"]: r for r in means.collect()}
    assert set(rows) == {"weight_1", "weight_4"} and all(r["folds"] == 3 and r["mean_f1"] > 0.5 for r in rows.values())
    assert rows["weight_4"]["mean_recall"] >= rows["weight_1"]["mean_recall"]
    (failed,) = failures.collect()
    assert failed["candidate"] == "broken" and failed["error"]


class Fixed:
    """Stands in for an estimator and its model: wrong on the given ids."""

    def __init__(self, wrong):
        self.wrong, self.seen = wrong, None

    def fit(self, rows):
        self.seen = rows.collect()
        return self

    def transform(self, rows):
        return rows.withColumn("prediction", F.when(F.col("id").isin(self.wrong), 1 - F.col("y")).otherwise(F.col("y")))


def test_two_rounds_of_boosting_by_hand(spark):
    rows = spark.createDataFrame([(i, float(i < 2), 9.0) for i in range(10)] + [(99, None, 9.0)], "id int, y double, weight double")
    stubs = [Fixed([0, 5]), Fixed([5, 6]), Fixed(list(range(10)))]
    given = iter(stubs)
    voters, weights = models.boosted_on_draws(rows, lambda label: next(given), "id", "y", rounds=5, rate=0.5)
    # round 1: weights 0.1, error 0.2; round 2: ids 0 and 5 weigh twice as much as the others
    first = 0.5 * math.log(4)
    assert math.exp(first) == pytest.approx(2)
    one = {i: (0.2 if i in (0, 5) else 0.1) / 1.2 for i in range(10)}
    error = one[5] + one[6]
    second = 0.5 * math.log((1 - error) / error)
    total = 1 + error * (math.exp(second) - 1)
    two = {i: w * (math.exp(second) if i in (5, 6) else 1) / total for i, w in one.items()}
    assert [v for _, v in voters] == pytest.approx([first, second])
    got = {r["id"]: r["weight"] for r in weights.collect()}
    assert got == pytest.approx(two) and sum(got.values()) == pytest.approx(1)
    # each draw: both positives and two others, with the weights of its round
    for stub, known in zip(stubs[:2], ({i: 0.1 for i in range(10)}, one)):
        assert len(stub.seen) == 4 and {0, 1} <= {r["id"] for r in stub.seen}
        assert all(r["weight"] == pytest.approx(known[r["id"]]) for r in stub.seen)
    score = {r["id"]: r["score"] for r in models.voted_score(rows.where("id < 10"), voters).collect()}
    assert score[1] == pytest.approx(1) and score[0] == pytest.approx(second / (first + second))
    assert score[5] == pytest.approx(1) and score[6] == pytest.approx(second / (first + second)) and score[7] == 0


def test_boosting_ends_without_error_and_without_voters(spark):
    rows = spark.createDataFrame([(i, float(i < 2), 9.0) for i in range(6)], "id int, y double, weight double")
    voters, _ = models.boosted_on_draws(rows, lambda label: Fixed([]), "id", "y", rounds=5)
    assert [v for _, v in voters] == [1.0]
    none, _ = models.boosted_on_draws(rows, lambda label: Fixed([0, 1, 2]), "id", "y", rounds=5)
    assert none == []
    with pytest.raises(ValueError, match="chance"):
        models.voted_score(rows, none)


def test_boosting_with_trees(training):
    from pyspark.ml.classification import DecisionTreeClassifier

    make = lambda y: DecisionTreeClassifier(labelCol=y, featuresCol="features", weightCol="weight", maxDepth=1)
    voters, _ = models.boosted_on_draws(training, make, "id", "y", rounds=4, rate=0.5)
    scored = models.voted_score(training, voters)
    assert ranking.roc_auc(scored, "y", "score").first()["roc_auc"] > 0.8


def test_balanced_sample_takes_as_many_others(spark):
    rows = spark.createDataFrame([(i, {0: 1, 1: 0, 2: 2, 3: None}[min(i // 10, 3) if i < 40 else i % 3 + 1]) for i in range(100)], "id int, y int")
    counts = {r["y"]: r["count"] for r in balanced_sample(rows, "id", "y", "s").groupBy("y").count().collect()}
    assert counts[1] == 10 and None not in counts and counts.get(0, 0) + counts.get(2, 0) == 10
