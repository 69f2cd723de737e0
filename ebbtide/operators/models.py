"""Spark ML classifiers: candidates, scoring, ensembles, search, comparison."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Binarizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import ranking
from ebbtide.operators.crm import SEGMENT_CODES, assert_no_ids
from ebbtide.operators.sampling import balanced_sample, stratified_folds
from ebbtide.session import pin

FEATURES = "features"
WEIGHT = "weight"
Factory = Callable[[str], Estimator]


def assemble(rows: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric features as one vector; ids and the target may not be among them, encodings of the value segment may."""
    assert_no_ids([f for f in features if not f.startswith(SEGMENT_CODES)], ids=("PID", "account_id", "CHURN", label))
    doubles = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    kept = [c for c in dict.fromkeys([*keep, label]) if c in rows.columns]
    return rows.select(*kept, array_to_vector(doubles).alias(FEATURES))


def feature_pipeline(numeric: Sequence[str], categories: Sequence[str]) -> Pipeline:
    """Category indexing, one-hot and assembly for tables with text columns."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep") for c in categories]
    hot = [OneHotEncoder(inputCols=[f"{c}_ix" for c in categories], outputCols=[f"{c}_hot" for c in categories])] if categories else []
    columns = [*numeric, *[f"{c}_hot" for c in categories]]
    return Pipeline(stages=[*index, *hot, VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="keep")])


def candidates(width: int, seed: int = 42) -> dict[str, Factory]:
    """The model families of the comparison, by name; each takes the label column."""
    common = {"featuresCol": FEATURES}
    return {
        "logistic_l2": lambda y: LogisticRegression(labelCol=y, weightCol=WEIGHT, maxIter=200, regParam=0.01, **common),
        "logistic_l1": lambda y: LogisticRegression(labelCol=y, weightCol=WEIGHT, maxIter=200, regParam=0.01, elasticNetParam=1.0, **common),
        "random_forest": lambda y: RandomForestClassifier(labelCol=y, weightCol=WEIGHT, numTrees=300, maxDepth=10, seed=seed, **common),
        "boosting": lambda y: GBTClassifier(labelCol=y, weightCol=WEIGHT, maxIter=300, stepSize=0.05, maxDepth=6, seed=seed, **common),
        "decision_tree": lambda y: DecisionTreeClassifier(labelCol=y, weightCol=WEIGHT, maxDepth=5, minInstancesPerNode=8, seed=seed, **common),
        "linear_svc": lambda y: LinearSVC(labelCol=y, weightCol=WEIGHT, maxIter=100, regParam=0.01, **common),
        "gaussian_nb": lambda y: NaiveBayes(labelCol=y, weightCol=WEIGHT, modelType="gaussian", **common),
        "bernoulli_nb": lambda y: Pipeline(stages=[
            Binarizer(inputCol=FEATURES, outputCol="binary", threshold=0.0),
            NaiveBayes(featuresCol="binary", labelCol=y, weightCol=WEIGHT, modelType="bernoulli")]),
        "perceptron": lambda y: MultilayerPerceptronClassifier(labelCol=y, layers=[width, 16, 2], maxIter=100, seed=seed, **common),
    }


def with_balance_weight(rows: DataFrame, label: str) -> DataFrame:
    """Row weights that give both classes the same total."""
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    wide = rows.withColumn("_c", counts.select(F.struct("p", "n")).scalar())
    own = F.when(F.col(label) == 1, F.col("_c.p")).otherwise(F.col("_c.n") - F.col("_c.p"))
    return wide.withColumn(WEIGHT, F.coalesce(F.try_divide(F.col("_c.n"), 2 * own), F.lit(1.0))).drop("_c")


def score_with(model: Model, rows: DataFrame, out: str = "score") -> DataFrame:
    """Positive-class score: the probability, or the margin where a model has none."""
    before = rows.columns
    done = model.transform(rows)
    source = "probability" if "probability" in done.columns else "rawPrediction"
    return done.select(*before, vector_to_array(F.col(source))[1].alias(out))


def score_by_function(rows: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str], out: str = "score") -> DataFrame:
    """Score with any Python model: ``predict`` gets Arrow batches of the feature columns."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out: predict(frame[list(features)]).to_numpy()})

    schema = rows.withColumn(out, F.lit(0.0)).schema
    return rows.mapInPandas(run, schema)


def mean_score(rows: DataFrame, models: Sequence[Model], out: str = "score") -> DataFrame:
    """Soft vote of fitted models."""
    names = [f"_s{i}" for i in range(len(models))]
    scored = reduce(lambda df, pair: score_with(pair[1], df, pair[0]), zip(names, models), rows)
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return scored.withColumn(out, total / len(names)).drop(*names)


def balanced_bagging(train: DataFrame, make: Factory, row_id: str, label: str, draws: int, seed: str = "42") -> list[Model]:
    """Models on balanced draws; average them with ``mean_score``."""
    out = []
    for i in range(draws):
        sample = balanced_sample(train, row_id, label, f"{seed}:{i}").withColumn(WEIGHT, F.lit(1.0))
        out.append(make(label).fit(sample))
    return out


def boosted_on_draws(
    train: DataFrame, make: Factory, row_id: str, label: str, rounds: int, rate: float = 0.03, seed: str = "42"
) -> tuple[list[tuple[Model, float]], DataFrame]:
    """Boosting in which every round fits a balanced draw: the models with their votes, and the last row weights.

    All rows begin with equal weights, which add up to 1. A round fits a draw of the rows with their weights and asks the model for the classes of
    all rows: its error e is the weight of the rows it gets wrong, its vote ``rate`` * ln((1 - e) / e). Wrong rows then weigh
    exp(vote) times as much. A model without an error votes 1 and ends the rounds, one no better than chance ends them without
    a vote. The weights are a column that is written every round. Rows without a label take no part.
    """
    known = train.where(F.col(label).isNotNull())
    size = known.agg(F.count(F.lit(1))).scalar()
    state, out = pin(known.drop(WEIGHT).withColumn(WEIGHT, 1.0 / size)), []
    for i in range(rounds):
        model = make(label).fit(balanced_sample(state, row_id, label, f"{seed}:{i}"))
        judged = model.transform(state).select(*state.columns, (F.col("prediction") != F.col(label)).cast("double").alias("_wrong"))
        error = judged.agg((F.sum(F.col(WEIGHT) * F.col("_wrong")) / F.sum(WEIGHT)).alias("e")).first()["e"]
        if error is None or error >= 0.5:
            break
        if error <= 0.0:
            out.append((model, 1.0))
            break
        vote = rate * math.log((1.0 - error) / error)
        out.append((model, vote))
        # the weights add up to 1 before: wrong ones now hold error * exp(vote) of the total
        total = 1.0 + error * (math.exp(vote) - 1.0)
        state = pin(judged.withColumn(WEIGHT, F.col(WEIGHT) * F.exp(F.lit(vote) * F.col("_wrong")) / F.lit(total)).drop("_wrong"))
    return out, state.select(row_id, WEIGHT)


def voted_score(rows: DataFrame, voters: Sequence[tuple[Model, float]], out: str = "score") -> DataFrame:
    """The share of the votes that go to the positive class."""
    if not voters:
        raise ValueError("no model was better than chance")
    names, before = [f"_p{i}" for i in range(len(voters))], rows.columns
    done = rows
    for name, (model, _) in zip(names, voters):
        done = model.transform(done).select(*done.columns, F.col("prediction").alias(name))
    total = sum(v for _, v in voters)
    votes = reduce(lambda a, b: a + b, [F.when(F.col(n) == 1, F.lit(v)).otherwise(F.lit(0.0)) for n, (_, v) in zip(names, voters)])
    return done.select(*before, (votes / total).alias(out))


def out_of_fold_scores(train: DataFrame, make: Factory, row_id: str, label: str, folds: int = 3, seed: str = "42", out: str = "score") -> DataFrame:
    """Every training row scored by the model that did not see its fold.

    The scores are written once: the next model reads them in every iteration.
    """
    folded = stratified_folds(train, row_id, label, seed, folds, out="_fold").persist()
    try:
        parts = []
        for k in range(folds):
            model = make(label).fit(folded.where(F.col("_fold") != k))
            parts.append(score_with(model, folded.where(F.col("_fold") == k), out))
        return pin(reduce(DataFrame.unionByName, parts).drop("_fold"))
    finally:
        folded.unpersist()


def stacked(train: DataFrame, makes: Mapping[str, Factory], row_id: str, label: str, folds: int = 3) -> tuple[dict[str, Model], Model]:
    """Base models, and a logistic model over their out-of-fold scores."""
    table = train.select(row_id, label)
    for name, make in makes.items():
        scores = out_of_fold_scores(train, make, row_id, label, folds, out=name).select(row_id, name)
        table = table.join(scores, row_id)
    meta_rows = table.select(label, array_to_vector(F.array(*makes)).alias(FEATURES))
    base = {name: make(label).fit(train) for name, make in makes.items()}
    return base, LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=100).fit(meta_rows)


def stacked_score(rows: DataFrame, base: Mapping[str, Model], meta: Model, out: str = "score") -> DataFrame:
    scored = reduce(lambda df, item: score_with(item[1], df, item[0]), base.items(), rows)
    inputs = scored.withColumn("_meta", array_to_vector(F.array(*base)))
    kept = [c for c in rows.columns if c != FEATURES]
    done = meta.transform(inputs.select(*kept, F.col("_meta").alias(FEATURES)))
    return done.select(*kept, vector_to_array("probability")[1].alias(out))


def calibrated(train: DataFrame, make: Factory, row_id: str, label: str, folds: int = 3) -> tuple[Model, Callable[[DataFrame], DataFrame]]:
    """Platt scaling: a logistic model of out-of-fold scores on top of the full model."""
    scores = out_of_fold_scores(train, make, row_id, label, folds, out="_raw")
    fit_on = scores.select(label, array_to_vector(F.array("_raw")).alias(FEATURES))
    sigmoid = LogisticRegression(featuresCol=FEATURES, labelCol=label, maxIter=100).fit(fit_on)
    slope, bias = float(sigmoid.coefficients[0]), float(sigmoid.intercept)
    model = make(label).fit(train)

    def score(rows: DataFrame, out: str = "score") -> DataFrame:
        raw = score_with(model, rows, "_raw")
        return raw.withColumn(out, 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("_raw") + bias)))).drop("_raw")

    return model, score


def sweep(
    splits: DataFrame, makes: Mapping[str, Factory], feature_sets: Mapping[str, Sequence[str]], row_id: str, label: str, split: str = "split"
) -> tuple[DataFrame, dict[tuple[str, str], Model]]:
    """Fit every candidate on every feature set; a failing one leaves a row with its error.

    Metric rows: threshold tuned on val, measured on test.
    """
    spark = splits.sparkSession
    tables, failures, fitted = [], [], {}
    for set_name, columns in feature_sets.items():
        data = assemble(splits, columns, label, keep=[row_id, split]).persist()
        train = with_balance_weight(data.where(F.col(split) == "train"), label)
        for name, make in makes.items():
            began = time.perf_counter()
            try:
                model = make(label).fit(train)
                scored = score_with(model, data.where(F.col(split) != "train"))
                metrics = ranking.tuned_evaluation(scored, label, "score", split)
                tables.append(metrics.select(
                    F.lit(set_name).alias("feature_set"), F.lit(name).alias("model"), F.lit("ok").alias("status"),
                    F.lit(None).cast("string").alias("error"), F.lit(time.perf_counter() - began).alias("fit_seconds"), *metrics.columns))
                fitted[(set_name, name)] = model
            except Exception as problem:  # a broken candidate must not end the comparison
                failures.append((set_name, name, "failed", str(problem) or type(problem).__name__))
        data.unpersist()
    failed = spark.createDataFrame(failures, "feature_set string, model string, status string, error string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*tables, failed]), fitted


def cross_validated(
    train: DataFrame, estimator: Estimator, grid: list, row_id: str, label: str, folds: int = 5, metric: str = "areaUnderPR", parallelism: int = 2
) -> CrossValidatorModel:
    """Grid or random search over fixed stratified folds."""
    folded = stratified_folds(train, row_id, label, "42", folds, out="_fold")
    evaluator = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, foldCol="_fold", parallelism=parallelism)
    return search.fit(folded)


#: The ranges of the published search, as (low, high) and the kind of draw.
SEARCH_RANGES = {
    "max_depth": (4, 8, "int"),
    "learning_rate": (0.01, 0.10, "float"),
    "scale_pos_weight": (3.0, 10.0, "float"),
    "subsample": (0.6, 0.9, "float"),
    "colsample": (0.6, 0.9, "float"),
    "min_child_weight": (2, 10, "int"),
}


def parameter_draws(ranges: Mapping[str, tuple[float, float, str]], count: int, seed: int = 42) -> dict[str, dict[str, float]]:
    """``count`` settings by name, each parameter drawn from its range: ``int``, ``float``, or ``log`` for even magnitudes."""
    rng, out = random.Random(seed), {}
    for i in range(count):
        drawn = {}
        for name, (low, high, kind) in ranges.items():
            if kind == "int":
                drawn[name] = rng.randint(int(low), int(high))
            elif kind == "log":
                drawn[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
            elif kind == "float":
                drawn[name] = rng.uniform(low, high)
            else:
                raise ValueError(f"unknown kind of draw {kind!r}")
        out[f"draw_{i:03d}"] = drawn
    return out


def weight_grid(weights: Sequence[float], fixed: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """One setting per positive-class weight, the other parameters fixed."""
    return {f"weight_{w:g}": {**fixed, "scale_pos_weight": float(w)} for w in weights}


def boosting_of(setting: Mapping[str, float], label: str, rounds: int = 100, seed: int = 42) -> Estimator:
    """Spark's boosting with the parameters of a setting; the class weight is a row weight, set by the caller."""
    return GBTClassifier(
        labelCol=label, weightCol=WEIGHT, featuresCol=FEATURES, maxIter=rounds, seed=seed, maxDepth=int(setting.get("max_depth", 5)),
        stepSize=float(setting.get("learning_rate", 0.1)), subsamplingRate=float(setting.get("subsample", 1.0)),
        minInstancesPerNode=int(setting.get("min_child_weight", 1)), featureSubsetStrategy=str(float(setting.get("colsample", 1.0))))


def searched(
    train: DataFrame, settings: Mapping[str, Mapping[str, float]], row_id: str, label: str, folds: int = 5, seed: str = "42",
    make: Callable[[Mapping[str, float], str], Estimator] = boosting_of,
) -> tuple[DataFrame, DataFrame]:
    """(means, failures) of settings over fixed stratified folds.

    Every setting is fitted on all folds but one and scores that one; the scores of all settings and folds are written once and
    measured together. Positive rows weigh ``scale_pos_weight``. A setting that cannot be fitted leaves a row with its error.
    """
    spark = train.sparkSession
    folded = stratified_folds(train.where(F.col(label).isNotNull()), row_id, label, seed, folds, out="_fold").persist()
    parts, failures = [], []
    try:
        for name, setting in settings.items():
            weight = F.when(F.col(label) == 1, F.lit(float(setting.get("scale_pos_weight", 1.0)))).otherwise(F.lit(1.0))
            weighted = folded.withColumn(WEIGHT, weight)
            try:
                own = []
                for k in range(folds):
                    model = make(setting, label).fit(weighted.where(F.col("_fold") != k))
                    scored = score_with(model, weighted.where(F.col("_fold") == k))
                    own.append(scored.select(F.lit(name).alias("candidate"), "_fold", label, "score"))
                parts += own
            except Exception as problem:  # a broken setting must not end the search
                failures.append((name, str(problem) or type(problem).__name__))
        empty = spark.createDataFrame([], f"candidate string, _fold int, {label} double, score double")
        scores = pin(reduce(lambda a, b: a.unionByName(b), parts)) if parts else empty
    finally:
        folded.unpersist()
    means = ranking.metric_means(ranking.fold_metrics(scores, label, "score", "candidate", "_fold"), "candidate")
    return means, spark.createDataFrame(failures, "candidate string, error string")


def importance_table(spark: SparkSession, model: Model, features: Sequence[str], name: str) -> DataFrame:
    """Feature importances, or absolute coefficients of a linear model."""
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    rows = [(name, f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def permutation_drop(
    rows: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], row_id: str, label: str, seed: str = "42"
) -> DataFrame:
    """Loss of AUC when one feature's values are exchanged between rows."""
    from ebbtide.operators.sampling import attach_random

    base = ranking.roc_auc(score(rows), label, "score").select(F.lit("").alias("feature"), "roc_auc")
    tables = [base]
    for f in features:
        other = rows.select(F.col(row_id).alias("_other"), F.col(f).alias("_swap"))
        mixed = attach_random(rows, row_id, other, "_other", f"{seed}:{f}").withColumn(f, F.col("_swap")).drop("_swap", "_other")
        tables.append(ranking.roc_auc(score(mixed), label, "score").select(F.lit(f).alias("feature"), "roc_auc"))
    table = reduce(DataFrame.unionByName, tables)
    whole = table.where(F.col("feature") == "").select("roc_auc").scalar()
    return table.where(F.col("feature") != "").withColumn("_all", whole).select("feature", (F.col("_all") - F.col("roc_auc")).alias("drop"))


def ablation_sets(groups: Mapping[str, Sequence[str]], ranked: Sequence[str], tops: Sequence[int] = (1, 3, 5)) -> dict[str, list[str]]:
    """Feature sets without one group each, and without the most important features."""
    every = list(dict.fromkeys(f for fs in groups.values() for f in fs))
    out = {"baseline": every}
    out |= {f"remove_group:{g}": [f for f in every if f not in fs] for g, fs in groups.items()}
    out |= {f"remove_top{k}": [f for f in every if f not in ranked[:k]] for k in tops}
    return {name: fs for name, fs in out.items() if fs}


def save_bundle(spark: SparkSession, model: PipelineModel, path: str, threshold: float, features: Sequence[str]) -> None:
    """A fitted pipeline with its threshold and feature list."""
    model.write().overwrite().save(f"{path}/model")
    info = spark.createDataFrame([(float(threshold), list(features))], "threshold double, features array<string>")
    info.coalesce(1).write.mode("overwrite").json(f"{path}/info")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, float, list[str]]:
    info = spark.read.schema("threshold double, features array<string>").json(f"{path}/info").first()
    return PipelineModel.load(f"{path}/model"), info["threshold"], list(info["features"])


def decide(rows: DataFrame, threshold: float, score: Column | str = "score", out: str = "predicted") -> DataFrame:
    value = F.col(score) if isinstance(score, str) else score
    return rows.withColumn(out, value >= threshold)
