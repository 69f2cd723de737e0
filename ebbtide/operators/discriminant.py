"""Closed-form discriminant classifiers from distributed sums of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUAD = -1  # position of the summed fourth power of the row norm


@dataclass(frozen=True)
class ClassMoments:
    rows: int
    mean: np.ndarray
    deviation: np.ndarray
    covariance: np.ndarray  # of the standardised features, divided by rows
    fourth: float  # sum of the fourth powers of the standardised row norms


def class_moments(rows: DataFrame, features: Sequence[str], label: str) -> dict[int, ClassMoments]:
    """Two passes: means and deviations natively, then product sums per partition.

    What reaches the driver has features x features numbers per class.
    """
    names = list(features)
    first = rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("m"),
        F.array(*[F.stddev_pop(c) for c in names]).alias("d"),
    ).collect()
    size = len(names)
    centre = {int(r[label]): np.array(r["m"], float) for r in first}
    scale = {int(r[label]): np.where(np.array(r["d"], float) == 0, 1.0, np.array(r["d"], float)) for r in first}

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[int, np.ndarray] = {}
        quads: dict[int, float] = {}
        for frame in frames:
            for value, part in frame.groupby("y"):
                x = (np.stack(part["x"].to_numpy()) - centre[int(value)]) / scale[int(value)]
                grams[int(value)] = grams.get(int(value), 0.0) + x.T @ x
                quads[int(value)] = quads.get(int(value), 0.0) + float((((x * x).sum(1)) ** 2).sum())
        for value, gram in grams.items():
            yield pd.DataFrame({"y": value, "position": np.arange(QUAD, size * size), "total": np.append(quads[value], gram.ravel())})

    arrays = rows.select(F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    sums = arrays.mapInPandas(products, "y int, position int, total double").groupBy("y", "position").agg(F.sum("total").alias("t"))
    out = {int(r[label]): [int(r["n"]), np.zeros((size, size)), 0.0] for r in first}
    for r in sums.collect():
        if r["position"] == QUAD:
            out[r["y"]][2] = r["t"]
        else:
            out[r["y"]][1].flat[r["position"]] = r["t"]
    return {y: ClassMoments(n, centre[y], scale[y], gram / n, quad) for y, (n, gram, quad) in out.items()}


def shrunk_covariance(m: ClassMoments) -> np.ndarray:
    """Ledoit-Wolf shrinkage of the standardised covariance, back on the feature scale."""
    p, n = len(m.mean), m.rows
    mu = np.trace(m.covariance) / p
    square = float((m.covariance ** 2).sum())
    noise = (m.fourth / n - square) / (p * n)
    distance = (square - 2 * mu * np.trace(m.covariance) + p * mu * mu) / p
    weight = 0.0 if distance <= 0 else min(max(noise, 0.0), distance) / distance
    shrunk = (1 - weight) * m.covariance + weight * mu * np.eye(p)
    return m.deviation[:, None] * shrunk * m.deviation[None, :]


@dataclass(frozen=True)
class LinearDiscriminant:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """Probability of class 1 as a native expression."""
        z = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights):
            z = z + F.lit(w) * F.col(name)
        return 1.0 / (1.0 + F.exp(-z))


def fit_linear(rows: DataFrame, features: Sequence[str], label: str) -> LinearDiscriminant:
    moments = class_moments(rows, features, label)
    if set(moments) != {0, 1}:
        raise ValueError("both classes 0 and 1 are needed")
    total = sum(m.rows for m in moments.values())
    pooled = sum((m.rows / total) * shrunk_covariance(m) for m in moments.values())
    weights = {y: np.linalg.lstsq(pooled, m.mean, rcond=None)[0] for y, m in moments.items()}
    bias = {y: -0.5 * m.mean @ weights[y] + np.log(m.rows / total) for y, m in moments.items()}
    return LinearDiscriminant(tuple(features), tuple(float(w) for w in weights[1] - weights[0]), float(bias[1] - bias[0]))


@dataclass(frozen=True)
class QuadraticDiscriminant:
    features: tuple[str, ...]
    means: dict[int, np.ndarray]
    inverses: dict[int, np.ndarray]
    offsets: dict[int, float]

    def score(self) -> Column:
        """Probability of class 1; one matrix product per Arrow batch."""
        means, inverses, offsets = self.means, self.inverses, self.offsets

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            values = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(means[0])))
            logs = {}
            for y, mean in means.items():
                centred = values - mean
                logs[y] = offsets[y] - 0.5 * np.einsum("ij,jk,ik->i", centred, inverses[y], centred)
            return pd.Series(1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))

        return probability(F.array(*[F.col(c).cast("double") for c in self.features]))


def fit_quadratic(rows: DataFrame, features: Sequence[str], label: str, regularisation: float = 0.2) -> QuadraticDiscriminant:
    moments = class_moments(rows, features, label)
    if set(moments) != {0, 1}:
        raise ValueError("both classes 0 and 1 are needed")
    total = sum(m.rows for m in moments.values())
    inverses, offsets = {}, {}
    for y, m in moments.items():
        plain = m.deviation[:, None] * m.covariance * m.deviation[None, :] * (m.rows / max(m.rows - 1, 1))
        used = (1 - regularisation) * plain + regularisation * np.eye(len(features))
        inverses[y] = np.linalg.inv(used)
        offsets[y] = float(np.log(m.rows / total) - 0.5 * np.linalg.slogdet(used)[1])
    return QuadraticDiscriminant(tuple(features), {y: m.mean for y, m in moments.items()}, inverses, offsets)
