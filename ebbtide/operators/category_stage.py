"""One-hot columns with a bucket for rare categories, as stages that Spark ML fits, saves and loads."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RareOneHot(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Finds the categories with at least ``minRows`` training rows.

    Categories are ordered as their column is and become text. More than ``maxCategories`` of them are an error: so wide a
    vector wants another encoding.
    """

    minRows = Param(Params._dummy(), "minRows", "training rows that a category of its own has", typeConverter=TypeConverters.toInt)
    maxCategories = Param(Params._dummy(), "maxCategories", "categories that may have a column", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol: str | None = None, outputCol: str | None = None, minRows: int = 5, maxCategories: int = 100_000
    ) -> None:
        super().__init__()
        self._setDefault(minRows=5, maxCategories=100_000)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RareOneHotModel:
        column, most = self.getInputCol(), self.getOrDefault(self.maxCategories)
        counts = dataset.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        frequent = counts.where(F.col("_n") >= self.getOrDefault(self.minRows)).orderBy(column)
        found = [r["c"] for r in frequent.select(F.col(column).cast("string").alias("c")).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{column} has more than {most} categories")
        return self._copyValues(RareOneHotModel(categories=found))


class RareOneHotModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A sparse vector with one place per known category and a last one for all others: rare, unseen and null."""

    categories = Param(Params._dummy(), "categories", "known categories in order", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, categories: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(categories=[])
        if categories is not None:
            self._set(categories=categories)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known, index, text = self.getOrDefault(self.categories), f"_{self.uid}_index", f"_{self.uid}_text"
        named = dataset.withColumn(text, F.col(self.getInputCol()).cast("string"))
        if known:
            placed = StringIndexerModel.from_labels(known, inputCol=text, outputCol=index, handleInvalid="keep").transform(named)
        else:
            one = {"ml_attr": {"type": "nominal", "vals": ["other"]}}
            placed = named.withColumn(index, F.lit(0.0).alias(index, metadata=one))
        # the width is in the column's metadata: nothing is read to fit this
        hot = OneHotEncoder(inputCols=[index], outputCols=[self.getOutputCol()], dropLast=False)
        return hot.fit(placed).transform(placed).drop(index, text)
