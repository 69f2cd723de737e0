"""File sources and sinks."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a headerless postal gazetteer file.
GAZETTEER_COLUMNS = (
    "country_code", "postal_code", "place_name", "admin_name1", "admin_code1", "admin_name2", "admin_code2",
    "admin_name3", "admin_code3", "latitude", "longitude", "accuracy",
)


def strip_names(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.strip().lstrip("﻿") for c in frame.columns])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. With a declared schema nothing is read to infer types.

    Without one the types are inferred by a pass over the data: for small files only.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is None:
        return strip_names(reader.option("inferSchema", True).csv(path))
    return reader.schema(schema).csv(path)


def read_csv_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with every column as trimmed text; cast with ``to_double`` afterwards."""
    raw = strip_names(spark.read.option("header", True).csv(path))
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = GAZETTEER_COLUMNS) -> DataFrame:
    """Headerless tab-separated text columns."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def read_zipped_tsv(
    spark: SparkSession, path: str, member: str, columns: Sequence[str] = GAZETTEER_COLUMNS, rows_per_batch: int = 50_000
) -> DataFrame:
    """A headerless TSV member of each zip archive below ``path``.

    One archive is one task and is read in pieces; unpack large data beforehand.
    """
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open(member) as handle:
                    yield from pd.read_csv(handle, sep="\t", header=None, names=list(columns), dtype=str,
                                           encoding="utf-8", chunksize=rows_per_batch, keep_default_na=False, na_values=[""])

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """An optional source: no rows of the fixed schema when it is absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def write_parquet(frame: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    frame.write.mode(mode).partitionBy(*partition).parquet(path)


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    frame.write.mode(mode).option("header", True).csv(path)


def write_profile(profile: DataFrame, columns: Sequence[str], path: str) -> None:
    """A one-row description of a table, with its column names, as JSON."""
    names = F.array(*[F.lit(c) for c in columns])
    profile.withColumn("columns", names).coalesce(1).write.mode("overwrite").json(path)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """One policy document per file as text column ``policy``; none when absent."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "policy string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "policy")


def policy_override(variable: str = "CHURN_THRESHOLD") -> str | None:
    return os.environ.get(variable) or None


def append_log(rows: DataFrame, path: str, day: str = "log_day") -> None:
    """Append log rows to a table partitioned by day."""
    rows.write.mode("append").partitionBy(day).parquet(path)
