"""From raw documents to token ids: quality, near duplicates, repeated passages, source mix, encoding.

Every stage works on all that its predecessor kept. A stage's result is written as Parquet to the shared checkpoint folder and
read again by the next one, so a lost executor costs at most the tasks of one stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.blocks import blocks, rows_of, take_rows
from ebbtide.llm.bpe import bpe_encode
from ebbtide.llm.jaccard_join import one_per_component
from ebbtide.llm.mixing import mix
from ebbtide.llm.quality_classifier import quality_scores
from ebbtide.llm.registry import table, trusted_ids
from ebbtide.llm.substring_dedup import substring_dedup
from ebbtide.session import checkpoint_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps; id, language and 96 bits of the text stand for a row, equal ones are judged alike."""
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias("_mark"), F.hash("text").alias("_check"))
    scores = quality_scores(marked, trusted_ids(spark, sf_dir), carry=("_mark", "_check"))
    rejected = scores.where("not kept").select("doc_id", "lang", "_mark", "_check").distinct()
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in rejected.columns]
    return marked.alias("d").join(rejected.alias("r"), same, "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component of texts that share 0.8 of their 5-word shingles: the smallest id, without id only alone."""
    return one_per_component(docs, carry=COLUMNS, width=5, percent=80).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 35-word windows that occur elsewhere; n_chars follows the text."""
    cut = substring_dedup(docs, carry=("lang", "source"))
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes each of them, with or without id; texts without words are not taken."""
    docs = docs.select(*COLUMNS)
    packed = blocks(docs, "text", COLUMNS)
    taken = mix(rows_of(packed, docs.schema), carry=("block", "row")).where("taken > 0")
    return take_rows(packed, taken.select("block", "row", F.expr("taken div size").alias("copies")), COLUMNS, docs.schema)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(docs, ranks, public_tokenizers.PATTERN, carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL expresses neither the model of the first stage nor the merges of the last: the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
