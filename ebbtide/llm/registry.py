"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.substring_dedup import joined_words, substring_dedup

    found = substring_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined_words(), 256).alias("kept_sha256"))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op1_substring_dedup"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
 twice AS (SELECT hash(s) AS h FROM win GROUP BY hash(s) HAVING count(*) > 1),
 hit AS (SELECT doc_id, i FROM win WHERE hash(s) IN (SELECT h FROM twice)),
 gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 35)) AS k)),
 per AS (SELECT doc_id, list(p) AS g, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE
    [w[x] FOR x IN list_sort(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(g, p)))] END, ' ')) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""


@query
def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.mixing import mix

    return mix(table(spark, folder, "documents")).drop("source")


@query
def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from ebbtide.llm.bpe import bpe_round_trip

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_round_trip(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.quality_rules import quality_rules

    found = quality_rules(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept"
    )


SQL["op7_quality_rules"] = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, hash(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
 again AS (SELECT doc_id, h FROM win GROUP BY doc_id, h HAVING count(*) > 1),
 cover AS (SELECT DISTINCT doc_id, i + k AS p FROM win SEMI JOIN again USING (doc_id, h), (SELECT unnest(range(0, 5)) AS k)),
 repeats AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY doc_id),
 line AS (SELECT doc_id, source, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS l FROM d),
 dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line GROUP BY doc_id),
 norm AS (SELECT doc_id, source, lower(trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS l,
   len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n FROM line),
 hot AS (SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT doc_id) > 20),
 gone AS (SELECT doc_id, sum(n) AS n FROM norm JOIN hot ON norm.l = hot.l AND norm.source IS NOT DISTINCT FROM hot.source GROUP BY doc_id),
 s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
   FROM d LEFT JOIN dups ON d.doc_id = dups.doc_id LEFT JOIN repeats ON d.doc_id = repeats.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_line_words >= 10
    AND n_words - n_line_words >= n_words * 0.5e0 AS kept
FROM s
"""


@query
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.vector_search import top_k

    return top_k(table(spark, folder, "embeddings"))


SQL["op9_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


def trusted_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, folder, "documents"), trusted_ids(spark, folder))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.toxicity import labelled_sample, teaching, toxicity

    docs = table(spark, folder, "documents")
    scored = toxicity(docs, labelled_sample(docs, teaching(table(spark, folder, "labels"), "doc_id")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.jaccard_join import jaccard_components

    found = jaccard_components(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.suffix_dedup import suffix_dedup

    found = suffix_dedup(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from ebbtide.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.period_runs import period_runs, repeated_tails, run_digests

    found = period_runs(repeated_tails(table(spark, folder, "documents")))
    return found.select("doc_id", *run_digests())


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.prefix_trie import prefix_trie, shared_beginnings, turn_lists

    return prefix_trie(shared_beginnings(turn_lists(table(spark, folder, "conversations"))))


@query
def op13_neighbour_search(spark: SparkSession, folder: str) -> DataFrame:
    from ebbtide.llm.neighbour_graph import nearest_found

    return nearest_found(table(spark, folder, "embeddings"))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
