"""Quality rules in DataFrame functions: text statistics and the frequency of lines across documents of a host."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def spaced(text: Column) -> Column:
    """Words parted by spaces; a text without rarer separators only swaps its line feeds."""
    lines = F.replace(text, F.lit("\n"), F.lit(" "))
    rarer = text.rlike(r"[\x09\x0B-\x0D]")
    return F.trim(F.when(rarer, F.translate(text, WHITE, " " * len(WHITE))).otherwise(lines))


def words_of(parted: Column) -> Column:
    """The words of a text that ``spaced`` has made; splitting at one space needs no pattern."""
    words = F.when(F.contains(parted, F.lit("  ")), F.split(parted, " +")).otherwise(F.split(parted, " "))
    return F.when(parted == "", F.array().cast("array<string>")).otherwise(words)


def normal_lines(text: Column) -> Column:
    """Lower-case lines with words, one space between words."""
    plain = F.when(text.rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return F.filter(F.transform(F.split(F.lower(plain), "\n"), F.trim), lambda line: line != "")


def without(text: Column, characters: str) -> Column:
    """The text without some characters."""
    return functools.reduce(lambda left, c: F.replace(left, F.lit(c), F.lit("")), characters, text)


def worded_lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    """Lower case, one space between words."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _with_repeated_words(rows: DataFrame, windows: str, width: int) -> DataFrame:
    """Add n_repeat_words, words covered by windows whose hash occurs twice: sort (hash, place), keep equal neighbours, add up the steps.

    Every step is a column of its own: an array that an expression names several times is made once. Texts without such a
    window have null arrays.
    """
    again = F.size(F.array_distinct(F.col(windows))) < F.size(F.col(windows))
    pairs = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    after = F.concat(F.slice("_pairs", 2, F.size("_pairs")), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    same = F.zip_with("_pairs", after, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    before = F.concat(F.array(F.lit(False)), F.slice("_same", 1, F.size("_same") - 1))
    marked = F.zip_with("_pairs", F.zip_with("_same", before, lambda a, b: a | b), lambda p, m: F.when(m, p["i"]))
    folded = F.aggregate(
        F.sort_array(F.array_compact(marked)), F.struct(F.lit(-width).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    steps = rows.withColumn("_pairs", F.when(again, pairs)).withColumn("_same", same)
    return steps.withColumn("n_repeat_words", F.coalesce(folded, F.lit(0).cast("bigint"))).drop("_pairs", "_same")


def statistics(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all bigint)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # every word is hashed once; a window is the hash of its words' hashes
    parted = docs.withColumn("_parted", spaced(whole)).withColumns({
        "_words": F.transform(words_of(F.col("_parted")), lambda w: F.xxhash64(w)), "_lines": worded_lines(whole),
    })
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("_words") - width), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(width)])
    )
    windows = F.when(F.size("_words") >= width, hashed).otherwise(F.array().cast("array<bigint>"))
    counted = parted.withColumns({"_windows": windows})
    return _with_repeated_words(counted, "_windows", width).select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(without(F.col("_parted"), " ")).cast("bigint").alias("word_chars"),
        F.when(
            whole.rlike(r"[#*$%&|<>]"), F.length(whole) - F.length(without(whole, SYMBOLS))
        ).otherwise(0).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    host: str = "source",
    carry: Sequence[str] = (),
    least_words: int = 10,
    most_repeated: int = 20,
    line_docs: int = 20,
    left_share: float = 0.5,
) -> DataFrame:
    """Statistics, base rules and the line rule of every document.

    A line (normalised, hashed) goes when more than ``line_docs`` documents of its host hold it, however large the host is. A document is depleted when the lines left hold fewer than ``least_words`` words or
    less than ``left_share`` of its words. Base failure: fewer than ``least_words`` words, or over ``most_repeated`` per
    cent of the words in repeated 5-word windows. Returns doc_id, ``carry``, the cleaned text, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_line_words (words of removed lines), base_failed and kept.

    A null text has no words and fails; a null host is a host; every row counts as a document, repeated or not. A line
    counts once per document, and the counts are partial sums before the shuffle,
    so a line that a third of all documents share costs one row per task.
    """
    named = [doc_id, *[c for c in carry if c not in (doc_id, text)]]
    if host not in named:
        named.append(host)
    rows = docs.select(*named, text).withColumn("_mark", F.xxhash64(text, host))
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = F.transform(
        normal_lines(whole), lambda line: F.struct(F.xxhash64(line).alias("h"), F.size(F.split(line, " ")).alias("n"))
    )
    # every line of a document in the order of its hash; ``first`` marks one line of each hash
    placed = rows.select(F.col(doc_id).alias("_id"), "_mark", F.col(host).alias("_host"), F.array_sort(counted).alias("_all"))
    shifted = F.concat(F.array(F.lit(None).cast("struct<h:bigint,n:int>")), F.slice("_all", 1, F.size("_all") - 1))
    first = F.zip_with("_all", F.when(F.size("_all") > 0, shifted).otherwise(F.col("_all")), lambda x, y: F.struct(
        x["h"].alias("h"), x["n"].alias("n"), F.coalesce(x["h"] != y["h"], F.lit(True)).alias("first")
    ))
    lines = placed.select("_id", "_mark", "_host", F.posexplode(first).alias("_place", "_x")).select(
        "_id", "_mark", "_host", "_place", F.col("_x.h").alias("_line"), F.col("_x.n").alias("_n"), F.col("_x.first").alias("_first")
    )
    hot = lines.groupBy("_host", "_line").agg(F.count_if("_first").alias("_in")).where(F.col("_in") > line_docs)
    same = F.col("a._host").eqNullSafe(F.col("b._host"))
    hit = lines.alias("a").join(hot.alias("b"), same & (F.col("a._line") == F.col("b._line"))).select(
        "_id", "_mark", "_place", F.col("a._line").alias("_line"), "_n"
    )
    # repeated rows hold the same places: each counts once
    removed = hit.distinct().groupBy("_id", "_mark").agg(F.sum("_n").alias("n_line_words"), F.collect_set("_line").alias("_gone"))
    known = statistics(rows, text)
    joined = known.alias("d").join(
        removed.alias("r"), F.col(f"d.{doc_id}").eqNullSafe(F.col("r._id")) & (F.col("d._mark") == F.col("r._mark")), "left"
    )
    gone = F.coalesce("n_line_words", F.lit(0)).cast("bigint")
    left = F.col("n_words") - gone
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(
        F.split(F.col(text), "\n"), lambda line: ~F.array_contains("_gone", F.xxhash64(normalised(line)))
    ), "\n"))
    return joined.select(
        *[F.col(f"d.{c}") for c in named], clean.alias(text), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        gone.alias("n_line_words"), base_failed.alias("base_failed"),
        (~base_failed & (left >= least_words) & (left >= F.col("n_words") * left_share)).alias("kept"),
    )
