"""The labelled sample of the toxicity field moves hashes only; scores and spans follow from the marginals of each text alone."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ebbtide.llm import registry
from ebbtide.llm.kernels import bytes_of
from ebbtide.llm.toxicity import features, fitted, labelled_sample, sample_keys, teaching, tokens, toxicity

SMALL = "/root/testdata/sf0.001"


def test_sample_holds_the_first_distinct_texts(spark, documents):
    rows = [(1, "a b", "x"), (2, "a b", "x"), (3, "c", "x"), (3, "d", "x"), (4, None, "x"), (None, "e", "x"), (5, "", "x"), (6, "f", "x")]
    docs = documents(rows)
    labels = spark.createDataFrame(
        [(1, 1, 9), (1, 1, 9), (2, 0, 9), (3, 0, 9), (4, 1, 9), (None, 1, 9), (5, None, 9), (7, 1, 9)], "doc_id long, toxic int, text long")
    expected = {("a b", 1), ("a b", 0), ("c", 0), ("d", 0), (None, 1)}
    found = [tuple(r) for r in labelled_sample(docs, labels).collect()]
    assert len(found) == len(expected) and set(found) == expected
    order = {r.text: (r.h, r.c) for r in docs.select("text", F.xxhash64("text").alias("h"), F.hash("text").alias("c")).collect()}
    first = sorted(expected, key=lambda x: (*order[x[0]], x[1]))[:3]
    assert {tuple(r) for r in labelled_sample(docs, labels, sample=3).collect()} == set(first)
    assert labelled_sample(docs.limit(0), labels).count() == 0


def test_no_text_is_exchanged(spark):
    docs, labels = (registry.table(spark, SMALL, n) for n in ("documents", "labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sample_keys(docs, labels, "doc_id", "text", "toxic", 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [plan[m.end():].split("\n", 2)[1] for m in re.finditer(r"Exchange hashpartitioning", plan)]
    assert len(below) >= 2 and not any(re.search(r"(?<=[\[ ])text#\d+[,\]]", line) for line in below)


def test_spans_and_scores_of_each_text(spark):
    docs, labels = (registry.table(spark, SMALL, n) for n in ("documents", "labels"))
    sample = labelled_sample(docs, teaching(labels, "doc_id"))
    weights, moves = fitted(sample, "text", "toxic", 3000)
    assert weights.any()
    short = docs.where("length(text) < 120").unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    marked = 0
    for r in toxicity(short, sample, carry=("text",)).collect():
        words = tokens(*bytes_of(pa.array([r.text or ""])))
        n = len(words.starts)
        p = np.zeros(n)
        if 0 < n <= 12:  # every labelling of the tokens
            gain = weights[features(words)].sum(axis=1, dtype=np.float64)
            total = 0.0
            for path in itertools.product((0, 1), repeat=n):
                value = np.exp(sum(moves[a, b] for a, b in zip((0, *path), path)) + gain[np.array(path) == 1].sum())
                total += value
                p += value * np.array(path)
            p /= total
            assert abs(r.score - min(1.0, p.max())) < 1e-6
            hit = (p >= 0.5).tolist()
            spans, at = [], 0
            for mark, group in itertools.groupby(hit):
                size = len(list(group))
                if mark:
                    spans.append((int(words.starts[at]), int(words.ends[at + size - 1])))
                at += size
            assert [tuple(s) for s in r.spans] == spans and r.predicted == int(r.score >= 0.5)
            marked += 1
        elif not n:
            assert r.score == 0 and r.predicted == 0 and r.spans == []
    assert marked > 5
