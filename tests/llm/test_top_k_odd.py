"""Exact top-k: large components, repeated ids, empty tables and clashing columns against Python integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ebbtide.llm.vector_search import exact_type, top_k

SCHEMA = StructType([
    StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("_v", StringType()),
    StructField("score", IntegerType()), StructField("rank", IntegerType()),
])
LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, k=5, every=50):
    whole = [(i, [max(LOW, min(HIGH, math.floor(256 * x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        score = lambda b: max(LOW + 2, min(HIGH, sum(x * y for x, y in zip(a, b))))
        found = sorted((-score(b), i) for i, b in whole if i != q and len(b) == len(a))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("size", [1.0, 6e4, 1e12, 1e25])
@pytest.mark.parametrize("shard", [8192, 40])
def test_components_of_any_size(spark, size, shard):
    pick = np.random.default_rng(5)
    rows = [(i, (pick.normal(size=8) * (size if i % 3 else 1.0)).tolist()) for i in range(180)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties go to the smaller id
    found = top_k(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), shard_rows=shard)
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_repeated_ids_nulls_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.0, 5.0]), (50, [2.0, 2.0]), (100, [1.0]), (None, [9.0, 9.0]),
            (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 1.0]), (7, [2.0]), (-50, [1.0, 1.0])]
    found = [tuple(r) for r in top_k(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), k=20).collect()]
    assert set(found) == brute(rows, k=20) and len(found) == len(set((q, r) for q, r, _, _ in found))
    hot = [(0, [float(i % 7), 1.0]) for i in range(300)] + [(9, [1.0, 1.0]), (8, [2.0, 0.0])]
    seen = {tuple(r) for r in top_k(spark.createDataFrame([(*r, "x", 1, 2) for r in hot], SCHEMA), shard_rows=50).collect()}
    assert {v for _, _, v, _ in seen} == {8, 9}


def test_no_rows(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(50, [1.0], "x", 1, 2)], SCHEMA)).count() == 0


def test_exact_types():
    assert [exact_type(n, 64) for n in (1 << 20, 1 << 24, 1 << 40)] == [float, np.int64, object]
