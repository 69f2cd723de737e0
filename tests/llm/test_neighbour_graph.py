"""Neighbour graph search: recall and distances against brute force, odd rows, the pieces of a round."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ebbtide.llm import registry
from ebbtide.llm.neighbour_graph import Codes, Settings, best_of_rows, nearest_found, squared

VECTORS = StructType([
    StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("raw", StringType()),
    StructField("node", LongType()), StructField("code", LongType()),
])


def brute(rows, k, every):
    """{query id: [(distance, id), ...]} of distinct rows, all distances."""
    rows = sorted({(i, tuple(float(x) + 0.0 for x in v)) for i, v in rows if i is not None and v is not None and len(v)
                   and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for dim in {len(v) for _, v in rows}:
        ids = np.array([i for i, v in rows if len(v) == dim])
        data = np.array([v for _, v in rows if len(v) == dim])
        for at in np.flatnonzero(ids % every == 0):
            far = np.sqrt(((data - data[at]) ** 2).sum(axis=1))
            pairs = sorted((d, i) for d, i in zip(far.tolist(), ids.tolist()) if i != ids[at])
            out.setdefault(int(ids[at]), []).append(pairs[:k])
    return out


def found_by_query(frame):
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id, r["rank"]))
    return out


def recall(found, expected):
    hits = [len({i for _, i, _ in found[q]} & {i for _, i in e[0]}) / max(1, len(e[0])) for q, e in expected.items()]
    return float(np.mean(hits))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_on_its_table(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in registry.table(spark, folder, "embeddings").collect()]
    expected = brute(rows, 10, 100)
    found = found_by_query(registry.op13_neighbour_search(spark, folder))
    assert set(found) == set(expected)
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, answers in found.items():
        assert [r for _, _, r in answers] == list(range(1, 11)) and answers == sorted(answers, key=lambda a: a[:2])
        for score, other, _ in answers:
            assert other != q and score == pytest.approx(np.sqrt(((vectors[q] - vectors[other]) ** 2).sum()), abs=1e-12)
    assert recall(found, expected) >= 0.95


def test_clusters_copies_and_offsets(spark):
    """Tight clusters of near copies, a third of all rows equal, vectors far from zero."""
    pick = np.random.default_rng(3)
    rows, number = [], 0
    for centre in pick.normal(size=(12, 16)) * 50 + 1000:
        for v in centre + pick.normal(size=(90, 16)) * pick.choice([0.001, 1.0]):
            rows.append((number, v.tolist()))
            number += 1
    same = rows[100][1]
    rows += [(number + n, same) for n in range(500)]
    data = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    expected = brute(rows, 10, 10)
    found = found_by_query(nearest_found(data, every=10))
    assert set(found) == set(expected) and recall(found, expected) >= 0.95
    inside = [q for q in expected if q >= number]
    for q in inside:  # equal rows: the smallest ids at distance 0
        assert [(d, i) for d, i, _ in found[q]] == expected[q][0]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, [1.0, -0.0]), (2, None), (3, [0.0, -0.0]), (4, []), (5, [1.0, None]),
        (6, [float("nan"), 1.0]), (7, [1.0, float("inf")]), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (9, [0.0, 0.0]), (100, [1.0, 2.0, 3.0]),
        (200, [1.0]), (300, [3.0]), (400, [0.0, 1.0]), (-100, [1e9, 0.0]), (11, [1.0, 2.0, 4.0]),
    ]
    found = nearest_found(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)).collect()
    got = sorted((r.query_id, r.score, r.vec_id) for r in found)
    expected = sorted((q, d, i) for q, lists in brute(rows, 10, 100).items() for pairs in lists for d, i in pairs)
    assert [g[::2] for g in got] == [e[::2] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected])


def test_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert nearest_found(empty).count() == 0
    assert nearest_found(spark.createDataFrame([(100, [1.0, 2.0], "x", 1, 2)], VECTORS)).count() == 0


def test_small_settings_still_find(spark):
    """Many rounds with short lists: what the first groups part is joined by the rounds and the search."""
    pick = np.random.default_rng(9)
    rows = [(n, v.tolist()) for n, v in enumerate(pick.normal(size=(1500, 6)))]
    data = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)
    use = Settings(lists=12, sample=6, sets=2, per_pivot=30, beam=40, step=8, rounds=6)
    expected = brute(rows, 10, 25)
    assert recall(found_by_query(nearest_found(data, every=25, use=use)), expected) >= 0.95


def test_codes_and_best():
    pick = np.random.default_rng(1)
    pivots = pick.normal(size=(5, 7)) * 100
    vectors = pivots[pick.integers(0, 5, 60)] + pick.normal(size=(60, 7))
    cell, made = Codes({7: pivots}).encode(vectors)
    assert np.abs(Codes({7: pivots}).decode(made) - vectors).max() < 0.02 and (squared(vectors, pivots).argmin(1) == cell).all()
    row, ids = np.array([0, 0, 0, 1, 1, 0]), np.array([5, 6, 5, 9, 8, 7])
    far = np.array([2.0, 1.0, 0.5, 3.0, 3.0, 9.0])
    assert best_of_rows(row, ids, far, 2).tolist() == [1, 0, 4, 3]


def test_small_table_runs_few_tasks_at_many_shuffle_partitions(spark):
    """Tasks follow the rows, not the shuffle partitions, where Spark does not merge these; the rows found stay the same."""
    pick = np.random.default_rng(5)
    rows = [(n, v.tolist(), "x", 1, 2) for n, v in enumerate(pick.normal(size=(600, 8)))]
    data, use = spark.createDataFrame(rows, VECTORS), Settings(lists=12, sample=6, sets=2, per_pivot=60, beam=40, step=16, rounds=2)
    expected = brute([r[:2] for r in rows], 10, 25)
    context, many = spark.sparkContext, 48
    held = {"spark.sql.shuffle.partitions": str(many), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        context.setJobGroup("op13-tasks", "tasks of a small search")
        found = found_by_query(nearest_found(data, every=25, use=use))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    status = context.statusTracker()
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("op13-tasks")]
    stages = [status.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
    # stages that were skipped have no completed tasks
    tasks = [s.numCompletedTasks for s in stages if s and s.numCompletedTasks]
    assert set(found) == set(expected) and recall(found, expected) >= 0.95
    assert sum(t >= many for t in tasks) < 0.6 * len(tasks), sorted(tasks)
