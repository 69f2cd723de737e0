"""Exact neighbours against brute force, with several cells, blocks and slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import neighbours as nn
from ebbtide.operators.sequence_smote import between, between_all, sequence_smote, warped, warping_path


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 6, (6, 4))
    x = np.vstack([rng.normal(centres[i % 6], 1.0) for i in range(600)])
    x[100:300] = x[0]  # a third of the rows are copies of one row
    return pd.DataFrame({"id": np.arange(600), "vec": x.tolist(), "y": (np.arange(600) % 5 == 0).astype(int),
                         "kind": [f"k{i % 3}" for i in range(600)]})


def brute(queries, base, k, itself):
    q, b = np.stack(queries["vec"]), np.stack(base["vec"])
    out = {}
    for row, name in zip(q, queries["id"]):
        far = np.sqrt(((b - row) ** 2).sum(1))
        order = [i for i in np.lexsort((base["id"], far)) if not (itself and base["id"].iloc[i] == name)][:k]
        out[name] = [(int(base["id"].iloc[i]), far[i]) for i in order]
    return out


@pytest.mark.parametrize("block_rows", [16, 100, 4096])
@pytest.mark.parametrize("itself", [True, False])
def test_nearest_is_exact(spark, points, block_rows, itself):
    base = points if itself else points[points["id"] % 2 == 0]
    queries = points if itself else points[points["id"] % 2 == 1]
    got = nn.nearest(spark.createDataFrame(queries), spark.createDataFrame(base), 4, row_id="id", vector="vec", itself=itself,
                     block_rows=block_rows).toPandas().sort_values(["id", "place"])
    want = brute(queries, base, 4, itself)
    assert len(got) == 4 * len(queries)
    for name, group in got.groupby("id"):
        assert group["neighbour"].tolist() == [i for i, _ in want[name]]
        assert np.allclose(group["distance"], [far for _, far in want[name]], atol=1e-9)


def test_fewer_rows_than_neighbours_and_no_rows(spark, points):
    rows = spark.createDataFrame(points.head(3))
    assert nn.nearest(rows, rows, 5, row_id="id", vector="vec", itself=True).count() == 6
    assert nn.nearest(rows, rows.where("id < 0"), 5, row_id="id", vector="vec").count() == 0


def test_smote_balances_and_stays_between(spark, points):
    rows = spark.createDataFrame(points)
    made = nn.smote(rows, "id", "vec", "y", 1, "s", categories=["kind"]).toPandas()
    assert len(made) == (points["y"] == 0).sum() - (points["y"] == 1).sum()
    vectors = {r.id: np.array(r.vec) for r in points.itertuples()}
    few = set(points.loc[points["y"] == 1, "id"])
    assert set(made["id"]) <= few and set(made["neighbour"]) <= few and made["kind"].isin(["k0", "k1", "k2"]).all()
    for r in made.itertuples():
        assert np.allclose(r.vec, vectors[r.id] + r.alpha * (vectors[r.neighbour] - vectors[r.id]))
    again = nn.smote(rows.repartition(3), "id", "vec", "y", 1, "s").toPandas()
    assert set(zip(made["id"], made["copy"], made["neighbour"])) == set(zip(again["id"], again["copy"], again["neighbour"]))


def test_borderline_edited_and_tomek(spark, points):
    rows = spark.createDataFrame(points)
    plan = nn.adasyn_plan(rows, "id", "vec", "y", 1)
    seeds = nn.danger_rows(plan)
    share = plan.toPandas().set_index("id")["majority_share"]
    assert set(r["id"] for r in seeds.collect()) == set(share[(share >= 0.5) & (share < 1)].index)
    made = nn.smote(rows, "id", "vec", "y", 1, "s", seeds=seeds)
    assert set(r["id"] for r in made.select("id").distinct().collect()) <= set(share[(share >= 0.5) & (share < 1)].index)
    kept = {r["id"] for r in nn.edited(rows, "id", "vec", "y").select("id").collect()}
    want = set()
    label = points.set_index("id")["y"]
    for name, near in brute(points, points, 3, True).items():
        if sum(label[i] == label[name] for i, _ in near) * 2 > 3:
            want.add(name)
    assert kept == want
    links = nn.tomek_links(rows, "id", "vec", "y").toPandas()
    left = {r["id"] for r in nn.without_tomek(rows, "id", "vec", "y").select("id").collect()}
    assert left == set(points["id"]) - set(links["id"]) - set(links["neighbour"])


def test_oversampled_then_cleaned(spark, points):
    rows = spark.createDataFrame(points.iloc[::3])
    few, many = (points.iloc[::3]["y"] == 1).sum(), (points.iloc[::3]["y"] == 0).sum()
    full = nn.with_synthetic(rows, nn.smote(rows, "id", "vec", "y", 1, "s"), "id", "vec", "y", 1).persist()
    assert full.count() == 2 * many == full.select("id").distinct().count()
    assert full.where("synthetic").count() == many - few
    full.unpersist()
    for by in ("edited", "tomek"):
        kept = nn.smote_cleaned(rows, "id", "vec", "y", 1, "s", by=by)
        assert 0 < kept.count() <= 2 * many
    with pytest.raises(ValueError):
        nn.smote_cleaned(rows, "id", "vec", "y", 1, "s", by="other")


def test_knn_score_exact_match_decides(spark):
    train = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 0), (3, [0.0, 2.0], 0)], "id int, vec array<double>, y int")
    ask = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.5, 0.0])], "id int, vec array<double>")
    got = {r["id"]: r["score"] for r in nn.knn_score(ask, train, "id", "vec", "y", 1, 3).collect()}
    far = np.sqrt(0.25 + 4)
    assert got[10] == 1.0 and got[11] == pytest.approx(2 / (2 + 2 + 1 / far))


def test_warping():
    a, b = np.array([[0.0], [1.0], [2.0]]), np.array([[0.0], [0.0], [2.0]])
    path = warping_path(a, b)
    assert path[0] == (0, 0) and path[-1] == (2, 2)
    assert all(0 <= i2 - i1 <= 1 and 0 <= j2 - j1 <= 1 for (i1, j1), (i2, j2) in zip(path, path[1:]))
    assert np.allclose(between(a, a, 0.7), [[0.0], [1.0], [2.0]])
    assert np.allclose(between(np.array([[1.0], [0.0]]), np.array([[1.0], [0.0]]), 0.5), [[1.0], [1.0]])


def test_sequence_smote(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.normal(size=(6, 2)).tolist(), int(i < 6)) for i in range(20)], "id int, seq array<array<double>>, y int")
    made = sequence_smote(rows, "id", "seq", "y", 1, "s", k=3).collect()
    assert len(made) == 8 and all(len(r["sequence"]) == 6 and len(r["sequence"][0]) == 2 for r in made)
    assert {r["id"] for r in made} <= set(range(6))


def test_label_share_matches_counts(spark, points):
    rows = spark.createDataFrame(points)
    around = nn.nearest(rows, rows, 5, row_id="id", vector="vec", itself=True)
    shares = nn.majority_share(around, rows, "id", "y", 1, 5)
    assert shares.where((F.col("majority_share") < 0) | (F.col("majority_share") > 1)).count() == 0


def pairs_compared(search, visits):
    sizes = dict(enumerate(search.cells.rows.tolist()))
    return sum(sizes[r["cell"]] * r["count"] for r in visits.groupBy("cell").count().collect())


def test_two_rounds_compare_few_pairs(spark):
    """Clustered rows of 8 dimensions: both rounds together meet under a tenth of all pairs, and miss none that counts."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 8, (40, 8))
    x = np.vstack([rng.normal(centres[i % 40], 1.0) for i in range(6000)])
    data = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "vec": x.tolist()}))
    search = nn.Search(data, data, 5, "id", "vec", True, 4096)
    assert len(search.cells.pivots) == 78
    found = search.best(search.measured(search.first())).persist()
    compared = pairs_compared(search, search.first()) + pairs_compared(search, search.second(found))
    assert compared < 0.1 * 6000 ** 2
    got = nn.nearest(data, data, 5, row_id="id", vector="vec", itself=True).toPandas().sort_values(["id", "place"])
    want = brute(pd.DataFrame({"id": np.arange(6000), "vec": list(x)}).head(300), pd.DataFrame({"id": np.arange(6000), "vec": list(x)}), 5, True)
    for name, near in want.items():
        assert got.loc[got["id"] == name, "neighbour"].tolist() == [i for i, _ in near]


def test_number_of_pivots_follows_the_rows(spark):
    rows = spark.range(90000).selectExpr("id", "array(cast(id as double)) as vec")
    assert len(nn.Search(rows, rows, 1, "id", "vec", True, 4096).cells.pivots) == 300


@pytest.mark.parametrize(("offset", "scale"), [(1e7, 1.0), (0.0, 1e7), (1e7, 1e-3)])
def test_exact_at_large_norms(spark, offset, scale):
    rng = np.random.default_rng(8)
    x = offset + scale * rng.normal(0, 1, (500, 3))
    x[200:260] = x[:60]  # ties go to the smaller id
    frame = pd.DataFrame({"id": np.arange(500), "vec": x.tolist()})
    got = nn.nearest(*[spark.createDataFrame(frame)] * 2, 4, row_id="id", vector="vec", itself=True, block_rows=64)
    got = got.toPandas().sort_values(["id", "place"])
    for name, near in brute(frame, frame, 4, True).items():
        assert got.loc[got["id"] == name, "neighbour"].tolist() == [i for i, _ in near]


def test_null_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [2.0])], "id int, vec array<double>")
    found = nn.nearest(rows, rows, 3, row_id="id", vector="vec", itself=True).collect()
    assert sorted((r["id"], r["neighbour"], r["distance"]) for r in found) == [(1, 5, 2.0), (5, 1, 2.0)]


def test_categories_count_as_distance(spark, points):
    frame = points.assign(other=[f"o{i % 7 % 2}" if i % 11 else None for i in range(600)])
    rows = spark.createDataFrame(frame)
    few = frame[frame["y"] == 1]
    x = np.stack(few["vec"])
    deviation = np.median(x.std(axis=0))
    assert nn.median_deviation(rows.where("y = 1"), "vec") == pytest.approx(deviation)
    kinds = few[["kind", "other"]].astype(object).where(few[["kind", "other"]].notna(), "none").to_numpy()
    near = {}
    for row, kind, name in zip(x, kinds, few["id"]):
        far = np.sqrt(((x - row) ** 2).sum(1) + deviation ** 2 / 2 * (kinds != kind).sum(1))
        near[name] = {i for i in few["id"].to_numpy()[np.lexsort((few["id"], far))] if i != name}, [
            int(i) for i in few["id"].to_numpy()[np.lexsort((few["id"], far))] if i != name][:5]
    got = nn.nearest(rows.where("y = 1"), rows.where("y = 1"), 5, row_id="id", vector="vec", itself=True, block_rows=16,
                     categories=["kind", "other"], penalty=float(deviation ** 2 / 2)).toPandas().sort_values(["id", "place"])
    for name, (_, five) in near.items():
        assert got.loc[got["id"] == name, "neighbour"].tolist() == five
    made = nn.smotenc(rows, "id", "vec", ["kind", "other"], "y", 1, "s").toPandas()
    assert len(made) == (frame["y"] == 0).sum() - (frame["y"] == 1).sum()
    assert all(r.neighbour in near[r.id][1] for r in made.itertuples())


def test_allocation_by_largest_remainder(spark):
    hits = spark.createDataFrame([(i, h) for i, h in enumerate([5, 5, 3, 3, 3, 1, 0, 0])], "id int, hits bigint")
    for wanted in (0, 1, 7, 20, 101):
        got = {r["id"]: r["copies"] for r in nn.allocated(hits, F.lit(wanted).cast("bigint"), "s").collect()}
        assert sum(got.values()) == wanted
        for i, h in enumerate([5, 5, 3, 3, 3, 1, 0, 0]):
            assert got[i] in (h * wanted // 20, h * wanted // 20 + 1)
    assert {r["copies"] for r in nn.allocated(hits.withColumn("hits", F.lit(0).cast("bigint")), F.lit(9).cast("bigint"), "s").collect()} == {0}


def test_adasyn_and_borderline_rows(spark, points):
    rows = spark.createDataFrame(points)
    gap = (points["y"] == 0).sum() - (points["y"] == 1).sum()
    copies = nn.adasyn_copies(rows, "id", "vec", "y", 1, "s").toPandas().set_index("id")
    label = points.set_index("id")["y"]
    for name, near in brute(points[points["y"] == 1], points, 5, True).items():
        assert copies.loc[name, "hits"] == sum(label[i] != 1 for i, _ in near)
    assert copies["copies"].sum() == gap
    made = nn.adasyn(rows, "id", "vec", "y", 1, "s").toPandas()
    assert len(made) == gap and made.groupby("id").size().to_dict() == copies.loc[copies["copies"] > 0, "copies"].to_dict()
    near = {n: {i for i, _ in v} for n, v in brute(points[points["y"] == 1], points[points["y"] == 1], 5, True).items()}
    vectors = {r.id: np.array(r.vec) for r in points.itertuples()}
    for r in made.itertuples():
        assert r.neighbour in near[r.id]
        assert np.allclose(r.vec, vectors[r.id] + r.alpha * (vectors[r.neighbour] - vectors[r.id]))
    seeds = {n for n, v in brute(points[points["y"] == 1], points, 10, True).items() if 5 <= sum(label[i] != 1 for i, _ in v) < 10}
    assert set(nn.borderline_smote(rows, "id", "vec", "y", 1, "s").toPandas()["id"]) <= seeds


def test_edited_by_all_neighbours(spark, points):
    rows = spark.createDataFrame(points)
    label = points.set_index("id")["y"]
    want = {n for n, near in brute(points, points, 3, True).items() if all(label[i] == label[n] for i, _ in near)}
    assert {r["id"] for r in nn.edited(rows, "id", "vec", "y", rule="all").select("id").collect()} == want
    with pytest.raises(ValueError, match="rule"):
        nn.edited(rows, "id", "vec", "y", rule="most")


def loop_path(a, b):
    """The alignment step by step, one pair at a time."""
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            total[i, j] = ((a[i - 1] - b[j - 1]) ** 2).sum() + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    i, j, path = len(a), len(b), []
    while i and j:
        path.append((i - 1, j - 1))
        step = int(np.argmin([total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]]))
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return path[::-1]


def loop_between(a, b, alpha):
    made = np.zeros_like(a)
    for i, j in loop_path(a, b):
        if not made[i].any():
            made[i] = a[i] + alpha * (b[j] - a[i])
    for t in range(1, len(made)):
        if not made[t].any():
            made[t] = made[t - 1]
    return made


@pytest.mark.parametrize(("m", "n", "channels"), [(7, 7, 3), (1, 5, 2), (6, 1, 1), (9, 4, 2)])
def test_warping_of_many_pairs_equals_one_by_one(m, n, channels):
    rng = np.random.default_rng(m)
    # whole numbers give ties between ways and steps of zeros
    a, b = rng.integers(-1, 2, (60, m, channels)).astype(float), rng.integers(-1, 2, (60, n, channels)).astype(float)
    alpha = rng.choice([0.0, 0.25, 0.5, 1.0], 60)
    made = between_all(a, b, alpha)
    for x, y, t, z in zip(a, b, alpha, made):
        assert warping_path(x, y) == loop_path(x, y)
        assert np.array_equal(z, loop_between(x, y, t))


def test_zero_steps_take_a_later_partner():
    a, b = np.array([[1.0], [0.0], [0.0]]), np.array([[1.0], [0.0], [0.0]])
    assert between(a, b, 0.5).ravel().tolist() == [1.0, 1.0, 1.0]
    a, b = np.array([[-1.0], [5.0]]), np.array([[1.0], [-3.0], [5.0]])
    assert loop_path(a, b) == [(0, 0), (0, 1), (1, 2)]
    assert between(a, b, 0.5).ravel().tolist() == [-2.0, 5.0]  # halfway to the first partner is zero


def test_sequences_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(4, 2)).tolist(), 1) for i in range(5)] + [(9 + i, rng.normal(size=(4, 2)).tolist(), 0) for i in range(12)]
    data = spark.createDataFrame(rows, "id int, seq array<array<float>>, y int")
    vectors = {r["id"]: np.array(r["seq"], float) for r in data.collect()}
    made = sequence_smote(data, "id", "seq", "y", 1, "s", k=3).collect()
    assert len(made) == 7
    for r in made:
        assert np.allclose(r["sequence"], loop_between(vectors[r["id"]], vectors[r["neighbour"]], r["alpha"]))
    ragged = pa.RecordBatch.from_pydict({"a": [[[1.0], [1.0, 2.0]]], "b": [[[1.0]]], "alpha": [0.5], "id": [1], "copy": [1], "neighbour": [2]})
    with pytest.raises(ValueError, match="channels"):
        list(warped(ragged))
