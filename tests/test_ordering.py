"""Order-dependent operators against pandas, with hot keys and several partitionings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import ordering as o


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 4000
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"id": np.arange(n), "key": key, "value": np.round(rng.gamma(2.0, 3.0, n), 2)})


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals(spark, skewed, descending, parts):
    grouped = skewed.groupby(["key", "value"], as_index=False).size()
    rows = spark.createDataFrame(grouped).repartition(parts)
    got = o.running_totals(rows, "value", {"upto": "size"}, by=["key"], descending=descending, overall={"all": "size"}).toPandas()
    want = grouped.sort_values("value", ascending=not descending)
    want["upto"] = want.groupby("key")["size"].cumsum()
    want["all"] = want.groupby("key")["size"].transform("sum")
    both = got.merge(want, on=["key", "value"], suffixes=("", "_want"))
    assert len(both) == len(grouped)
    assert (both["upto"] == both["upto_want"]).all() and (both["all"] == both["all_want"]).all()


def test_range_cells_are_even_and_ordered(spark, skewed):
    rows = spark.createDataFrame(skewed[["id", "value"]].drop_duplicates("value"))
    cells = o.with_range_cell(rows, "value", cells=16).toPandas().sort_values("value")
    assert cells["_cell"].is_monotonic_increasing
    assert cells["_cell"].nunique() > 8
    assert cells.groupby("_cell").size().max() < len(cells) / 3


def test_sorted_codes(spark, skewed):
    got = o.sorted_codes(spark.createDataFrame(skewed), "value", "code").toPandas().sort_values("value")
    assert got["code"].tolist() == list(range(skewed["value"].nunique()))


@pytest.mark.parametrize("parts", [1, 5])
def test_hash_rank_is_a_full_numbering_and_ignores_partitions(spark, skewed, parts):
    rows = spark.createDataFrame(skewed).repartition(parts)
    got = o.hash_rank(rows, "id", "s", ["key"], out="r", size_out="n").toPandas()
    for _, group in got.groupby("key"):
        assert sorted(group["r"]) == list(range(1, len(group) + 1))
        assert (group["n"] == len(group)).all()
    again = o.hash_rank(spark.createDataFrame(skewed), "id", "s", ["key"], out="r").toPandas()
    assert got.set_index("id")["r"].sort_index().equals(again.set_index("id")["r"].sort_index())


def test_exact_quantiles(spark, skewed):
    got = o.exact_quantiles(spark.createDataFrame(skewed), "value", {"a": 0.25, "b": 0.5, "c": 0.9}, by=["key"]).toPandas()
    for row in got.itertuples():
        values = skewed.loc[skewed["key"] == row.key, "value"]
        assert np.allclose([row.a, row.b, row.c], values.quantile([0.25, 0.5, 0.9]))
    whole = o.exact_quantiles(spark.createDataFrame(skewed), "value", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(skewed["value"].median())


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("chunk", [10, 10_000])
def test_latest_before_with_gaps(spark, skewed, inclusive, chunk):
    data = skewed.assign(gap=skewed["value"].where(skewed["id"] % 3 == 0))
    rows = spark.createDataFrame(data[["id", "key", "value"]])
    value = F.when(F.col("id") % 3 == 0, F.col("value"))
    got = o.latest_before(rows, ["key"], ["id"], F.floor(F.col("id") / chunk), value, "seen", inclusive).toPandas().sort_values("id")
    want = data.sort_values("id").groupby("key")["gap"].ffill()
    if not inclusive:
        want = want.groupby(data["key"]).shift(1)
    assert np.allclose(got["seen"].to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_hot_key_is_cut_into_chunks(spark, skewed):
    """The plan never sorts a key as a whole: the chunk is part of the window's partition."""
    rows = spark.createDataFrame(skewed)
    frame = o.latest_before(rows, ["key"], ["id"], F.floor(F.col("id") / 100), F.col("value"), "seen")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "_near" in line]
    assert windows and all("_carry_chunk" in line.split("windowspecdefinition(")[1].split("ASC")[0] for line in windows)


def test_rows_without_a_stratum_keep_their_rank(spark):
    from ebbtide.functions.ordering import hash_rank

    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 4) for i in range(100)], "id long, label long")
    found = hash_rank(rows, "id", "s", strata=["label"], size_out="size").collect()
    assert len(found) == 100
    for label in (None, 1, 2, 3):
        own = [r for r in found if r.label == label]
        assert sorted(r["rank"] for r in own) == list(range(1, 26)) and {r["size"] for r in own} == {25}
