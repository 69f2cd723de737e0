"""Feature builder, splits and weights: properties that must hold on any data."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.text import hash_token
from ebbtide.operators import crm, encoders, sampling
from ebbtide.operators.feature_builder import MODES, AccountFeatures
from ebbtide.operators.blending import blend_specs, candidate_weights, primary_auxiliary_specs
from ebbtide.operators.sequences import CHANNELS, last_steps, pad_right, present_channels, with_momentum


@pytest.fixture(scope="module")
def accounts(feeds):
    rows = feeds.crm_accounts().withColumn("y", F.when(F.lower(F.trim("CHURN")) == "yes", 1).otherwise(0))
    rows = rows.withColumn("row_id", F.concat_ws("/", "PID", "EffectiveSegment")).persist()
    yield rows
    rows.unpersist()


@pytest.mark.parametrize("mode", ["core", "encoded_compact"])
def test_builder_applies_to_unseen_rows(accounts, mode):
    train, other = accounts.where("cast(PID as int) % 4 > 0"), accounts.where("cast(PID as int) % 4 = 0")
    fitted, encoded = AccountFeatures("row_id", "y", mode, with_pid=mode != "core", snapshot=accounts).fit_transform(train)
    applied = fitted.transform(other)
    assert applied.columns == encoded.columns == ["row_id", "y", *fitted.feature_columns]
    assert applied.count() == other.count() and encoded.count() == train.count()
    assert applied.dropna().count() == applied.count()


def test_unknown_mode():
    with pytest.raises(ValueError):
        AccountFeatures("row_id", "y", "best")
    assert set(crm.CATEGORY_MODES) < set(MODES)


def test_out_of_fold_never_reads_its_own_fold(spark):
    """Flipping every label of one fold leaves that fold's encodings unchanged."""
    rows = pd.DataFrame({"id": range(200), "c": [f"c{i % 7}" for i in range(200)], "y": [int(i % 3 == 0) for i in range(200)], "fold": [i % 5 for i in range(200)]})
    flipped = rows.assign(y=rows["y"].where(rows["fold"] != 2, 1 - rows["y"]))
    for fold_prior in (True,):
        a = encoders.out_of_fold_target(spark.createDataFrame(rows), "c", "y", "fold", 10.0, "c", fold_prior).where("fold = 2").toPandas()
        b = encoders.out_of_fold_target(spark.createDataFrame(flipped), "c", "y", "fold", 10.0, "c", fold_prior).where("fold = 2").toPandas()
        assert a.set_index("id")["c_rate"].sort_index().equals(b.set_index("id")["c_rate"].sort_index())


def test_split_is_exhaustive_disjoint_and_stable(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id int, y int")
    a = sampling.stratified_split(rows, "id", "y", "s")
    b = sampling.stratified_split(rows.repartition(13), "id", "y", "s")
    assert a.count() == 1000 and a.exceptAll(b.select(a.columns)).count() == 0
    shares = {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}
    assert shares == {(0, "test"): 180, (0, "val"): 180, (0, "train"): 540, (1, "test"): 20, (1, "val"): 20, (1, "train"): 60}
    loose = {r["split"]: r["count"] for r in sampling.hashed_split(rows, "id", "s").groupBy("split").count().collect()}
    assert sum(loose.values()) == 1000 and 150 < loose["test"] < 250


def test_sample_is_the_first_in_hash_order(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(500)], "id int, v int")
    taken = {r["id"] for r in sampling.hash_sample(rows, "id", "s", 50, ["v"]).collect()}
    in_order = rows.dropna().orderBy(hash_token("s", "id"), "id").limit(50).collect()
    assert len(taken) == 50 and taken == {r["id"] for r in in_order}


def test_one_class_and_weights(spark):
    one = spark.createDataFrame([(i, 0) for i in range(5)], "id int, y int")
    assert sampling.class_weights(one, "y").first()["scale_pos_weight"] == 5.0
    assert sampling.balanced_sample(one, "id", "y", "s").count() == 0
    rows = spark.createDataFrame([(0, .9), (1, .1), (1, .5)], "y int, s double")
    for mode in sampling.FOCAL_MODES:
        mean = sampling.with_focal_weight(rows, "y", "s", 3.0, mode).agg(F.avg("weight")).first()[0]
        assert mean == pytest.approx(1.0)
    with pytest.raises(ValueError):
        sampling.focal_weight(F.col("y"), F.col("s"), 3.0, "other")


def test_one_hot_names(spark):
    rows = spark.createDataFrame([("A/b c",), (None,)], "seg string")
    wide = encoders.one_hot_columns(rows, "seg", "seg", ["A/b c", ""])
    assert wide.columns == ["seg", "seg_A_b_c", "seg_Unknown"]
    assert [r["seg_A_b_c"] for r in wide.collect()] == [1.0, 0.0]


def test_blend_specifications(spark):
    weights = candidate_weights(4, 40)
    assert len(weights) == 45 and all(abs(sum(w) - 1) < 1e-9 and min(w) >= 0 for w in weights.values())
    assert weights == candidate_weights(4, 40)
    specs = primary_auxiliary_specs(["a", "b"], ["c"], [0.1])
    assert specs == {"aux_0.10": {"a": 0.45, "b": 0.45, "c": 0.1}}
    long = spark.createDataFrame([(1, "a", .2), (1, "b", .4), (1, "c", 1.0)], "row_id int, member string, v double")
    table = spark.createDataFrame([("aux", k, v) for k, v in specs["aux_0.10"].items()], "blend string, member string, weight double")
    assert blend_specs(table, long, ["row_id"], "v").first()["score"] == pytest.approx(.37)


def test_sequence_shape_and_momentum(spark):
    daily = spark.createDataFrame([("u", 1, 100.0), ("u", 2, 80.0), ("v", 1, 5.0), ("v", 2, 5.0)], "e string, t int, x double")
    moved = with_momentum(daily, "e", "t", "x").where("e = 'u'").orderBy("t").collect()
    assert [r["momentum"] for r in moved] == pytest.approx([0.0, 80 / (100 + 1e-5)]) and [r["acceleration"] for r in moved] == [0.0, 0.0]
    wide = daily.withColumns({c: F.lit(1.0) for c in CHANNELS})
    used = present_channels(wide)
    padded = pad_right(last_steps(wide, "e", ["t"], used, 3), 3, len(used)).collect()
    assert used == list(CHANNELS) and len(padded) == 2
    assert all(len(r["sequence"]) == 3 and len(r["sequence"][0]) == 6 and r["length"] == 2 and r["sequence"][2] == [0.0] * 6 for r in padded)
    with pytest.raises(ValueError):
        present_channels(daily)


def test_newest_steps_are_limited_before_the_shuffle(feeds):
    steps = last_steps(feeds.transactions(), "entity_id", ["txn_date", "txn_id"], ["paid"], 30)
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_month_plan_never_shuffles_raw_rows(feeds):
    """Every scan of a log is partially aggregated before its exchange."""
    from ebbtide.plans import catalog

    frame = catalog.load()["customer_month"].plan(feeds)
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_month_filter_reaches_the_scan(spark):
    from ebbtide.plans.activity import monthly_paid
    from ebbtide.sources.feeds import Feeds

    paid = monthly_paid(Feeds(spark, "/root/testdata/sf0.001"), {"a": "2000-11", "b": "2000-12"})
    plan = paid._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(" in pushed and "LessThan(" in pushed
