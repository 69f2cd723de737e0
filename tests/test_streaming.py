"""Streams give what the batch gives, survive a restart and repeat nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import decisions as d
from ebbtide.operators import windows_agg as wa
from ebbtide.plans.activity import USAGE_DAYS
from ebbtide.sources.feeds import USAGE_CUTOFF
from ebbtide.streaming import aggregates, sinks
from ebbtide.streaming.alerts import alert_stream, verdicts


def write_parts(frame, path, column, parts):
    """One input file per part, in order."""
    for i in range(parts):
        frame.where(F.col(column) % parts == i).coalesce(1).write.mode("append").parquet(str(path))


def test_usage_totals_equal_the_batch(spark, feeds, tmp_path):
    logs = feeds.usage_logs()
    write_parts(logs.withColumn("part", F.dayofmonth("log_date")), tmp_path / "in", "part", 4)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = aggregates.usage_totals(stream, USAGE_CUTOFF, USAGE_DAYS)
    query = totals.writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.table("totals").withColumnRenamed("first_log_date", "a").toPandas().set_index("entity_id").sort_index()
    want = wa.usage_windows(logs, USAGE_CUTOFF, USAGE_DAYS).withColumnRenamed("first_log_date", "a").toPandas().set_index("entity_id").sort_index()
    pd.testing.assert_frame_equal(got, want[got.columns], check_exact=False, rtol=1e-12)


def fold(events):
    """The alert rule applied to one customer after another, event by event."""
    answers, state = {}, {}
    for e in sorted(events, key=lambda r: (r["event_time"], r["event_id"])):
        p = e["churn_probability"]
        level = "Critical" if p >= .8 else "High" if p >= .65 else "Medium" if p >= .5 else "Low"
        last, before, before_level = state.get(e["customer_id"], (None, None, None))
        if level in ("Low", "Medium"):
            required = False
        elif before is not None and p - before >= d.SPIKE:
            required = True
        elif before_level is not None and d.RISK_RANKS[level.upper()] > d.RISK_RANKS[before_level.upper()]:
            required = True
        elif last is None:
            required = True
        elif (e["response_status"] or "").strip().lower() in d.RESOLVED_WORDS:
            required = False
        else:
            hours = 24 if level == "Critical" else 72
            required = (e["event_time"] - last).total_seconds() >= hours * 3600
        state[e["customer_id"]] = (e["event_time"] if required else last, p, level)
        answers[e["event_id"]] = required
    return answers


@pytest.fixture(scope="module")
def alert_input(feeds):
    return feeds.alert_events().withColumn("event_time", F.col("event_time").cast("timestamp"))


def run(spark, source, schema, folder):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(source))
    query = sinks.run_available(alert_stream(stream), str(folder / "log"), str(folder / "checkpoint"))
    query.awaitTermination(300)
    return query


def test_alerts_equal_a_sequential_fold_across_restarts(spark, alert_input, tmp_path):
    days = alert_input.withColumn("day", F.dayofmonth("event_time"))
    schema = alert_input.schema
    source = tmp_path / "in"
    for low, high in ((1, 10), (11, 20), (21, 31)):
        days.where(F.col("day").between(low, high)).select(alert_input.columns).coalesce(1).write.mode("append").parquet(str(source))
        run(spark, source, schema, tmp_path)
    run(spark, source, schema, tmp_path)  # nothing new: nothing is repeated
    log = sinks.read_log(spark.read.parquet(str(tmp_path / "log")), ["customer_id", "event_id"]).collect()
    want = fold([r.asDict() for r in alert_input.collect()])
    assert len(log) == len(want)
    assert {r["event_id"]: r["alert_required"] for r in log} == want
    assert any(want.values()) and not all(want.values())


def known_before(events):
    """What the policy knows before each event: last alert, probability and level of the event before."""
    out, state = {}, {}
    answers = fold(events)
    for e in sorted(events, key=lambda r: (r["event_time"], r["event_id"])):
        out[e["event_id"]] = state.get(e["customer_id"], (None, None, None))
        p = e["churn_probability"]
        level = "Critical" if p >= .8 else "High" if p >= .65 else "Medium" if p >= .5 else "Low"
        state[e["customer_id"]] = (e["event_time"] if answers[e["event_id"]] else out[e["event_id"]][0], p, level)
    return out


def test_stream_and_column_rule_agree(spark, alert_input, tmp_path):
    """Level, channel and reason of the stream are those of the batch rule with what was known before each event."""
    alert_input.coalesce(1).write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path / "in", alert_input.schema, tmp_path)
    known = [(k, t, p, level) for k, (t, p, level) in known_before([r.asDict() for r in alert_input.collect()]).items()]
    before = spark.createDataFrame(known, "event_id bigint, last timestamp, pp double, pl string")
    rule = d.alert_decision(
        d.risk_level("churn_probability"), F.col("churn_probability"), F.unix_micros("last"), F.unix_micros("event_time"),
        F.col("response_status"), F.col("pp"), F.col("pl"), F.col("is_vip_customer"), F.col("is_high_revenue_customer"))
    want = alert_input.join(before, "event_id").select(
        "event_id", d.risk_level("churn_probability").alias("risk_level"), rule.alias("r")).select(
        "event_id", "risk_level", "r.alert_required", "r.alert_channel", "r.suppress_reason")
    got = spark.read.parquet(str(tmp_path / "log")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select("suppress_reason").distinct().count() >= 4


def test_quiet_customers_are_forgotten(spark, tmp_path):
    schema = ("event_id bigint, customer_id bigint, event_time timestamp, churn_probability double, response_status string, "
              "is_vip_customer boolean, is_high_revenue_customer boolean")

    def put(rows):
        made = spark.createDataFrame(
            [(i, c, t, 0.9, status, None, None) for i, c, t, status in rows],
            schema.replace("event_time timestamp", "event_time string")).withColumn("event_time", F.to_timestamp("event_time"))
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = alert_stream(stream, delay="1 hour", keep_hours=48)
        sinks.run_available(out, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination(300)

    put([(1, 1, "2024-01-01 00:00:00", None), (2, 1, "2024-01-01 10:00:00", None), (3, 2, "2024-01-01 10:00:00", None)])
    put([(4, 1, "2024-01-02 08:00:00", "completed"), (5, 1, "2024-01-02 07:00:00", None)])  # 5 is earlier than 4
    put([(6, 3, "2024-01-20 00:00:00", None)])  # the watermark passes the timers of the others
    put([(7, 1, "2024-01-21 00:00:00", "completed"), (8, 3, "2024-01-20 01:00:00", "completed"), (9, 2, "2024-01-03 00:00:00", None)])
    got = {r["event_id"]: r["suppress_reason"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {1: None, 2: d.REASON_CRITICAL, 3: None, 4: d.REASON_RESOLVED, 5: None, 6: None, 7: None, 8: d.REASON_RESOLVED}


def test_verdicts_depend_on_the_last_alert():
    hour = 3_600_000_000
    ask = lambda t, p, rank, closed, last=None, bp=None, br=None: verdicts(
        np.array(t) * hour, np.array(p), np.array(rank), np.array(closed), np.where(np.array(rank) == 3, 24, 72), last, bp, br)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in ask([0, 23, 24, 50], [.9] * 4, [3] * 4, [False] * 4)] == [[0, 2, 0, 0], 50 * hour]
    # an escalation alerts at once, a resolved case stays quiet, low levels change nothing
    found, last = ask([1, 2, 3, 4], [.7, .9, .9, .1], [2, 3, 3, 0], [False, True, True, True], last=0, bp=.7, br=2)
    assert found.tolist() == [2, 0, 1, 0] and last == 2 * hour


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    write = sinks.append_once(str(tmp_path / "log"))
    for rows in ([(1, "a")], [(1, "a"), (2, "b")]):
        write(spark.createDataFrame(rows, "k int, v string"), 0)
    write(spark.createDataFrame([(3, "c")], "k int, v string"), 1)
    frame = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["k"], r["v"]) for r in frame.collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_daily_energy_drops_late_rows(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "user int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([(1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-01 12:00:00", 2.0), (1, "2024-01-02 00:00:00", 4.0)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    daily = aggregates.daily_energy(stream, "user", "ts", "value")
    query = daily.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        put([(1, "2024-01-10 00:00:00", 8.0)])
        query.processAllAvailable()
        put([(1, "2024-01-01 13:00:00", 100.0), (1, "2024-01-20 00:00:00", 16.0)])
        query.processAllAvailable()
    finally:
        query.stop()
    got = {str(r["day"]): r["energy"] for r in spark.table("daily").collect()}
    assert got["2024-01-01"] == 3.0 and got["2024-01-02"] == 4.0


def test_daily_energy_in_order_equals_the_batch(spark, feeds, tmp_path):
    events = feeds.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    daily = aggregates.daily_energy(stream, "user_id", "ts", "value")
    query = daily.writeStream.outputMode("complete").format("memory").queryName("whole").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r["entity_id"], r["day"]): r["energy"] for r in spark.table("whole").collect()}
    want = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v")).collect()
    assert len(got) == len(want) and all(got[(r["user_id"], r["day"])] == pytest.approx(r["v"]) for r in want)
