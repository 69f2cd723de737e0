"""Fixed example values of the decision and feature rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import decisions as d
from ebbtide.functions import numeric, text
from ebbtide.operators import alerts, crm, payloads, ranking
from ebbtide.operators.blending import min_max, weighted_average

NOW = "2026-05-14 09:00:00"


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()], F.lit(1).alias("_"))
    return row.select(column.alias("v")).first()["v"]


def decide(spark, **given):
    base = dict(risk_level="High", churn_probability=0.7, response_status=None, previous_churn_probability=None,
                previous_risk_level=None, is_vip_customer=False, is_high_revenue_customer=False, last_alert_time=None)
    base |= given
    schema = ("risk_level string, churn_probability double, response_status string, previous_churn_probability double, "
              "previous_risk_level string, is_vip_customer boolean, is_high_revenue_customer boolean, last_alert_time string")
    names = [c.split()[0] for c in schema.split(", ")]
    row = spark.createDataFrame([tuple(base[n] for n in names)], schema)
    now = d.wall_micros(F.lit(NOW).cast("timestamp_ntz"))
    return alerts.decide(row, now, d.alert_micros("last_alert_time")).first()


@pytest.mark.parametrize("given, required, channel, reason", [
    (dict(risk_level="High", churn_probability=0.72, last_alert_time="2026-05-13T09:00:00+00:00"), False, "None", "최근 3일"),
    (dict(risk_level="Critical", churn_probability=0.91, last_alert_time="2026-05-13T08:00:00Z", response_status="미대응"), True, "Slack", None),
    (dict(risk_level="Critical", churn_probability=0.81, previous_churn_probability=0.45, last_alert_time="2026-05-14T07:00:00+00:00"), True, "Slack", None),
    (dict(risk_level="Critical", churn_probability=0.9, last_alert_time="2026-05-13 07:00:00", response_status="대응완료"), False, "None", "대응이 완료"),
    (dict(risk_level="High", churn_probability=0.72, is_vip_customer=True), True, "Slack,Gmail", None),
    (dict(risk_level="Medium", churn_probability=0.58), False, "None", "Google Sheets"),
    (dict(risk_level="Low", churn_probability=0.22), False, "None", "Low"),
    (dict(risk_level="urgent", churn_probability=0.82, previous_risk_level="high_risk", last_alert_time="2026-05-14T17:00:00+09:00"), True, "Slack", None),
    (dict(risk_level="Critical", churn_probability=0.82, last_alert_time="2026-05-14T17:00:00+09:00"), False, "None", "최근 24시간"),
    (dict(risk_level="Critical", churn_probability=0.82, last_alert_time="no time"), True, "Slack", None),
])
def test_alert_policy(spark, given, required, channel, reason):
    got = decide(spark, **given)
    assert (got["alert_required"], got["alert_channel"], got["log_required"]) == (required, channel, True)
    assert (got["suppress_reason"] is None) if reason is None else (reason in got["suppress_reason"])


def test_alert_time_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Seoul", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [value(spark, d.alert_micros(F.lit(t))) for t in ("2026-05-14T00:00:00Z", "2026-05-14T09:00:00+09:00", "2026-05-14 00:00:00")]
            assert got == [1778716800000000] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("p, level", [(0.81, "Critical"), (0.8, "Critical"), (0.72, "High"), (0.65, "High"), (0.51, "Medium"), (0.49, "Low")])
def test_risk_levels(spark, p, level):
    assert value(spark, d.risk_level(F.lit(p))) == level


@pytest.mark.parametrize("loss, given, sent, churned, status, action, success, cost, saved, roi", [
    (1000.0, None, True, False, "completed", 150.0, True, 150.0, 1000.0, 850 / 150),
    (500.0, None, True, True, "completed", 80.0, False, 80.0, 0.0, -1.0),
    (1200.0, True, True, None, None, 0.0, True, 0.0, 1200.0, None),
    (100.0, None, True, None, "done", None, False, 5.0, 0.0, -1.0),
])
def test_retention_value(spark, loss, given, sent, churned, status, action, success, cost, saved, roi):
    ok = d.retention_success(F.lit(given).cast("boolean"), F.lit(sent), F.lit(churned).cast("boolean"), F.lit(status).cast("string"))
    v = d.retention_value(F.lit(loss), ok, F.lit(action).cast("double"), F.lit(2.0), F.lit(3.0), F.lit(None).cast("double"))
    row = spark.range(1).select(ok.alias("ok"), *[c.alias(n) for n, c in v.items()]).first()
    assert row["ok"] is success and row["retention_cost"] == cost and row["saved_revenue"] == saved
    assert row["roi"] is None if roi is None else row["roi"] == pytest.approx(roi)


def test_account_row(spark):
    raw = spark.createDataFrame(
        [("p", 4, 70.0, 30.0, 100.0, 25.0, 2, 1, 1, "VIP", "Business", "Yes"),
         ("q", 0, None, None, None, None, 0, None, None, None, None, " no "),
         ("r", 4, 0.0, 0.0, 0.0, None, 9, 1, 1, "VIP", None, "maybe")],
        "PID string, Total_SUBs int, AvgMobileRevenue double, AvgFIXRevenue double, TotalRevenue double, ARPU double, "
        "Active_subscribers int, Not_Active_subscribers int, Suspended_subscribers int, CRM_PID_Value_Segment string, "
        "EffectiveSegment string, CHURN string")
    rows = {r["PID"]: r for r in crm.labelled_accounts(raw, keep=["PID"]).collect()}
    assert set(rows) == {"p", "q"}
    p = rows["p"]
    assert (p["Suspended_Ratio"], p["Revenue_per_Active_Sub"], p["Inactive_x_Revenue"], p["y"]) == (0.25, 50.0, 25.0, 1)
    assert p["Revenue_Balance"] == pytest.approx(30 / (70 + 1e-5))
    q = rows["q"]
    assert q["ARPU"] is None and q["Active_Ratio"] == 0.0 and q["EffectiveSegment"] == "Unknown" and q["y"] == 0
    scored = crm.account_features(raw, keep=["PID"]).where("PID = 'r'").first()
    assert scored["ARPU"] == 0.0 and scored["Active_Ratio"] == 1.0 and scored["y"] is None


SCORES = [(1, .82), (1, .48), (1, .41), (0, .39), (0, .36), (1, .34), (0, .28), (0, .21), (0, .18), (0, .09)]


def test_threshold_choice(spark):
    rows = spark.createDataFrame(SCORES, "y int, s double")
    sweep = ranking.threshold_sweep(rows, "y", "s", 30, 50, 100)
    best = ranking.best_threshold(sweep.where(F.round(F.col("threshold") * 100).isin(30, 35, 50))).first()
    assert (best["threshold"], best["recall"]) == (pytest.approx(0.3), 1.0) and best["f1"] == pytest.approx(0.8)
    none_passes = ranking.best_threshold(sweep, min_recall=1.5).first()
    assert none_passes["f1"] == ranking.best_threshold(sweep).first()["f1"]


def test_confusion_and_degenerate_scores(spark):
    rows = spark.createDataFrame([(1, .8), (1, .4), (0, .7), (0, .1)], "y int, s double")
    m = ranking.metrics_at(rows, "y", "s", 0.5).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 1, 1, 1)
    assert ranking.roc_auc(rows.where("y = 1"), "y", "s").first()["roc_auc"] is None
    constant = rows.withColumn("s", F.lit(0.5))
    assert ranking.roc_auc(constant, "y", "s").first()["roc_auc"] == 0.5
    assert ranking.best_f1(constant, "y", "s").first()["threshold"] == 0.5


def test_score_blend(spark):
    rows = spark.createDataFrame([(.2, .1), (.4, .2), (.6, .3)], "a double, b double")
    a, b = min_max(F.col("a"), F.lit(.2), F.lit(.6)), min_max(F.col("b"), F.lit(.1), F.lit(.3))
    got = [r[0] for r in rows.select(weighted_average([a, b], [1, 1])).collect()]
    assert got == pytest.approx([0, .5, 1])
    assert value(spark, min_max(F.lit(3.0), F.lit(3.0), F.lit(3.0))) == 0.0
    with pytest.raises(ValueError):
        weighted_average([a, b], [1, -1])


@pytest.mark.parametrize("doc, override, want", [
    ('{"selected_threshold": 0.42}', None, 0.42), ('{"best": {"threshold": "0.3"}}', None, 0.3), ("[1]", None, 0.5), (None, None, 0.5),
    ('{"selected_threshold": null, "best": {"threshold": 0.3}}', None, 0.5), ('{"best_validation": {"threshold": 0.6}}', None, 0.6),
    ('{"selected_threshold": 0.42}', "0.9", 0.9), ('{"selected_threshold": 0.42}', "", 0.42), ('{"selected_threshold": 0.42}', "7", 0.5),
    ('{"selected_threshold": 1.7}', None, 0.5),
])
def test_policy_threshold(spark, doc, override, want):
    got = value(spark, payloads.policy_threshold(F.lit(doc).cast("string"), F.lit(override).cast("string")))
    assert got == pytest.approx(want)


def test_number_and_text_edges(spark):
    assert value(spark, numeric.to_double(F.lit(" 1.5 "))) == 1.5
    for junk in ("", "  ", "x", "NaN", "Infinity", None):
        assert value(spark, numeric.to_double(F.lit(junk).cast("string"))) is None
    assert value(spark, numeric.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert value(spark, numeric.ratio(F.lit(1.0), F.lit(0.0))) == 0.0
    assert value(spark, text.localised_number(F.lit("1 234,5"))) == 1234.5
    assert value(spark, text.localised_number(F.lit("-"))) == 0.0
    assert value(spark, text.day_from_int(F.lit(20170230))) is None
    assert str(value(spark, text.day_from_int(F.lit(20170331)))) == "2017-03-31"
    assert value(spark, text.zip_text(F.lit(2.5))) == "2"
    assert value(spark, text.plain_name(F.lit(" Kŭrdzhali (stolitsa)  Ж"))) == "kurdzhali stolitsa"
    assert value(spark, text.postal_code(F.lit("1000.0"))) == "1000"
