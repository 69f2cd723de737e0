"""Plans that turn scores into decisions, alerts and retention value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import decisions as d
from ebbtide.functions.numeric import ratio, rounded, sigmoid
from ebbtide.operators import alerts, payloads, scoring
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.sources.feeds import Feeds


def risk_sql(p: str) -> str:
    return f"CASE WHEN {p} >= 0.8e0 THEN 'Critical' WHEN {p} >= 0.65e0 THEN 'High' WHEN {p} >= 0.5e0 THEN 'Medium' ELSE 'Low' END"


@query(statement("scores", f"""SELECT row_id, ROUND(p, 6) AS churn_probability, p >= 0.5e0 AS churn_prediction, {risk_sql('p')} AS risk_level,
  CASE WHEN p >= 0.5e0 THEN CAST(row_id % 300 AS DOUBLE) ELSE 0e0 END AS expected_revenue_loss,
  s1 >= 0.5e0 AS table_flag, s3 IS NOT NULL AS sequence_available, COALESCE(s3 >= 0.5e0, FALSE) AS sequence_flag
FROM (SELECT *, CASE WHEN s3 IS NOT NULL AND row_id % 12 >= 7 THEN s1 * 0.3e0 + s3 * 0.3e0 + s2 * 0.4e0
  WHEN s3 IS NOT NULL THEN s1 * 0.7e0 + s3 * 0.2e0 + s2 * 0.1e0 WHEN row_id % 12 >= 7 THEN s1 * 0.4e0 + s2 * 0.6e0
  ELSE s1 * 0.8e0 + s2 * 0.2e0 END AS p FROM scores)"""))
def ensemble_decision(feeds: Feeds) -> DataFrame:
    """Availability-dependent blend, prediction, risk level, expected loss, single-model flags."""
    n = (F.col("row_id") % 12).cast("int")
    history = F.when(n > 0, F.array_repeat(F.lit(1.0), n))
    rows = feeds.scores().withColumn("p", d.ensemble_probability(F.col("s1"), F.col("s3"), F.col("s2"), history))
    predicted = F.col("p") >= 0.5
    return rounded(rows.select(
        "row_id", F.col("p").alias("churn_probability"), predicted.alias("churn_prediction"), d.risk_level("p").alias("risk_level"),
        d.expected_loss(predicted, (F.col("row_id") % 300).cast("double")).alias("expected_revenue_loss"),
        (F.col("s1") >= 0.5).alias("table_flag"), F.col("s3").isNotNull().alias("sequence_available"),
        F.coalesce(F.col("s3") >= 0.5, F.lit(False)).alias("sequence_flag")))


_ALERT_STEPS = {
    "e": f"SELECT *, {risk_sql('churn_probability')} AS risk_level FROM alert_events",
    "w": """SELECT *, LAG(churn_probability) OVER c AS pp, LAG(risk_level) OVER c AS pr, LAG(event_time) OVER c AS pt
FROM e WINDOW c AS (PARTITION BY customer_id ORDER BY event_time, event_id)""",
    "f": """SELECT *, CASE WHEN pr IN ('High', 'Critical') THEN pt END AS last_alert,
  COALESCE(churn_probability - pp >= 0.2e0, FALSE) AS spiked,
  CASE risk_level WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 ELSE 0 END AS rk,
  CASE pr WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 0 END AS prk FROM w""",
    "g": f"""SELECT *, CASE WHEN risk_level = 'Low' THEN '{d.REASON_LOW}' WHEN risk_level = 'Medium' THEN '{d.REASON_MEDIUM}'
  WHEN spiked OR (prk IS NOT NULL AND rk > prk AND rk >= 2) THEN NULL
  WHEN COALESCE(LOWER(TRIM(response_status)) = 'completed', FALSE) AND last_alert IS NOT NULL THEN '{d.REASON_RESOLVED}'
  WHEN last_alert IS NULL THEN NULL
  WHEN risk_level = 'Critical' THEN CASE WHEN event_time - last_alert >= INTERVAL 24 HOUR THEN NULL ELSE '{d.REASON_CRITICAL}' END
  WHEN event_time - last_alert >= INTERVAL 72 HOUR THEN NULL ELSE '{d.REASON_HIGH}' END AS reason FROM f""",
}


def risk_events(feeds: Feeds) -> DataFrame:
    return feeds.alert_events().withColumn("risk_level", d.risk_level("churn_probability"))


def alert_requests(feeds: Feeds) -> DataFrame:
    """Events with what is known from the event before; alert times as text in several zones."""
    events = alerts.with_previous(risk_events(feeds), "customer_id", ["event_time", "event_id"], F.to_date("event_time"),
                                  ["churn_probability", "risk_level", "event_time"])
    before = F.col("previous.event_time")
    text = (F.when(F.col("event_id") % 3 == 0, F.concat(before.cast("string"), F.lit("Z")))
            .when(F.col("event_id") % 3 == 1, F.concat((before + F.expr("INTERVAL 9 HOURS")).cast("string"), F.lit("+09:00")))
            .otherwise(before.cast("string")))
    return events.select(
        "event_id", "customer_id", "event_time", "churn_probability", "risk_level", "response_status", "is_vip_customer",
        "is_high_revenue_customer", F.col("previous.churn_probability").alias("previous_churn_probability"),
        F.col("previous.risk_level").alias("previous_risk_level"),
        F.when(F.col("previous.risk_level").isin("High", "Critical"), text).alias("last_alert_time"))


def alert_decisions(feeds: Feeds) -> DataFrame:
    return alerts.decide(alert_requests(feeds), d.wall_micros(F.col("event_time")), d.alert_micros("last_alert_time"))


@query(statement("alert_events", """SELECT event_id, customer_id, risk_level, reason IS NULL AS alert_required,
  CASE WHEN reason IS NOT NULL THEN 'None' WHEN is_vip_customer OR is_high_revenue_customer THEN 'Slack,Gmail' ELSE 'Slack' END AS alert_channel,
  reason AS suppress_reason, TRUE AS log_required, spiked, rk > COALESCE(prk, 99) AND rk >= 2 AS escalated FROM g""", **_ALERT_STEPS))
def alert_fatigue(feeds: Feeds) -> DataFrame:
    """The alert policy over all events with the state of the event before."""
    level, before = F.col("risk_level"), F.col("previous_risk_level")
    return alert_decisions(feeds).select(
        "event_id", "customer_id", "risk_level", "alert_required", "alert_channel", "suppress_reason", "log_required",
        d.spiked(F.col("churn_probability"), F.col("previous_churn_probability")).alias("spiked"),
        d.escalated(level, before).alias("escalated"))


@query(statement("members alert_events", """SELECT m.entity_id AS customer_id, h.event_time AS last_event_time,
  ROUND(h.churn_probability, 6) AS last_churn_probability, h.risk_level AS last_risk_level, h.event_id IS NOT NULL AS has_history
FROM members m LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY event_time DESC, event_id DESC) AS rn
  FROM e WHERE risk_level IN ('High', 'Critical')) h ON h.customer_id = m.entity_id AND h.rn = 1""", e=_ALERT_STEPS["e"]))
def alert_history_lookup(feeds: Feeds) -> DataFrame:
    """Newest sent alert of each customer, null where there was none."""
    sent = risk_events(feeds).where(F.col("risk_level").isin("High", "Critical"))
    people = feeds.table("customer").select(F.col("c_custkey").alias("customer_id"))
    wide = alerts.with_history(people, sent, "customer_id", ["event_time", "event_id"], ["event_time", "churn_probability", "risk_level"])
    return rounded(wide.withColumn("has_history", F.col("last_event_time").isNotNull()))


@query(statement("retention_actions", """SELECT customer_id, ok AS retention_success, ROUND(cost, 6) AS retention_cost,
  ROUND(CASE WHEN ok THEN expected_revenue_loss ELSE 0 END, 6) AS saved_revenue,
  ROUND(CASE WHEN ok THEN expected_revenue_loss ELSE 0 END - cost, 6) AS net_benefit,
  ROUND((CASE WHEN ok THEN expected_revenue_loss ELSE 0 END - cost) / NULLIF(cost, 0), 8) AS roi
FROM (SELECT *, COALESCE(action_cost, coupon_cost + discount_cost + consulting_cost) AS cost,
  COALESCE(retention_success, CASE WHEN actual_churn IS NULL THEN FALSE
    ELSE alert_sent AND NOT actual_churn AND COALESCE(response_status = 'completed', FALSE) END) AS ok FROM retention_actions)"""))
def retention_roi(feeds: Feeds) -> DataFrame:
    """Cost, saved revenue, net benefit and return of each retention action."""
    rows = feeds.retention_actions()
    success = d.retention_success(F.col("retention_success"), F.col("alert_sent"), F.col("actual_churn"), F.col("response_status"))
    value = d.retention_value(F.col("expected_revenue_loss"), success, F.col("action_cost"), F.col("coupon_cost"),
                              F.col("discount_cost"), F.col("consulting_cost"))
    return rounded(rows.select("customer_id", success.alias("retention_success"), *[e.alias(n) for n, e in value.items()]), money={"roi": 8})


_SCENARIOS = (("small_discount", 20000.0, 0.0), ("large_discount", 150000.0, 0.0), ("more_lines", 0.0, 1.0))


def demo_score(rows: DataFrame) -> DataFrame:
    """A fixed logistic score of ARPU and active share."""
    z = F.col("arpu") / 200000.0 - 2.0 * ratio("active_subscribers", "total_subs")
    return rows.withColumn("probability", sigmoid(z))


def _score_sql(arpu: str, active: str) -> str:
    return f"1 / (1 + EXP(-LEAST(GREATEST({arpu} / 200000 - 2 * ({active} / CAST(subs AS DOUBLE)), -20), 20)))"


@query(statement("crm_accounts", f"""SELECT "PID", "EffectiveSegment", scenario, ROUND(b, 6) AS before_probability, ROUND(a, 6) AS after_probability,
  ROUND(a - b, 6) AS delta, a - b < 0 AS success, ROUND(CASE WHEN b >= 0.5 AND a < 0.5 THEN arpu2 ELSE 0 END, 6) AS expected_saved_revenue
FROM (SELECT *, {_score_sql('arpu', 'active')} AS b, {_score_sql('arpu2', 'active2')} AS a FROM (
  SELECT "PID", "EffectiveSegment", "Total_SUBs" AS subs, "Active_subscribers" AS active, x.scenario,
    "TotalRevenue" / "Total_SUBs" AS arpu, GREATEST(0, "TotalRevenue" / "Total_SUBs" - x.discount) AS arpu2,
    "Active_subscribers" + x.boost AS active2
  FROM crm_accounts CROSS JOIN (VALUES {', '.join(f"('{n}', {a}e0, {b}e0)" for n, a, b in _SCENARIOS)}) x(scenario, discount, boost)))"""))
def what_if(feeds: Feeds) -> DataFrame:
    """Every account line rescored under three offers."""
    rows = feeds.crm_accounts().select(
        "PID", "EffectiveSegment", F.col("Total_SUBs").alias("total_subs"),
        F.col("Active_subscribers").cast("double").alias("active_subscribers"), F.col("TotalRevenue").alias("total_revenue"),
        (F.col("TotalRevenue") / F.col("Total_SUBs")).alias("arpu"))
    return rounded(alerts.what_if(rows, _SCENARIOS, demo_score, ["PID", "EffectiveSegment"]))


@query(statement("alert_events", """SELECT event_id, action, ROUND(p, 6) AS expected_probability, cost AS action_cost FROM (
  SELECT event_id, action, GREATEST(0.01e0, churn_probability - less) AS p, cost,
    ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY GREATEST(0.01e0, churn_probability - less), pos) AS rn
  FROM alert_events CROSS JOIN (VALUES (0, '10% discount', 0.12e0, 30000e0), (1, 'direct account call', 0.09e0, 10000e0),
    (2, 'bundle retention offer', 0.16e0, 45000e0)) o(pos, action, less, cost)) WHERE rn = 1"""))
def best_action(feeds: Feeds) -> DataFrame:
    """The offer with the lowest expected probability."""
    best = feeds.alert_events().select("event_id", d.best_offer(d.offer_scenarios(F.col("churn_probability"))).alias("b"))
    return rounded(best.select("event_id", "b.action", "b.expected_probability", "b.action_cost"))


@query("""SELECT o_orderkey, p >= 0.7e0 OR o_totalprice >= 100000 AS approval_required,
  CASE WHEN NOT (p >= 0.7e0 OR o_totalprice >= 100000) THEN 'not_required' WHEN o_orderstatus = 'O' THEN 'approved' ELSE 'pending' END AS approval_status
FROM (SELECT *, (o_orderkey * 37 % 1000) / 1000e0 AS p FROM orders)""")
def approval_gate(feeds: Feeds) -> DataFrame:
    """Actions that need approval for their risk or their cost."""
    p = (F.col("o_orderkey") * 37 % 1000) / 1000.0
    needed = d.needs_approval(p, F.col("o_totalprice"))
    status = F.when(~needed, "not_required").when(F.col("o_orderstatus") == "O", "approved").otherwise("pending")
    return feeds.table("orders").select("o_orderkey", needed.alias("approval_required"), status.alias("approval_status"))


@query(statement("alert_events", f"""SELECT event_id, CASE WHEN risk_level = 'Critical' THEN '{d.URGENT_CHANNEL}' ELSE '{d.NORMAL_CHANNEL}' END AS slack_channel,
  '[' || risk_level || '] customer ' || customer_id || ' at ' || PRINTF('%.1f%%', churn_probability * 100) AS message,
  CONTAINS(CASE WHEN is_vip_customer OR is_high_revenue_customer THEN 'Slack,Gmail' ELSE 'Slack' END, 'Gmail') AS send_mail
FROM g WHERE reason IS NULL""", **_ALERT_STEPS))
def notification_rows(feeds: Feeds) -> DataFrame:
    """Channel and text of every alert that is due."""
    due = alert_decisions(feeds).where("alert_required")
    text = F.concat(F.lit("["), F.col("risk_level"), F.lit("] customer "), F.col("customer_id").cast("string"), F.lit(" at "),
                    d.percent_text(F.col("churn_probability")))
    return due.select("event_id", d.chat_channel(F.col("risk_level")).alias("slack_channel"), text.alias("message"),
                      F.contains("alert_channel", F.lit("Gmail")).alias("send_mail"))


@query(statement("alert_events churn_labels", """SELECT g.event_id, g.customer_id, ROUND(g.churn_probability, 6) AS churn_probability,
  g.reason IS NULL AS action_sent, CASE WHEN g.churn_probability >= 0.7e0 THEN 'pending' ELSE 'not_required' END AS approval_status,
  g.customer_id || '-' || g.event_id AS feedback_key, 'logged_for_feedback_loop' AS monitoring_status, l.is_churn
FROM g LEFT JOIN churn_labels l ON l.entity_id = g.customer_id""", **_ALERT_STEPS))
def feedback_rows(feeds: Feeds) -> DataFrame:
    """Decision log rows with the label that became known, keyed for retraining."""
    log = alert_decisions(feeds).select(
        "event_id", "customer_id", "churn_probability", F.col("alert_required").alias("action_sent"),
        F.when(F.col("churn_probability") >= d.APPROVAL_PROBABILITY, "pending").otherwise("not_required").alias("approval_status"),
        F.concat_ws("-", F.col("customer_id").cast("string"), F.col("event_id").cast("string")).alias("feedback_key"),
        F.lit("logged_for_feedback_loop").alias("monitoring_status"))
    return rounded(alerts.feedback(log, feeds.churn_labels().withColumnRenamed("entity_id", "customer_id"), "customer_id"))


# ---- requests to answers ------------------------------------------------------------

def request_batches(feeds: Feeds) -> DataFrame:
    """Account lines as batches of request texts; one in seven is not readable, one in three has a history."""
    n = F.col("PID").cast("bigint")
    history = F.when(n % 3 == 0, F.transform(F.sequence(F.lit(1), (n % 10 + 1).cast("int")), lambda i: i.cast("double")))
    body = F.when(n % 7 == 0, F.lit("not a request")).otherwise(F.to_json(F.struct(
        F.col("PID").alias("customer_id"), "Total_SUBs", "TotalRevenue", "ARPU", "AvgMobileRevenue", "Active_subscribers",
        "Not_Active_subscribers", "Suspended_subscribers", history.alias("history_arpu"))))
    lines = feeds.crm_accounts().select(F.floor(n / 20).alias("batch_id"), F.struct("PID", "EffectiveSegment", body.alias("body")).alias("r"))
    # a batch is the lines of twenty neighbouring accounts, so the list is bounded
    return lines.groupBy("batch_id").agg(F.sort_array(F.collect_list("r")).alias("r")).select("batch_id", F.col("r.body").alias("bodies"))


def rule_scores(rows: DataFrame) -> DataFrame:
    """Three scores by rule, standing in for fitted models; accounts of one or two lines have no sequence score."""
    table = (-1.4 * F.col("Active_Ratio") + 0.9 * F.col("Inactive_Ratio") + 0.7 * F.col("Suspended_Ratio")
             + 0.25 * F.col("Mobile_Revenue_Ratio") + 0.00001 * F.col("Revenue_per_Active_Sub"))
    return rows.withColumns({
        "table_probability": sigmoid(table),
        "sequence_probability": F.when(F.col("Total_SUBs") > 2, sigmoid(F.col("Inactive_Ratio"))),
        "trend_probability": sigmoid(0.5 * F.col("Mobile_Revenue_Ratio") - 0.2)})


def _share_sql(top: str, bottom: str) -> str:
    return f"LEAST(GREATEST(COALESCE({top} / NULLIF({bottom}, 0), 0), 0), 1)"


@query(statement("crm_accounts", f"""SELECT batch_id, total_customers, alert_required_count, position, customer_id, ROUND(t, 6) AS table_probability,
  ROUND(q, 6) AS sequence_probability, ROUND(p, 6) AS churn_probability, 0.42e0 AS prediction_threshold, p >= 0.42e0 AS churn_prediction,
  {risk_sql('p')} AS risk_level, CASE WHEN p >= 0.42e0 THEN ROUND(arpu, 6) ELSE 0e0 END AS expected_revenue_loss,
  CASE WHEN p >= 0.42e0 THEN '{scoring.ALERT_CHANNELS}' ELSE 'None' END AS alert_channel,
  CASE WHEN p >= 0.42e0 THEN '' ELSE '{scoring.QUIET_REASON}' END AS suppress_reason, DATE '2024-02-01' AS log_day
FROM (SELECT *, COUNT(*) OVER (PARTITION BY batch_id) AS total_customers,
  COUNT(*) FILTER (p >= 0.42e0) OVER (PARTITION BY batch_id) AS alert_required_count FROM b)""",
                 a="""SELECT n // 20 AS batch_id, CAST(ROW_NUMBER() OVER (PARTITION BY n // 20 ORDER BY "PID", "EffectiveSegment") - 1 AS INT) AS position, n,
  CASE WHEN bad THEN '' ELSE "PID" END AS customer_id, CASE WHEN bad THEN 0 ELSE CAST("Total_SUBs" AS DOUBLE) END AS subs,
  CASE WHEN bad THEN 0 ELSE "TotalRevenue" END AS revenue, CASE WHEN bad THEN 0 ELSE COALESCE("ARPU", "TotalRevenue" / "Total_SUBs") END AS arpu,
  CASE WHEN bad THEN 0 ELSE "AvgMobileRevenue" END AS mobile, CASE WHEN bad THEN 0 ELSE CAST("Active_subscribers" AS DOUBLE) END AS active,
  CASE WHEN bad THEN 0 ELSE COALESCE(CAST("Not_Active_subscribers" AS DOUBLE), 0) END AS inactive,
  CASE WHEN bad THEN 0 ELSE COALESCE(CAST("Suspended_subscribers" AS DOUBLE), 0) END AS suspended,
  NOT bad AND n % 3 = 0 AND n % 10 >= 6 AS history
FROM (SELECT *, CAST("PID" AS BIGINT) AS n, CAST("PID" AS BIGINT) % 7 = 0 AS bad FROM crm_accounts)""",
                 s=f"""SELECT *, 1 / (1 + EXP(-(-1.4e0 * {_share_sql('active', 'subs')} + 0.9e0 * {_share_sql('inactive', 'subs')}
    + 0.7e0 * {_share_sql('suspended', 'subs')} + 0.25e0 * {_share_sql('mobile', 'revenue')} + 0.00001e0 * COALESCE(revenue / NULLIF(active, 0), 0)))) AS t,
  CASE WHEN subs > 2 THEN 1 / (1 + EXP(-{_share_sql('inactive', 'subs')})) END AS q,
  1 / (1 + EXP(-(0.5e0 * {_share_sql('mobile', 'revenue')} - 0.2e0))) AS r FROM a""",
                 b="""SELECT *, CASE WHEN q IS NOT NULL AND history THEN t * 0.3e0 + q * 0.3e0 + r * 0.4e0
  WHEN q IS NOT NULL THEN t * 0.7e0 + q * 0.2e0 + r * 0.1e0 WHEN history THEN t * 0.4e0 + r * 0.6e0 ELSE t * 0.8e0 + r * 0.2e0 END AS p FROM s"""))
def batch_scoring(feeds: Feeds) -> DataFrame:
    """Batches of request texts to answers with suppress reasons, closed, and opened again as log rows."""
    threshold = payloads.policy_threshold(F.lit('{"selected_threshold": 0.42}'))
    closed = scoring.answered_batches(request_batches(feeds), "batch_id", "bodies", rule_scores, threshold)
    counted = closed.select("batch_id", "total_customers", "alert_required_count")
    log = scoring.log_rows(closed, "batch_id", F.lit("2024-02-01").cast("date"))
    return rounded(log.join(counted, "batch_id").select(
        "batch_id", "total_customers", "alert_required_count", "position", "customer_id", "table_probability", "sequence_probability",
        "churn_probability", "prediction_threshold", "churn_prediction", "risk_level", "expected_revenue_loss", "alert_channel",
        "suppress_reason", "log_day"))
