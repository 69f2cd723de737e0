"""SQL forms of the churn inputs, used to check each plan in a second engine."""

from __future__ import annotations

INPUTS: dict[str, str] = {
    "usage_logs": """SELECT user_id AS entity_id, CAST(ts AS DATE) AS log_date,
  CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS num_25,
  CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS num_50,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS num_75,
  CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS num_985,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS num_100,
  COUNT(DISTINCT props) AS num_unq, SUM(value) AS total_secs
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "transactions": """SELECT o_orderkey AS txn_id, o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS txn_date,
  CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS payment_method_id,
  CAST(30 * (1 + o_orderkey % 3) AS INT) AS plan_days,
  o_totalprice * (1e0 + CAST(o_orderkey % 5 AS DOUBLE) * 0.05e0) AS list_price, o_totalprice AS paid,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_auto_renew,
  CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_cancel
FROM orders""",
    "churn_labels": """SELECT o_custkey AS entity_id,
  CASE WHEN SUM(CASE WHEN o_orderdate > DATE '2000-12-31' AND o_orderdate <= DATE '2001-03-31'
                     THEN 1 ELSE 0 END) = 0 THEN 1 ELSE 0 END AS is_churn
FROM orders GROUP BY o_custkey HAVING MIN(o_orderdate) <= DATE '2000-12-31'""",
    "members": """SELECT c_custkey AS entity_id, n_name AS city, r_name AS region, c_mktsegment AS gender,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(FLOOR(c_acctbal / 80.0) AS INT) END AS bd
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "crm_accounts": """SELECT CAST(o.o_custkey AS VARCHAR) AS "PID", n_name AS "KA_name",
  CASE WHEN o.o_custkey % 17 = 0 THEN NULL ELSE CAST(1000 + (o.o_custkey * 37) % 9000 AS INT) END AS "Billing_ZIP",
  CASE WHEN o.o_custkey % 23 = 0 THEN NULL ELSE c_mktsegment END AS "CRM_PID_Value_Segment",
  o_orderpriority AS "EffectiveSegment",
  CAST(COUNT(*) AS INT) AS "Total_SUBs",
  CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS INT) AS "Active_subscribers",
  CAST(NULLIF(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 0) AS INT) AS "Not_Active_subscribers",
  CAST(NULLIF(SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END), 0) AS INT) AS "Suspended_subscribers",
  SUM(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0e0 END) AS "AvgMobileRevenue",
  SUM(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice ELSE 0e0 END) AS "AvgFIXRevenue",
  SUM(o_totalprice) AS "TotalRevenue",
  CASE WHEN o.o_custkey % 5 = 0 THEN NULL ELSE SUM(o_totalprice) / COUNT(*) END AS "ARPU",
  CASE WHEN o.o_custkey % 31 = 0 THEN NULL WHEN MAX(l.is_churn) = 1 THEN 'Yes' ELSE ' no' END AS "CHURN"
FROM orders o JOIN customer ON o.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN churn_labels l ON l.entity_id = o.o_custkey
WHERE o_orderdate <= DATE '2000-12-31'
GROUP BY o.o_custkey, n_name, c_mktsegment, o_orderpriority""",
    "scores": """SELECT l.doc_id AS row_id, 1 - l.quality AS y,
  (d.n_chars % 997) / CAST(997 AS DOUBLE) AS s1, ((l.doc_id * 37) % 101) / CAST(101 AS DOUBLE) AS s2,
  CASE WHEN l.doc_id % 4 = 0 THEN NULL ELSE ((l.doc_id * 53) % 89) / CAST(89 AS DOUBLE) END AS s3,
  CASE WHEN l.doc_id % 5 = 0 THEN 'test' WHEN l.doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "alert_events": """SELECT event_id, user_id AS customer_id, ts AS event_time,
  CASE WHEN value >= 150 THEN 1e0 ELSE value / 150e0 END AS churn_probability,
  CASE WHEN event_id % 6 = 0 THEN ' Completed ' WHEN event_id % 6 = 1 THEN 'open' ELSE NULL END AS response_status,
  user_id % 7 = 0 AS is_vip_customer, user_id % 11 = 0 AS is_high_revenue_customer
FROM events""",
    "retention_actions": """SELECT CAST(o_orderkey AS VARCHAR) AS customer_id,
  o_totalprice AS expected_revenue_loss, o_orderkey % 2 = 0 AS alert_sent,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST((o_orderkey % 40) * 10 AS DOUBLE) ELSE NULL END AS action_cost,
  CAST((o_orderkey % 7) * 10 AS DOUBLE) AS coupon_cost, CAST((o_orderkey % 5) * 20 AS DOUBLE) AS discount_cost,
  CAST(0 AS DOUBLE) AS consulting_cost,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'completed'
       WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'open' END AS response_status,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS actual_churn,
  CASE WHEN o_orderkey % 13 = 0 THEN TRUE ELSE NULL END AS retention_success
FROM orders""",
}

_NEEDS = {"crm_accounts": ["churn_labels"]}


def statement(inputs: str, body: str, **steps: str) -> str:
    """A statement over named inputs; ``steps`` add further named subqueries in order."""
    names: list[str] = []
    for name in inputs.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in names:
                names.append(needed)
    parts = [f"{n} AS (\n{INPUTS[n]}\n)" for n in names]
    parts += [f"{n} AS (\n{sql}\n)" for n, sql in steps.items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + body
