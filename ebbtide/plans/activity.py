"""Plans over usage and billing logs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import clip, flag, or_zero, ratio, ratio_or_null, rounded
from ebbtide.functions.ordering import exact_quantiles
from ebbtide.functions.text import day_from_int
from ebbtide.operators import customer_month as cm
from ebbtide.operators import windows_agg as wa
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.sources.feeds import BILLING_CUTOFF, USAGE_CUTOFF, Feeds

USAGE_DAYS = (3, 7, 14, 30)
USAGE_PAIRS = ((7, 14), (7, 30))
BILLING_DAYS = (30, 60, 90)
BILLING_PAIRS = ((30, 90),)

PLAYS_SQL = "num_25 + num_50 + num_75 + num_985 + num_100"
USAGE_SQL = {
    "log_days": "1", "total_secs": "total_secs", "total_plays": PLAYS_SQL, "complete_plays": "num_100",
    "short_plays": "num_25", "num_unq": "num_unq",
}
BILLING_SQL = {
    "txn_count": "1", "plan_days": "plan_days", "plan_price": "list_price", "paid_amount": "paid",
    "auto_renew": "is_auto_renew", "cancel": "is_cancel",
}
FLOATS = {"total_secs", "plan_price", "paid_amount"}


def _sums(measures: dict[str, str], date: str, cutoff: str, days: tuple[int, ...]) -> str:
    parts = []
    for name, value in measures.items():
        for suffix, cond in [("all", "TRUE")] + [
            (f"{d}d", f"{date} >= CAST(DATE '{cutoff}' - INTERVAL {d - 1} DAY AS DATE)") for d in days
        ]:
            total = f"COALESCE(SUM(CASE WHEN {cond} THEN {value} END), 0)"
            kind = "DOUBLE" if name in FLOATS else "BIGINT"
            parts.append(f"CAST({total} AS {kind}) AS {name}_{suffix}")
    return ",\n  ".join(parts)


USAGE_STEP = (
    f"SELECT entity_id,\n  {_sums(USAGE_SQL, 'log_date', USAGE_CUTOFF, USAGE_DAYS)},\n"
    f"  MIN(log_date) AS first_log_date, MAX(log_date) AS last_log_date\n"
    f"FROM usage_logs WHERE log_date <= DATE '{USAGE_CUTOFF}' GROUP BY entity_id"
)
BILLING_STEP = (
    f"SELECT entity_id,\n  {_sums(BILLING_SQL, 'txn_date', BILLING_CUTOFF, BILLING_DAYS)},\n"
    f"  MIN(txn_date) AS first_txn_date, MAX(txn_date) AS last_txn_date,\n"
    f"  MAX(txn_date + plan_days) AS max_expire_date\n"
    f"FROM transactions WHERE txn_date <= DATE '{BILLING_CUTOFF}' GROUP BY entity_id"
)
LATEST_STEP = (
    "SELECT entity_id, txn_id AS latest_txn_id, "
    + ", ".join(f"{f} AS latest_{f}" for f in wa.LATEST_FIELDS)
    + " FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY txn_date DESC, txn_id DESC) AS rn"
    + f" FROM transactions WHERE txn_date <= DATE '{BILLING_CUTOFF}') WHERE rn = 1"
)


def _round_floats(names: list[str], floats: set[str]) -> str:
    return ", ".join(f"ROUND({n}, 6) AS {n}" if n in floats else n for n in names)


def _sum_names(measures: dict[str, str], days: tuple[int, ...]) -> list[str]:
    return [f"{m}_{s}" for m in measures for s in ["all", *[f"{d}d" for d in days]]]


def _float_names(measures: dict[str, str], days: tuple[int, ...]) -> set[str]:
    return {n for n in _sum_names(measures, days) if n.rsplit("_", 1)[0] in FLOATS}


@query(statement("usage_logs", "SELECT entity_id, "
                 + _round_floats(_sum_names(USAGE_SQL, USAGE_DAYS), _float_names(USAGE_SQL, USAGE_DAYS))
                 + ", first_log_date, last_log_date FROM u", u=USAGE_STEP))
def windowed_usage(feeds: Feeds) -> DataFrame:
    """Sums over 3, 7, 14, 30 days and all time with first and last day."""
    return rounded(wa.usage_windows(feeds.usage_logs(), USAGE_CUTOFF, USAGE_DAYS))


@query(statement("transactions", "SELECT entity_id, "
                 + _round_floats(_sum_names(BILLING_SQL, BILLING_DAYS), _float_names(BILLING_SQL, BILLING_DAYS))
                 + ", first_txn_date, last_txn_date, max_expire_date FROM b", b=BILLING_STEP))
def windowed_billing(feeds: Feeds) -> DataFrame:
    """Sums over 30, 60, 90 days and all time of the billing log."""
    return rounded(wa.billing_windows(feeds.transactions(), BILLING_CUTOFF, BILLING_DAYS))


@query(statement("transactions", "SELECT * REPLACE (ROUND(latest_list_price, 6) AS latest_list_price) FROM t",
                 t=LATEST_STEP))
def latest_txn(feeds: Feeds) -> DataFrame:
    """Newest transaction per entity with a tie-break on the id."""
    return rounded(wa.latest_transaction(feeds.transactions(), BILLING_CUTOFF))


@query(statement("usage_logs churn_labels",
                 "SELECT entity_id, log_date, ROUND(total_secs, 6) AS total_secs, num_unq FROM usage_logs u "
                 "WHERE EXISTS (SELECT 1 FROM churn_labels l WHERE l.entity_id = u.entity_id)"))
def semi_labeled(feeds: Feeds) -> DataFrame:
    """Log rows of labelled entities only."""
    logs = feeds.usage_logs().select("entity_id", "log_date", "total_secs", "num_unq")
    return rounded(logs.join(feeds.churn_labels(), "entity_id", "left_semi"))


@query(statement("members", "SELECT entity_id, city, region, COALESCE(gender, 'unknown') AS gender, "
                 "CASE WHEN bd BETWEEN 1 AND 100 THEN bd END AS age FROM members"))
def member_profile(feeds: Feeds) -> DataFrame:
    """Profile with impossible ages removed."""
    return cm.member_profile(feeds.members())


def _rate_sql() -> dict[str, str]:
    out = {}
    for d in USAGE_DAYS:
        out[f"daily_secs_{d}d"] = f"total_secs_{d}d / {d}e0"
        out[f"daily_plays_{d}d"] = f"total_plays_{d}d / {d}e0"
        out[f"completion_rate_{d}d"] = f"CAST(complete_plays_{d}d AS DOUBLE) / NULLIF(total_plays_{d}d, 0)"
        out[f"short_play_rate_{d}d"] = f"CAST(short_plays_{d}d AS DOUBLE) / NULLIF(total_plays_{d}d, 0)"
    for a, b in USAGE_PAIRS:
        near, far = f"(total_secs_{a}d / {a}e0)", f"(total_secs_{b}d / {b}e0)"
        out[f"usage_change_{a}_vs_{b}"] = f"{near} - {far}"
        out[f"usage_ratio_{a}_vs_{b}"] = f"{near} / NULLIF({far}, 0)"
    for d in BILLING_DAYS:
        for name, top in (("avg_paid", "paid_amount"), ("avg_plan_price", "plan_price"),
                          ("renew_rate", "auto_renew"), ("cancel_rate", "cancel")):
            out[f"{name}_{d}d"] = f"CAST({top}_{d}d AS DOUBLE) / NULLIF(txn_count_{d}d, 0)"
    for a, b in BILLING_PAIRS:
        out[f"paid_change_{a}_vs_{b}"] = (
            f"paid_amount_{a}d / NULLIF(txn_count_{a}d, 0) - paid_amount_{b}d / NULLIF(txn_count_{b}d, 0)"
        )
    return out


def _recency_sql() -> dict[str, str]:
    out = {f"days_since_{c}": f"DATE_DIFF('day', {c}, DATE '{USAGE_CUTOFF}')" for c in ("first_log_date", "last_log_date")}
    out |= {f"days_since_{c}": f"DATE_DIFF('day', {c}, DATE '{BILLING_CUTOFF}')" for c in ("first_txn_date", "last_txn_date")}
    out["days_until_expire"] = f"DATE_DIFF('day', DATE '{BILLING_CUTOFF}', max_expire_date)"
    return out


_MONTH_FLOATS = {n for n in _sum_names(USAGE_SQL, USAGE_DAYS) + _sum_names(BILLING_SQL, BILLING_DAYS)
                 if n.rsplit("_", 1)[0] in FLOATS}
_MONTH_SQL = ",\n  ".join(
    ["l.entity_id", "l.is_churn AS churn_next", f"'{BILLING_CUTOFF[:7]}' AS snapshot_month"]
    + [f"ROUND(COALESCE({n}, 0), 6) AS {n}" if n in _MONTH_FLOATS else f"COALESCE({n}, 0) AS {n}"
       for n in _sum_names(USAGE_SQL, USAGE_DAYS) + _sum_names(BILLING_SQL, BILLING_DAYS)]
    + [f"COALESCE(latest_{f}, 0) AS latest_{f}" for f in
       ("payment_method_id", "plan_days", "is_auto_renew", "is_cancel")]
    + [f"ROUND(COALESCE(latest_{f}, 0e0), 6) AS latest_{f}" for f in ("list_price", "paid")]
    + ["COALESCE(city, 'unknown') AS city", "COALESCE(region, 'unknown') AS region",
       "COALESCE(gender, 'unknown') AS gender", "COALESCE(CASE WHEN bd BETWEEN 1 AND 100 THEN bd END, 0) AS age"]
    + [f"CAST(COALESCE({e}, 0) AS INT) AS {n}" for n, e in _recency_sql().items()]
    + [f"COALESCE(CASE WHEN max_expire_date < DATE '{BILLING_CUTOFF}' THEN 1e0 ELSE 0e0 END, 0e0) AS expired_by_cutoff"]
    + [f"ROUND(COALESCE({e}, 0e0), 6) AS {n}" for n, e in _rate_sql().items()]
)


@query(statement("churn_labels usage_logs transactions members",
                 f"SELECT {_MONTH_SQL}\nFROM churn_labels l LEFT JOIN u ON u.entity_id = l.entity_id "
                 "LEFT JOIN b ON b.entity_id = l.entity_id LEFT JOIN t ON t.entity_id = l.entity_id "
                 "LEFT JOIN members m ON m.entity_id = l.entity_id",
                 u=USAGE_STEP, b=BILLING_STEP, t=LATEST_STEP))
def customer_month(feeds: Feeds) -> DataFrame:
    """The flagship table: labels with usage, billing, newest transaction and profile."""
    return rounded(cm.customer_month(
        feeds.churn_labels(), feeds.usage_logs(), feeds.transactions(), feeds.members(),
        usage_cutoff=USAGE_CUTOFF, usage_days=USAGE_DAYS, usage_pairs=USAGE_PAIRS,
        billing_cutoff=BILLING_CUTOFF, billing_days=BILLING_DAYS, billing_pairs=BILLING_PAIRS,
    ))


_ALL_RATES = _rate_sql()


@query(statement("usage_logs transactions",
                 "SELECT u.entity_id, " + ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in _ALL_RATES.items())
                 + " FROM u JOIN b ON b.entity_id = u.entity_id", u=USAGE_STEP, b=BILLING_STEP))
def window_rates(feeds: Feeds) -> DataFrame:
    """Per-window rates and changes, undefined ones left null."""
    usage = wa.usage_windows(feeds.usage_logs(), USAGE_CUTOFF, USAGE_DAYS)
    billing = wa.billing_windows(feeds.transactions(), BILLING_CUTOFF, BILLING_DAYS)
    rates = wa.usage_rate_exprs(USAGE_DAYS, USAGE_PAIRS) | wa.billing_rate_exprs(BILLING_DAYS, BILLING_PAIRS)
    return rounded(usage.join(billing, "entity_id").select("entity_id", *[e.alias(n) for n, e in rates.items()]))


@query(statement("transactions", f"""
SELECT entity_id, DATE_DIFF('day', first_txn_date, DATE '{BILLING_CUTOFF}')::INT AS days_since_first_txn_date,
  DATE_DIFF('day', last_txn_date, DATE '{BILLING_CUTOFF}')::INT AS days_since_last_txn_date,
  DATE_DIFF('day', DATE '{BILLING_CUTOFF}', max_expire_date)::INT AS days_until_expire,
  CASE WHEN max_expire_date < DATE '{BILLING_CUTOFF}' THEN 1e0 ELSE 0e0 END AS expired_by_cutoff,
  CASE WHEN entity_id % 9 = 0 THEN NULL ELSE CAST(strftime(first_txn_date, '%Y%m%d') AS INT) END AS registered,
  ROUND(COALESCE(CASE WHEN entity_id % 9 <> 0 THEN
    GREATEST(DATE_DIFF('day', first_txn_date, DATE '{BILLING_CUTOFF}'), 0) / 30e0 END, plan_days_all / 30e0), 6) AS tenure_months
FROM b""", b=BILLING_STEP))
def recency_days(feeds: Feeds) -> DataFrame:
    """Recency, expiry and tenure; integer days are parsed, missing ones fall back to plan days."""
    b = wa.billing_windows(feeds.transactions(), BILLING_CUTOFF, BILLING_DAYS)
    as_int = F.when(F.col("entity_id") % 9 != 0, F.date_format("first_txn_date", "yyyyMMdd").cast("int"))
    b = b.withColumn("registered", as_int)
    days = F.datediff(F.lit(BILLING_CUTOFF).cast("date"), day_from_int("registered"))
    tenure = F.coalesce(clip(days / 30.0, low=0.0), F.col("plan_days_all") / 30.0)
    recency = wa.recency_exprs(BILLING_CUTOFF, ["first_txn_date", "last_txn_date"], "max_expire_date")
    return rounded(b.select("entity_id", *[e.alias(n) for n, e in recency.items()], "registered",
                            tenure.alias("tenure_months")))


@query(statement("usage_logs", f"""
SELECT entity_id, log_date,
  ROUND(LEAST(GREATEST(num_25 / (num_unq + 1e-5), 0), 1), 6) AS skip_rate,
  ROUND(LEAST(GREATEST(num_100 / (num_unq + 1e-5), 0), 1), 6) AS completion_rate,
  ROUND(LEAST(GREATEST(num_unq / ({PLAYS_SQL} + 1e-5), 0), 1), 6) AS diversity_score,
  ROUND(COALESCE(LEAST(CAST(num_25 AS DOUBLE) / NULLIF(num_unq, 0), 1), 0), 6) AS skip_rate_safe,
  ROUND(COALESCE(LEAST(CAST(num_100 AS DOUBLE) / NULLIF(num_unq, 0), 1), 0), 6) AS completion_rate_safe,
  ROUND(COALESCE(LEAST(CAST(num_unq AS DOUBLE) / NULLIF({PLAYS_SQL}, 0), 1), 0), 6) AS diversity_score_safe
FROM usage_logs"""))
def behavior_rates(feeds: Feeds) -> DataFrame:
    """Skip, completion and diversity per day in both denominator forms."""
    return rounded(feeds.usage_logs().select("entity_id", "log_date", *behaviour_exprs()))


def behaviour_exprs() -> list:
    pairs = {"skip_rate": ("num_25", "num_unq"), "completion_rate": ("num_100", "num_unq"),
             "diversity_score": ("num_unq", None)}
    out = []
    for name, (top, bottom) in pairs.items():
        below = F.col(bottom) if bottom else wa.plays()
        out.append(clip(F.col(top) / (below + 1e-5), 0.0, 1.0).alias(name))
        out.append(clip(ratio(top, below), 0.0, 1.0).alias(f"{name}_safe"))
    return out


def usage_shift_frame(feeds: Feeds) -> DataFrame:
    """Activity sums, mean daily behaviour, intensity change and contract risk per label."""
    logs = wa.until(feeds.usage_logs(), "log_date", USAGE_CUTOFF)

    def last(days: int):
        return F.sum(F.when(F.col("log_date") >= wa.window_start(USAGE_CUTOFF, days), F.col("total_secs")).otherwise(0.0))

    activity = logs.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("log_days"),
        F.sum("total_secs").alias("total_secs"),
        last(7).alias("last7_secs"),
        last(14).alias("last14_secs"),
        F.sum(wa.plays()).alias("total_plays"),
        F.sum(clip(ratio("num_25", "num_unq"), 0.0, 1.0)).alias("skip_sum"),
        F.sum(clip(ratio("num_100", "num_unq"), 0.0, 1.0)).alias("completion_sum"),
        F.sum(clip(ratio("num_unq", wa.plays()), 0.0, 1.0)).alias("diversity_sum"),
    )
    billing = wa.until(feeds.transactions(), "txn_date", BILLING_CUTOFF).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("paid").alias("paid_sum"),
        F.sum("is_auto_renew").alias("renew_sum"), F.sum("is_cancel").alias("cancel_sum"),
    )
    df = feeds.churn_labels().join(activity, "entity_id", "left").join(billing, "entity_id", "left")
    log_days = F.coalesce("log_days", F.lit(0))
    prior_secs = F.greatest(or_zero("total_secs") - or_zero("last7_secs"), F.lit(0.0))
    prior_daily = prior_secs / F.greatest(log_days - 7, F.lit(1)).cast("double")
    renew_rate = ratio("renew_sum", "txn_count")
    return df.select(
        "entity_id", "is_churn", log_days.alias("log_days"),
        or_zero("last14_secs").alias("last14_secs"),
        F.coalesce("total_plays", F.lit(0)).alias("total_plays"),
        ratio("skip_sum", "log_days").alias("skip_mean"),
        ratio("completion_sum", "log_days").alias("completion_mean"),
        ratio("diversity_sum", "log_days").alias("diversity_mean"),
        ((or_zero("last7_secs") / 7.0 - prior_daily) / 60.0).alias("minutes_change"),
        ratio("paid_sum", "txn_count").alias("monthly_paid"),
        flag((ratio("cancel_sum", "txn_count") > 0) | (renew_rate < 0.5)).alias("contract_risk"),
    )


@query(statement("churn_labels usage_logs transactions", """
SELECT l.entity_id, l.is_churn, COALESCE(log_days, 0) AS log_days, ROUND(COALESCE(last14, 0), 6) AS last14_secs,
  CAST(COALESCE(total_plays, 0) AS BIGINT) AS total_plays,
  ROUND(COALESCE(skip_sum / log_days, 0), 6) AS skip_mean,
  ROUND(COALESCE(completion_sum / log_days, 0), 6) AS completion_mean,
  ROUND(COALESCE(diversity_sum / log_days, 0), 6) AS diversity_mean,
  ROUND((COALESCE(last7, 0) / 7 - GREATEST(COALESCE(total_secs, 0) - COALESCE(last7, 0), 0)
        / GREATEST(COALESCE(log_days, 0) - 7, 1)) / 60, 6) AS minutes_change,
  ROUND(COALESCE(paid_sum / txn_count, 0), 6) AS monthly_paid,
  CASE WHEN COALESCE(cancel_sum, 0) > 0 OR COALESCE(CAST(renew_sum AS DOUBLE) / txn_count, 0) < 0.5
       THEN 1e0 ELSE 0e0 END AS contract_risk
FROM churn_labels l LEFT JOIN a ON a.entity_id = l.entity_id LEFT JOIN b ON b.entity_id = l.entity_id""",
                 a=f"""SELECT entity_id, COUNT(*) AS log_days, SUM(total_secs) AS total_secs,
  SUM(CASE WHEN log_date >= DATE '2024-01-24' THEN total_secs ELSE 0 END) AS last7,
  SUM(CASE WHEN log_date >= DATE '2024-01-17' THEN total_secs ELSE 0 END) AS last14,
  SUM({PLAYS_SQL}) AS total_plays,
  SUM(COALESCE(LEAST(CAST(num_25 AS DOUBLE) / NULLIF(num_unq, 0), 1), 0)) AS skip_sum,
  SUM(COALESCE(LEAST(CAST(num_100 AS DOUBLE) / NULLIF(num_unq, 0), 1), 0)) AS completion_sum,
  SUM(COALESCE(LEAST(CAST(num_unq AS DOUBLE) / NULLIF({PLAYS_SQL}, 0), 1), 0)) AS diversity_sum
FROM usage_logs WHERE log_date <= DATE '{USAGE_CUTOFF}' GROUP BY entity_id""",
                 b=f"""SELECT entity_id, COUNT(*) AS txn_count, SUM(paid) AS paid_sum, SUM(is_auto_renew) AS renew_sum,
  SUM(is_cancel) AS cancel_sum FROM transactions WHERE txn_date <= DATE '{BILLING_CUTOFF}' GROUP BY entity_id"""))
def usage_shift(feeds: Feeds) -> DataFrame:
    """Recent against prior intensity, mean behaviour and the contract rule."""
    return rounded(usage_shift_frame(feeds))


@query(statement("usage_logs churn_labels members",
                 "SELECT u.entity_id, u.log_date, ROUND(u.total_secs, 6) AS total_secs, l.is_churn, m.city, m.gender, m.bd "
                 "FROM usage_logs u JOIN churn_labels l ON l.entity_id = u.entity_id "
                 "LEFT JOIN members m ON m.entity_id = u.entity_id"))
def gold_join(feeds: Feeds) -> DataFrame:
    """Logs with labels (inner) and profile (left)."""
    logs = feeds.usage_logs().select("entity_id", "log_date", "total_secs")
    people = feeds.members().select("entity_id", "city", "gender", "bd")
    return rounded(logs.join(feeds.churn_labels(), "entity_id").join(people, "entity_id", "left"))


@query(statement("usage_logs", f"""SELECT entity_id, COUNT(*) AS log_days, ROUND(SUM(total_secs), 6) AS total_secs,
  MIN(log_date) AS first_log_date, MAX(log_date) AS last_log_date
FROM usage_logs WHERE log_date <= DATE '{USAGE_CUTOFF}' GROUP BY entity_id"""))
def incremental_merge(feeds: Feeds) -> DataFrame:
    """Partial aggregates per ten-day batch, merged: sums of sums, min of mins, max of maxes."""
    logs = wa.until(feeds.usage_logs(), "log_date", USAGE_CUTOFF)
    batch = F.floor(F.dayofmonth("log_date") / 10)
    partial = logs.groupBy("entity_id", batch.alias("batch")).agg(*usage_state())
    return rounded(merge_usage_state(partial))


def usage_state() -> list:
    return [F.count(F.lit(1)).alias("log_days"), F.sum("total_secs").alias("total_secs"),
            F.min("log_date").alias("first_log_date"), F.max("log_date").alias("last_log_date")]


def merge_usage_state(partial: DataFrame) -> DataFrame:
    return partial.groupBy("entity_id").agg(
        F.sum("log_days").alias("log_days"), F.sum("total_secs").alias("total_secs"),
        F.min("first_log_date").alias("first_log_date"), F.max("last_log_date").alias("last_log_date"))


@query(statement("transactions", """
SELECT entity_id, CASE WHEN COALESCE(SUM(CASE WHEN txn_date > DATE '2000-12-01' AND txn_date <= DATE '2000-12-31'
    THEN paid END), 0) = 0 THEN 1 ELSE 0 END AS churned,
  CASE WHEN COALESCE(SUM(CASE WHEN txn_date > DATE '2000-12-01' AND txn_date <= DATE '2000-12-31'
    THEN paid END), 0) = 0 THEN -1 ELSE 1 END AS signed_label
FROM transactions GROUP BY entity_id"""))
def label_from_inactivity(feeds: Feeds) -> DataFrame:
    """Churned when the final month shows nothing; also as a -1/+1 label."""
    month = (F.col("txn_date") > F.lit("2000-12-01").cast("date")) & (F.col("txn_date") <= F.lit(BILLING_CUTOFF).cast("date"))
    used = F.coalesce(F.sum(F.when(month, F.col("paid"))), F.lit(0.0))
    return feeds.transactions().groupBy("entity_id").agg(
        F.when(used == 0, 1).otherwise(0).alias("churned"),
        F.when(used == 0, -1).otherwise(1).alias("signed_label"),
    )


def monthly_paid(feeds: Feeds, months: dict[str, str]) -> DataFrame:
    """Paid amount per entity in named calendar months, null without a payment."""
    month = F.date_format("txn_date", "yyyy-MM")
    days = [date.fromisoformat(f"{value}-01") for value in months.values()]
    after = (max(days) + timedelta(days=31)).replace(day=1)
    # the range of days reaches the scan, the months themselves do not
    near = F.col("txn_date").between(F.lit(min(days)), F.lit(after - timedelta(days=1)))
    return feeds.transactions().where(near & month.isin(*months.values())).groupBy("entity_id").agg(
        *[F.sum(F.when(month == value, F.col("paid"))).alias(name) for name, value in months.items()]
    )


_MONTHS = {"m6": "2000-10", "m7": "2000-11", "m8": "2000-12"}
_MONTH_STEP = ("SELECT entity_id, " + ", ".join(
    f"SUM(CASE WHEN strftime(txn_date, '%Y-%m') = '{v}' THEN paid END) AS {k}" for k, v in _MONTHS.items())
    + " FROM transactions WHERE strftime(txn_date, '%Y-%m') IN ('2000-10', '2000-11', '2000-12') GROUP BY entity_id")


@query(statement("transactions", """
SELECT entity_id, ROUND(m8 - CASE WHEN m6 IS NULL AND m7 IS NULL THEN NULL
    ELSE (COALESCE(m6, 0) + COALESCE(m7, 0)) / ((m6 IS NOT NULL)::INT + (m7 IS NOT NULL)::INT) END, 6) AS revenue_change,
  GREATEST((m6 IS NOT NULL)::INT + (m7 IS NOT NULL)::INT + (m8 IS NOT NULL)::INT, 1) AS active_months
FROM m""", m=_MONTH_STEP))
def month_change(feeds: Feeds) -> DataFrame:
    """Last month minus the mean of the two before it (gaps skipped), and a count of at least 1."""
    m = monthly_paid(feeds, _MONTHS)
    before = F.array_compact(F.array("m6", "m7"))
    mean = ratio_or_null(F.aggregate(before, F.lit(0.0), lambda a, x: a + x), F.size(before))
    present = sum((F.col(c).isNotNull().cast("int") for c in ("m7", "m8")), F.col("m6").isNotNull().cast("int"))
    return rounded(m.select("entity_id", (F.col("m8") - mean).alias("revenue_change"),
                            F.greatest(present, F.lit(1)).alias("active_months")))


@query(statement("transactions", """
SELECT entity_id, ROUND(good, 6) AS good_months FROM (
  SELECT entity_id, CASE WHEN m6 IS NULL AND m7 IS NULL THEN NULL
    ELSE (COALESCE(m6, 0) + COALESCE(m7, 0)) / ((m6 IS NOT NULL)::INT + (m7 IS NOT NULL)::INT) END AS good FROM m)
WHERE good >= (SELECT QUANTILE_CONT(CASE WHEN m6 IS NULL AND m7 IS NULL THEN NULL
    ELSE (COALESCE(m6, 0) + COALESCE(m7, 0)) / ((m6 IS NOT NULL)::INT + (m7 IS NOT NULL)::INT) END, 0.7) FROM m)""",
                 m=_MONTH_STEP))
def high_value_quantile(feeds: Feeds) -> DataFrame:
    """Entities whose two-month mean reaches its own 70 % quantile, taken before filtering."""
    months = F.array_compact(F.array("m6", "m7"))
    good = ratio_or_null(F.aggregate(months, F.lit(0.0), lambda a, x: a + x), F.size(months))
    m = monthly_paid(feeds, _MONTHS).select("entity_id", good.alias("good_months"))
    cut = exact_quantiles(m, "good_months", {"cut": 0.7}).select("cut").scalar()
    return rounded(m.where(F.col("good_months") >= cut))
