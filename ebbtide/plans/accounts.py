"""Plans over the account snapshot, payloads and mapped source domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import clip, or_zero, ratio, rounded, share, to_double
from ebbtide.functions.ordering import sorted_codes
from ebbtide.functions.text import joined, localised_number
from ebbtide.operators import crm, payloads, wide
from ebbtide.plans.activity import usage_shift_frame
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.session import pin
from ebbtide.sources.common_schema import COMMON_COLUMNS, signal_pool as combine_signals, to_common, union_sources
from ebbtide.sources.feeds import Feeds

KEY = '"PID", "EffectiveSegment"'


def sql_ratio(top: str, bottom: str) -> str:
    return f"COALESCE(CAST({top} AS DOUBLE) / NULLIF({bottom}, 0), 0)"


def sql_share(top: str, bottom: str) -> str:
    return f"LEAST(GREATEST({sql_ratio(top, bottom)}, 0), 1)"


def sql_balance(a: str, b: str) -> str:
    return f"LEAST(COALESCE({a}, 0), COALESCE({b}, 0)) / (GREATEST(COALESCE({a}, 0), COALESCE({b}, 0)) + 1e-5)"


def sql_flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1e0 ELSE 0e0 END"


# a prepared snapshot with lower-case short names
PREPARED = """SELECT "PID", COALESCE("PID", 'Unknown') AS account_id, "Billing_ZIP" AS zip,
  COALESCE("CRM_PID_Value_Segment", 'Unknown') AS crm, "EffectiveSegment" AS eff, "KA_name" AS ka,
  CAST("Total_SUBs" AS DOUBLE) AS subs, CAST("Active_subscribers" AS DOUBLE) AS active,
  CAST(COALESCE("Not_Active_subscribers", 0) AS DOUBLE) AS inactive,
  CAST(COALESCE("Suspended_subscribers", 0) AS DOUBLE) AS suspended,
  COALESCE("Not_Active_subscribers", 0) + COALESCE("Suspended_subscribers", 0) AS dormant,
  "AvgMobileRevenue" AS mobile, "AvgFIXRevenue" AS fixed, "TotalRevenue" AS revenue,
  COALESCE("ARPU", "TotalRevenue" / NULLIF("Total_SUBs", 0), 0) AS arpu,
  "Not_Active_subscribers" IS NULL AS m1, "Suspended_subscribers" IS NULL AS m2, "ARPU" IS NULL AS m3,
  "Billing_ZIP" IS NULL AS m4, CAST(COALESCE("Billing_ZIP", -1) AS VARCHAR) AS zip_text, "CHURN"
FROM crm_accounts"""


@query(statement("", """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 IN (0, 3, 4) THEN NULL ELSE ROUND(o_totalprice, 6) END AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS INT) END AS whole FROM orders"""))
def lenient_cast(feeds: Feeds) -> DataFrame:
    """All-text columns with padding, blanks and junk cast to numbers."""
    k = F.col("o_orderkey")
    text = feeds.table("orders").select(
        k,
        F.when(k % 7 == 0, " ").when(k % 7 == 3, "n/a").when(k % 7 == 4, "NaN")
        .otherwise(F.concat(F.lit("  "), F.col("o_totalprice").cast("string"), F.lit(" "))).alias("amount"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("whole"),
    )
    return rounded(text.select("o_orderkey", to_double("amount").alias("amount"), to_double("whole").cast("int").alias("whole")))


@query(statement("", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 11 = 1 THEN 0e0 WHEN o_orderkey % 11 = 2 THEN NULL
  WHEN o_orderkey % 11 = 3 THEN NULL ELSE ROUND(o_totalprice, 2) END AS amount FROM orders"""))
def localized_number(feeds: Feeds) -> DataFrame:
    """Numbers written with blanks between thousands and a decimal comma."""
    k = F.col("o_orderkey")
    written = F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    text = F.when(k % 11 == 0, " ").when(k % 11 == 1, "-").when(k % 11 == 2, "unknown").when(k % 11 != 3, written)
    return rounded(feeds.table("orders").select("o_orderkey", localised_number(text).alias("amount")))


@query(statement("crm_accounts", f"""
SELECT "PID", CAST("Total_SUBs" AS DOUBLE) AS "Total_SUBs", ROUND("AvgMobileRevenue", 6) AS "AvgMobileRevenue",
  ROUND("AvgFIXRevenue", 6) AS "AvgFIXRevenue", ROUND("TotalRevenue", 6) AS "TotalRevenue",
  ROUND(CASE WHEN "ARPU" IS NULL AND "Total_SUBs" > 0 THEN "TotalRevenue" / "Total_SUBs" ELSE "ARPU" END, 6) AS "ARPU",
  ROUND({sql_share('"Active_subscribers"', '"Total_SUBs"')}, 6) AS "Active_Ratio",
  CAST(COALESCE("Not_Active_subscribers", 0) AS DOUBLE) AS "Not_Active_subscribers",
  ROUND({sql_share('"AvgMobileRevenue"', '"TotalRevenue"')}, 6) AS "Mobile_Revenue_Ratio",
  ROUND({sql_share('"Not_Active_subscribers"', '"Total_SUBs"')}, 6) AS "Inactive_Ratio",
  ROUND({sql_share('"Suspended_subscribers"', '"Total_SUBs"')}, 6) AS "Suspended_Ratio",
  ROUND({sql_ratio('"TotalRevenue"', '"Active_subscribers"')}, 6) AS "Revenue_per_Active_Sub",
  ROUND({sql_share('"Not_Active_subscribers"', '"Total_SUBs"')} * "TotalRevenue", 6) AS "Inactive_x_Revenue",
  ROUND({sql_balance('"AvgMobileRevenue"', '"AvgFIXRevenue"')}, 6) AS "Revenue_Balance",
  COALESCE("CRM_PID_Value_Segment", 'Unknown') AS "CRM_PID_Value_Segment", "EffectiveSegment",
  CASE WHEN LOWER(TRIM("CHURN")) = 'yes' THEN 1 ELSE 0 END AS y
FROM crm_accounts WHERE LOWER(TRIM("CHURN")) IN ('yes', 'no')"""))
def crm_clean(feeds: Feeds) -> DataFrame:
    """Cleaned training rows of the snapshot."""
    clean = crm.labelled_accounts(feeds.crm_accounts(), keep=["PID"])
    money = ("AvgMobileRevenue", "AvgFIXRevenue", "TotalRevenue", "ARPU", "Revenue_per_Active_Sub", "Inactive_x_Revenue")
    return rounded(clean)


_RATIO_SQL = {
    "active_ratio": sql_share("active", "subs"), "inactive_ratio": sql_share("inactive", "subs"),
    "suspended_ratio": sql_share("suspended", "subs"), "dormant_ratio": sql_share("dormant", "subs"),
    "mobile_revenue_ratio": sql_share("mobile", "revenue"), "fixed_revenue_ratio": sql_share("fixed", "revenue"),
    "mobile_to_fixed_ratio": sql_ratio("mobile", "fixed"), "fixed_to_mobile_ratio": sql_ratio("fixed", "mobile"),
    "active_to_dormant_ratio": sql_ratio("active", "dormant"),
}
_VALUE_SQL = {
    "revenue_per_sub": sql_ratio("revenue", "subs"), "revenue_per_active": sql_ratio("revenue", "active"),
    "mobile_per_sub": sql_ratio("mobile", "subs"), "fixed_per_active": sql_ratio("fixed", "active"),
}


@query(statement("crm_accounts", 'SELECT "PID", eff AS "EffectiveSegment", '
                 + ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in _RATIO_SQL.items()) + ", "
                 + ", ".join(f"ROUND({e}, 4) AS {n}" for n, e in _VALUE_SQL.items()) + " FROM p", p=PREPARED))
def safe_ratios(feeds: Feeds) -> DataFrame:
    """Ratios that are 0 for a zero denominator, some limited to [0, 1]."""
    derived = crm.derived_features()
    df = crm.prepared(feeds.crm_accounts())
    return rounded(df.select("PID", "EffectiveSegment", *[derived[n].alias(n) for n in [*_RATIO_SQL, *_VALUE_SQL]]),
                   money={n: 4 for n in _VALUE_SQL})


_DERIVED_SQL = {
    "dormant_subscribers": "CAST(dormant AS DOUBLE)",
    "arpu_minus_revenue_per_sub": f"arpu - {sql_ratio('revenue', 'subs')}",
    "arpu_ratio_to_calc": sql_ratio("arpu", sql_ratio("revenue", "subs")),
    "active_minus_dormant": "active - dormant", "inactive_minus_suspended": "inactive - suspended",
    "subs_minus_active": "subs - active", "has_inactive": sql_flag("inactive > 0"),
    "has_suspended": sql_flag("suspended > 0"), "has_dormant": sql_flag("dormant > 0"),
    "multi_subscriber": sql_flag("subs > 1"), "large_account": sql_flag("subs >= 10"),
    "zero_fixed_revenue": sql_flag("fixed = 0"), "zero_mobile_revenue": sql_flag("mobile = 0"),
    "mobile_only": sql_flag("mobile > 0 AND fixed = 0"), "fixed_only": sql_flag("fixed > 0 AND mobile = 0"),
    "revenue_zero": sql_flag("revenue = 0"), "revenue_balance": sql_balance("mobile", "fixed"),
    "not_active_missing": sql_flag("m1"), "suspended_missing": sql_flag("m2"), "arpu_missing": sql_flag("m3"),
    "billing_zip_missing": sql_flag("m4"),
    "inactive_x_revenue": f"{sql_share('inactive', 'subs')} * revenue",
    "suspended_x_revenue": f"{sql_share('suspended', 'subs')} * revenue",
}
_DERIVED_SQL |= {f"{fn}_{n}": f"{sql}(GREATEST(COALESCE({c}, 0), 0){plus})" for fn, sql, plus in
                 (("log1p", "LN", " + 1"), ("sqrt", "SQRT", "")) for n, c in
                 {"active_subscribers": "active", "not_active_subscribers": "inactive",
                  "suspended_subscribers": "suspended", "dormant_subscribers": "dormant", "total_subs": "subs",
                  "avg_mobile_revenue": "mobile", "avg_fix_revenue": "fixed", "total_revenue": "revenue", "arpu": "arpu",
                  "revenue_per_sub": sql_ratio("revenue", "subs"),
                  "revenue_per_active": sql_ratio("revenue", "active")}.items()}
_DERIVED_PLACES = {"arpu_minus_revenue_per_sub": 4, "inactive_x_revenue": 4, "suspended_x_revenue": 4}


@query(statement("crm_accounts", 'SELECT "PID", eff AS "EffectiveSegment", ' + ", ".join(
    f"ROUND({e}, {_DERIVED_PLACES.get(n, 6)}) AS {n}" for n, e in _DERIVED_SQL.items()) + " FROM p", p=PREPARED))
def fe_derived(feeds: Feeds) -> DataFrame:
    """Differences, interactions, missing flags, binary flags, log and root forms."""
    df = crm.with_derived(crm.prepared(feeds.crm_accounts()))
    out = rounded(df.select("PID", "EffectiveSegment", *_DERIVED_SQL), money=_DERIVED_PLACES)
    # -0.0 and 0.0 are equal numbers but print differently
    return out.withColumn("arpu_minus_revenue_per_sub", F.col("arpu_minus_revenue_per_sub") + 0.0)


@query(statement("crm_accounts", """SELECT "PID", eff AS "EffectiveSegment", zip_text,
  SUBSTR(zip_text, 1, 1) AS zip_prefix_1, SUBSTR(zip_text, 1, 2) AS zip_prefix_2,
  FLOOR(COALESCE(zip, -1) / 100e0) AS zip_bucket FROM p""", p=PREPARED))
def zip_features(feeds: Feeds) -> DataFrame:
    """Postal text, its prefixes and hundreds bucket; a missing code is -1."""
    return crm.prepared(feeds.crm_accounts()).select(
        "PID", "EffectiveSegment", "zip_text", "zip_prefix_1", "zip_prefix_2", "zip_bucket")


@query(statement("crm_accounts", """SELECT "PID", eff AS "EffectiveSegment", crm || '|' || eff AS crm_effective,
  crm || '|' || ka AS crm_account, eff || '|' || ka AS effective_account, ka || '|' || zip_text AS account_zip,
  crm || '|' || zip_text AS segment_zip, crm || '|' || eff || '|' || ka AS crm_effective_account FROM p""", p=PREPARED))
def category_cross(feeds: Feeds) -> DataFrame:
    """Two- and three-way category combinations."""
    return crm.prepared(feeds.crm_accounts()).select("PID", "EffectiveSegment", *crm.crosses())


_PID_SQL = {
    "pid_row_count": "CAST(COUNT(*) AS DOUBLE)", "pid_active_sum": "SUM(active)", "pid_not_active_sum": "SUM(inactive)",
    "pid_suspended_sum": "SUM(suspended)", "pid_subs_sum": "SUM(subs)", "pid_mobile_sum": "SUM(mobile)",
    "pid_fixed_sum": "SUM(fixed)", "pid_revenue_sum": "SUM(revenue)", "pid_subs_mean": "AVG(subs)",
    "pid_subs_max": "MAX(subs)", "pid_revenue_mean": "AVG(revenue)", "pid_revenue_max": "MAX(revenue)",
    "pid_revenue_std": "COALESCE(STDDEV_SAMP(revenue), 0)", "pid_arpu_mean": "AVG(arpu)", "pid_arpu_max": "MAX(arpu)",
    "pid_zip_distinct": "CAST(COUNT(DISTINCT zip_text) AS DOUBLE)",
    "pid_account_distinct": "CAST(COUNT(DISTINCT ka) AS DOUBLE)",
    "pid_value_segment_distinct": "CAST(COUNT(DISTINCT crm) AS DOUBLE)",
    "pid_effective_segment_distinct": "CAST(COUNT(DISTINCT eff) AS DOUBLE)",
    "pid_multi_row": "CASE WHEN COUNT(*) > 1 THEN 1e0 ELSE 0e0 END",
    "pid_dormant_sum": "SUM(inactive) + SUM(suspended)",
    "pid_dormant_ratio": sql_share("SUM(inactive) + SUM(suspended)", "SUM(subs)"),
    "pid_mobile_ratio": sql_share("SUM(mobile)", "SUM(revenue)"),
    "pid_fixed_ratio": sql_share("SUM(fixed)", "SUM(revenue)"),
}


@query(statement("crm_accounts", "SELECT account_id, " + ", ".join(
    f"ROUND({e}, 6) AS {n}" for n, e in _PID_SQL.items()) + " FROM p GROUP BY account_id", p=PREPARED))
def pid_aggregates(feeds: Feeds) -> DataFrame:
    """Nineteen statistics and five ratios per account id."""
    return rounded(crm.pid_aggregates(crm.prepared(feeds.crm_accounts())))


_OWN_SQL = {
    "pid_row_count": "1", "pid_active_sum": "active", "pid_not_active_sum": "inactive", "pid_suspended_sum": "suspended",
    "pid_subs_sum": "subs", "pid_mobile_sum": "mobile", "pid_fixed_sum": "fixed", "pid_revenue_sum": "revenue",
    "pid_subs_mean": "subs", "pid_subs_max": "subs", "pid_revenue_mean": "revenue", "pid_revenue_max": "revenue",
    "pid_revenue_std": "0", "pid_arpu_mean": "arpu", "pid_arpu_max": "arpu", "pid_zip_distinct": "1",
    "pid_account_distinct": "1", "pid_value_segment_distinct": "1", "pid_effective_segment_distinct": "1",
    "pid_multi_row": "0", "pid_dormant_sum": "inactive + suspended",
    "pid_dormant_ratio": sql_share("(inactive + suspended)", "subs"),
    "pid_mobile_ratio": sql_share("mobile", "revenue"), "pid_fixed_ratio": sql_share("fixed", "revenue"),
}


@query(statement("crm_accounts", """SELECT "PID", eff AS "EffectiveSegment", """ + ", ".join(
    f"ROUND({n}, 6) AS {n}" for n in _PID_SQL) + f""",
  ROUND({sql_share('revenue', 'pid_revenue_sum')}, 6) AS pid_revenue_share,
  ROUND({sql_share('subs', 'pid_subs_sum')}, 6) AS pid_subs_share,
  ROUND(revenue - pid_revenue_mean, 6) + 0 AS pid_revenue_vs_mean, ROUND(arpu - pid_arpu_mean, 6) + 0 AS pid_arpu_vs_mean,
  ROUND(LN(1 + pid_revenue_sum), 6) AS log1p_pid_revenue_sum
FROM f""", p=PREPARED,
                 a="SELECT account_id, " + ", ".join(f"{e} AS {n}" for n, e in _PID_SQL.items())
                 + " FROM p WHERE CAST(account_id AS BIGINT) % 3 <> 0 GROUP BY account_id",
                 f="SELECT p.*, " + ", ".join(f"COALESCE(a.{n}, CAST({e} AS DOUBLE)) AS {n}" for n, e in _OWN_SQL.items())
                 + " FROM p LEFT JOIN a ON a.account_id = p.account_id"))
def pid_fallback(feeds: Feeds) -> DataFrame:
    """Training-row aggregates on every row; ids outside the training rows use their own values."""
    # the snapshot is built once; its training rows are summed and all rows looked up
    used = [*crm.PID_SUMS.values(), *crm.PID_DISTINCT.values(), "ARPU", "PID", "account_id"]
    df = pin(crm.prepared(feeds.crm_accounts()).select(*dict.fromkeys(used)))
    train = F.col("account_id").cast("bigint") % 3 != 0
    wide_rows = crm.with_pid_features(df, crm.pid_aggregates(df, only=train))
    out = rounded(wide_rows.select("PID", "EffectiveSegment", *_PID_SQL, "pid_revenue_share", "pid_subs_share",
                                   "pid_revenue_vs_mean", "pid_arpu_vs_mean", "log1p_pid_revenue_sum"))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("pid_revenue_vs_mean", "pid_arpu_vs_mean")})


SCORED = f"""SELECT *, LEAST(GREATEST(0.6e0 * {sql_share('inactive', 'subs')} + 0.4e0 * {sql_share('suspended', 'subs')}
  + 0.3e0 * {sql_share('mobile', 'revenue')}, 0), 1) AS churn_probability FROM p"""


def scored_accounts(feeds: Feeds) -> DataFrame:
    """Account lines with a rule score standing in for a model."""
    df = crm.prepared(feeds.crm_accounts())
    score = (0.6 * share("Not_Active_subscribers", "Total_SUBs") + 0.4 * share("Suspended_subscribers", "Total_SUBs")
             + 0.3 * share("AvgMobileRevenue", "TotalRevenue"))
    return df.withColumn("churn_probability", clip(score, 0.0, 1.0))


@query(statement("crm_accounts", """SELECT "PID", eff AS "EffectiveSegment", s.ka AS "KA_name",
  ROUND(churn_probability, 6) AS churn_probability, ROUND(g1, 6) AS group_avg_prob, ROUND(g2, 6) AS group_max_prob,
  g3 AS group_size, g2 >= 0.7 AS group_alert
FROM s JOIN (SELECT ka, AVG(churn_probability) AS g1, MAX(churn_probability) AS g2, COUNT(*) AS g3 FROM s GROUP BY ka) g
  ON g.ka = s.ka""", p=PREPARED, s=SCORED))
def contagion(feeds: Feeds) -> DataFrame:
    """Group risk re-attached to every account line."""
    scored = scored_accounts(feeds).select("PID", "EffectiveSegment", "KA_name", "churn_probability")
    return rounded(crm.with_group_risk(scored, "KA_name"))


@query(statement("crm_accounts", """SELECT COUNT(*) AS total_customers,
  COUNT(*) FILTER (churn_probability >= 0.5) AS churners,
  COUNT(*) FILTER (churn_probability >= 0.65) AS high_risk,
  ROUND(SUM(CASE WHEN churn_probability >= 0.5 THEN arpu ELSE 0 END), 2) AS expected_loss,
  (SELECT COUNT(*) FROM (SELECT ka FROM s GROUP BY ka HAVING MAX(churn_probability) >= 0.7)) AS group_alerts
FROM s""", p=PREPARED, s=SCORED))
def batch_summary(feeds: Feeds) -> DataFrame:
    """One row over a scored batch; high risk counts High and Critical."""
    scored = scored_accounts(feeds)
    churner = F.col("churn_probability") >= 0.5
    per_group = scored.groupBy("KA_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(churner).alias("churners"),
        F.count_if(F.col("churn_probability") >= 0.65).alias("high_risk"),
        F.sum(F.when(churner, F.col("ARPU")).otherwise(0.0)).alias("loss"),
        F.max("churn_probability").alias("top"),
    )
    return rounded(per_group.agg(
        F.sum("rows").alias("total_customers"), F.sum("churners").alias("churners"), F.sum("high_risk").alias("high_risk"),
        F.sum("loss").alias("expected_loss"), F.count_if(F.col("top") >= crm.GROUP_ALERT).alias("group_alerts"),
    ), money=["expected_loss"])


_GROUP_COLUMNS = {
    "revenue_size": {"Total_SUBs": "subs", "AvgMobileRevenue": "mobile", "AvgFIXRevenue": "fixed", "TotalRevenue": "revenue",
                     "ARPU": "arpu", "mobile_revenue_ratio": "1", "fixed_revenue_ratio": "1", "revenue_per_sub": "1",
                     "revenue_per_active": "1", "mobile_to_fixed_ratio": "1", "fixed_to_mobile_ratio": "1",
                     "mobile_only": "1", "fixed_only": "1"},
    "subscriber_status": {"Active_subscribers": "active", "Not_Active_subscribers": "inactive",
                          "Suspended_subscribers": "suspended", "active_ratio": "1", "inactive_ratio": "1",
                          "suspended_ratio": "1", "dormant_ratio": "1", "has_inactive": "1", "has_suspended": "1"},
    "customer_profile": {"CRM_PID_Value_Segment": "crm", "EffectiveSegment": "eff", "Billing_ZIP": "zip", "KA_name": "ka"},
}


@query(statement("crm_accounts", " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, '{c}' AS feature, "
    f"'{'category' if c in ('CRM_PID_Value_Segment', 'EffectiveSegment', 'KA_name') else 'numeric'}' AS kind, "
    f"COUNT({e}) AS known FROM p" for g, cols in _GROUP_COLUMNS.items() for c, e in cols.items()), p=PREPARED))
def feature_groups(feeds: Feeds) -> DataFrame:
    """Named column groups, absent columns skipped, each column's type and filled rows."""
    df = crm.with_derived(crm.prepared(feeds.crm_accounts()))
    groups = crm.present_groups(df)
    columns = [c for cols in groups.values() for c in cols]
    numeric, _ = crm.split_by_type(df, columns)
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("feature_group"), F.lit(c).alias("feature"),
                 F.lit("numeric" if c in numeric else "category").alias("kind"), F.col(c).alias("known"))
        for g, cols in groups.items() for c in cols
    ]))
    return counts.select(rows.alias("r")).select("r.*")


_SEGMENT_KEY = "COALESCE(\"CRM_PID_Value_Segment\", 'Unknown') || '_' || \"EffectiveSegment\" || '_' || \"KA_name\""


@query(statement("crm_accounts", f"""SELECT "PID", "EffectiveSegment", {_SEGMENT_KEY} AS segment,
  DENSE_RANK() OVER (ORDER BY {_SEGMENT_KEY}) - 1 AS segment_code FROM crm_accounts"""))
def stable_codes(feeds: Feeds) -> DataFrame:
    """Integer codes of a combined key by sort order, independent of file order."""
    df = feeds.crm_accounts().select("PID", "EffectiveSegment", joined(
        [F.coalesce("CRM_PID_Value_Segment", F.lit("Unknown")), "EffectiveSegment", "KA_name"], "_").alias("segment"))
    return df.join(sorted_codes(df, "segment", "segment_code"), "segment")


# the snapshot and the activity features on the shared columns, as SQL expressions both engines read
_SNAPSHOT_MAP = {
    "monthly_revenue": "TotalRevenue", "mobile_revenue": "AvgMobileRevenue", "fixed_revenue": "AvgFIXRevenue",
    "total_revenue": "TotalRevenue", "arpu": "ARPU", "total_subs": "Total_SUBs", "active_subs": "Active_subscribers",
    "inactive_subs": "COALESCE(Not_Active_subscribers, 0)", "suspended_subs": "COALESCE(Suspended_subscribers, 0)",
    "skip_rate": "0", "completion_rate": "0", "diversity_score": "0", "zip_code": "Billing_ZIP", "dataset_code": "0",
}
_ACTIVITY_MAP = {
    "monthly_revenue": "monthly_paid", "mobile_revenue": "monthly_paid", "fixed_revenue": "0", "arpu": "monthly_paid",
    "total_subs": "1", "active_subs": "CASE WHEN log_days > 0 THEN 1 ELSE 0 END",
    "inactive_subs": "CASE WHEN log_days > 0 THEN 0 ELSE 1 END", "suspended_subs": "0", "usage_frequency": "total_plays",
    "skip_rate": "skip_mean", "completion_rate": "completion_mean", "diversity_score": "diversity_mean",
    "minutes_change": "minutes_change", "contract_risk": "contract_risk", "dataset_code": "7",
}


def _mapped_sql(mapping: dict[str, str], extra: dict[str, str]) -> str:
    full = mapping | extra
    return ", ".join(f"ROUND(CAST({full.get(c, 'NULL')} AS DOUBLE), 6) AS {c}" for c in COMMON_COLUMNS)


_SNAPSHOT_EXTRA = {
    "active_ratio": sql_share("Active_subscribers", "Total_SUBs"),
    "inactive_ratio": sql_share("Not_Active_subscribers", "Total_SUBs"),
    "suspended_ratio": sql_share("Suspended_subscribers", "Total_SUBs"),
    "revenue_per_active_sub": sql_ratio("TotalRevenue", "Active_subscribers"),
    "inactive_x_revenue": f"{sql_share('Not_Active_subscribers', 'Total_SUBs')} * TotalRevenue",
    "revenue_balance": sql_balance("AvgMobileRevenue", "AvgFIXRevenue"),
}
_ARPU_FIX = '* REPLACE (CASE WHEN "ARPU" IS NULL AND "Total_SUBs" > 0 THEN "TotalRevenue" / "Total_SUBs" ELSE "ARPU" END AS "ARPU")'


def _activity_step() -> str:
    from ebbtide.plans.catalog import ENTRIES

    return ENTRIES["usage_shift"].sql


@query(f"""WITH crm AS (SELECT {_ARPU_FIX} FROM (
{statement("crm_accounts", "SELECT * FROM crm_accounts")})),
act AS ({_activity_step()})
SELECT 'snapshot' AS source, "PID" || '/' || "EffectiveSegment" AS row_key, {_mapped_sql(_SNAPSHOT_MAP, _SNAPSHOT_EXTRA)},
  CASE WHEN LOWER(TRIM("CHURN")) = 'yes' THEN 1 WHEN LOWER(TRIM("CHURN")) = 'no' THEN 0 END AS churn FROM crm
UNION ALL SELECT 'activity', CAST(entity_id AS VARCHAR), {_mapped_sql(_ACTIVITY_MAP, {})}, is_churn FROM act""")
def common_schema_union(feeds: Feeds) -> DataFrame:
    """Two domains on the 39 shared columns, one below the other."""
    raw = feeds.crm_accounts()
    fixed = raw.withColumn("ARPU", F.when(F.col("ARPU").isNull() & (F.col("Total_SUBs") > 0),
                                          F.col("TotalRevenue") / F.col("Total_SUBs")).otherwise(F.col("ARPU")))
    fixed = fixed.select(*[c for c in raw.columns if c != "CHURN"], F.lit("snapshot").alias("source"), F.concat_ws("/", "PID", "EffectiveSegment").alias("row_key"),
                         F.when(F.lower(F.trim("CHURN")) == "yes", 1).when(F.lower(F.trim("CHURN")) == "no", 0).alias("churn"))
    inactive = share("Not_Active_subscribers", "Total_SUBs")
    snapshot = to_common(fixed, _SNAPSHOT_MAP | {
        "active_ratio": share("Active_subscribers", "Total_SUBs"), "inactive_ratio": inactive,
        "suspended_ratio": share("Suspended_subscribers", "Total_SUBs"),
        "revenue_per_active_sub": ratio("TotalRevenue", "Active_subscribers"),
        "inactive_x_revenue": inactive * or_zero("TotalRevenue"),
        "revenue_balance": crm.balance("AvgMobileRevenue", "AvgFIXRevenue"),
    }, keep=["source", "row_key", "churn"])
    activity = usage_shift_frame(feeds).select(
        "*", F.lit("activity").alias("source"), F.col("entity_id").cast("string").alias("row_key"), F.col("is_churn").alias("churn"))
    # the checked statement reads the rounded activity features
    shared = to_common(rounded(activity), _ACTIVITY_MAP, keep=["source", "row_key", "churn"])
    return rounded(union_sources([snapshot, shared]))


@query(statement("transactions crm_accounts", """
SELECT source, row_key, ROUND(COALESCE(a, 0), 6) AS fusion_usage_drop_rate, ROUND(COALESCE(b, 0), 6) AS fusion_retention_calls,
  ROUND(COALESCE(c, 0), 6) AS fusion_charges_per_tenure, ROUND(COALESCE(d, 0), 6) AS fusion_month_to_month,
  ROUND(COALESCE(e, 0), 6) AS fusion_satisfaction FROM (
  SELECT 'network' AS source, CAST(txn_id AS VARCHAR) AS row_key,
    LEAST(GREATEST(-(paid / 997 - 250) / 100, -1), 1) AS a, CAST(is_cancel AS DOUBLE) AS b, NULL AS c, NULL AS d, NULL AS e
  FROM transactions
  UNION ALL SELECT 'contract', "PID" || '/' || "EffectiveSegment", NULL, NULL,
    "TotalRevenue" / GREATEST("Total_SUBs", 1), CASE WHEN "CRM_PID_Value_Segment" = 'BUILDING' THEN 1e0 ELSE 0e0 END, NULL
  FROM crm_accounts
  UNION ALL SELECT 'survey', CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, CAST(quality * 5 - toxic AS DOUBLE) FROM labels)"""))
def signal_pool(feeds: Feeds) -> DataFrame:
    """Behaviour signals of three outside domains in one prefixed pool."""
    network = feeds.transactions().select(
        F.lit("network").alias("source"), F.col("txn_id").cast("string").alias("row_key"),
        clip(-(F.col("paid") / 997.0 - 250.0) / 100.0, -1.0, 1.0).alias("usage_drop_rate"),
        F.col("is_cancel").alias("retention_calls"))
    contract = feeds.crm_accounts().select(
        F.lit("contract").alias("source"), F.concat_ws("/", "PID", "EffectiveSegment").alias("row_key"),
        ratio("TotalRevenue", F.greatest("Total_SUBs", F.lit(1))).alias("charges_per_tenure"),
        (F.col("CRM_PID_Value_Segment") == "BUILDING").cast("double").alias("month_to_month"))
    survey = feeds.table("labels").select(
        F.lit("survey").alias("source"), F.col("doc_id").cast("string").alias("row_key"),
        (F.col("quality") * 5 - F.col("toxic")).alias("satisfaction"))
    return rounded(combine_signals([network, contract, survey], keep=["source", "row_key"]))


@query("""WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x < -0.15 THEN NULL ELSE x END) AS v
FROM embeddings), k AS (SELECT *, list_filter(v, lambda x: x IS NOT NULL) AS w,
  list_filter(v[1:16], lambda x: x IS NOT NULL) AS b1, list_filter(v[49:64], lambda x: x IS NOT NULL) AS b4 FROM v)
SELECT vec_id, ROUND(COALESCE(list_avg(w), 0), 6) AS row_mean, ROUND(COALESCE(list_sum(w), 0), 6) AS row_sum,
  ROUND(COALESCE(list_aggregate(w, 'median'), 0), 6) AS row_median,
  CAST(len(list_filter(v, lambda x: x <> 0)) AS DOUBLE) AS nonzero, CAST(len(list_filter(v, lambda x: x IS NULL)) AS DOUBLE) AS missing,
  CAST(len(list_filter(v, lambda x: x < 0)) AS DOUBLE) AS negative,
  ROUND(COALESCE(list_sum(list_transform(w, lambda x: ABS(x))), 0), 6) AS abs_sum,
  ROUND(COALESCE(list_avg(b4), 0) - COALESCE(list_avg(b1), 0), 6) AS block_change,
  CAST(len(list_distinct(list_transform(v, lambda x: COALESCE(CAST(ROUND(x * 10) AS INT), -99)))) AS DOUBLE) AS distinct_values
FROM k""")
def wide_row_stats(feeds: Feeds) -> DataFrame:
    """Row statistics over many columns held as one array; low values count as missing."""
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x >= -0.15, x))
    df = feeds.table("embeddings").select("vec_id", cells.alias("v"))
    v = F.col("v")
    texts = F.transform(v, lambda x: F.round(x * 10).cast("int").cast("string"))
    return rounded(df.select(
        "vec_id", wide.row_mean(v).alias("row_mean"), wide.row_sum(v).alias("row_sum"), wide.row_median(v).alias("row_median"),
        wide.nonzero_count(v).alias("nonzero"), wide.missing_count(v).alias("missing"), wide.negative_count(v).alias("negative"),
        wide.abs_sum(v).alias("abs_sum"),
        (wide.row_mean(wide.block(v, 48, 64)) - wide.row_mean(wide.block(v, 0, 16))).alias("block_change"),
        wide.distinct_count(texts).alias("distinct_values")))


@query(statement("churn_labels usage_logs members", """
SELECT COUNT(*) AS rows, ROUND(AVG(l.is_churn), 6) AS churn_rate, COUNT(u.entity_id) AS matched_usage,
  ROUND(COUNT(u.entity_id) / COUNT(*), 6) AS usage_match_rate, COUNT(m.entity_id) AS matched_members,
  COUNT(DISTINCT l.entity_id) AS distinct_entities, COUNT(DISTINCT m.city) AS distinct_cities
FROM churn_labels l LEFT JOIN (SELECT DISTINCT entity_id FROM usage_logs) u ON u.entity_id = l.entity_id
LEFT JOIN members m ON m.entity_id = l.entity_id"""))
def dataset_profile(feeds: Feeds) -> DataFrame:
    """One row that describes a built table: size, rate, matches, distinct keys."""
    used = feeds.table("events").select(F.col("user_id").alias("entity_id")).distinct().withColumn("has_usage", F.lit(1))
    people = feeds.members().select("entity_id", "city", F.lit(1).alias("has_member"))
    built = feeds.churn_labels().join(used, "entity_id", "left").join(people, "entity_id", "left")
    return rounded(profile(built))


def profile(built: DataFrame) -> DataFrame:
    return built.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("is_churn").alias("churn_rate"), F.count("has_usage").alias("matched_usage"),
        (F.count("has_usage") / F.count(F.lit(1))).alias("usage_match_rate"), F.count("has_member").alias("matched_members"),
        F.count_distinct("entity_id").alias("distinct_entities"), F.count_distinct("city").alias("distinct_cities"))


def align_rows(data: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Join two row-aligned files on their row key; a key on one side only is an error."""
    left, right = data.withColumn("_l", F.lit(True)), labels.withColumn("_r", F.lit(True))
    both = left.join(right, key, "full_outer")
    checked = F.when(F.col("_l").isNull() | F.col("_r").isNull(),
                     F.raise_error(F.concat(F.lit("unmatched row "), F.col(key).cast("string")))).otherwise(F.col(key))
    return both.withColumn(key, checked).drop("_l", "_r")


@query("""SELECT o_orderkey AS row_id, ROUND(o_totalprice, 6) AS v1, NULLIF(o_orderpriority, '5-LOW') AS v2,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS label FROM orders""")
def row_aligned_labels(feeds: Feeds) -> DataFrame:
    """A data file and its -1/+1 label file joined on an explicit row key."""
    orders = feeds.table("orders")
    data = orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("v1"),
                         F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("v2"))
    signs = orders.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(-1).alias("sign"))
    both = align_rows(data, signs, "row_id")
    return rounded(both.select("row_id", "v1", "v2", F.when(F.col("sign") == 1, 1).otherwise(0).alias("label")))


def request_bodies(feeds: Feeds) -> DataFrame:
    """Account lines as JSON requests: objects, lists, other key names, texts and broken bodies."""
    df = feeds.crm_accounts().withColumn("n", F.col("PID").cast("bigint"))
    named = F.to_json(F.struct(
        F.col("PID").alias("customer_id"), F.col("Total_SUBs").cast("string").alias("total_subs"),
        F.col("TotalRevenue").alias("total_revenue"), F.col("ARPU").alias("arpu"),
        F.col("Active_subscribers").alias("active_subscribers"), F.lit("").alias("not_active_subscribers"),
        F.col("CRM_PID_Value_Segment").alias("crm_segment")))
    original = F.to_json(F.struct("PID", "Total_SUBs", "TotalRevenue", "ARPU", "Active_subscribers",
                                  "Not_Active_subscribers", "CRM_PID_Value_Segment"))
    body = (F.when(F.col("n") % 7 == 0, F.lit("not a request"))
            .when(F.col("n") % 7 == 1, F.concat(F.lit("["), named, F.lit(","), original, F.lit("]")))
            .when(F.col("n") % 7 == 2, original).otherwise(named))
    return df.select("PID", "EffectiveSegment", body.alias("body"))


@query(statement("crm_accounts", """
SELECT "PID", "EffectiveSegment", CASE WHEN bad THEN '' ELSE "PID" END AS customer_id,
  CASE WHEN bad THEN 0e0 ELSE CAST("Total_SUBs" AS DOUBLE) END AS total_subs,
  CASE WHEN bad THEN 0e0 ELSE ROUND("TotalRevenue", 6) END AS total_revenue,
  CASE WHEN bad THEN 0e0 ELSE ROUND(COALESCE("ARPU", "TotalRevenue" / "Total_SUBs"), 6) END AS arpu,
  CASE WHEN bad THEN 0e0 ELSE CAST("Active_subscribers" AS DOUBLE) END AS active_subscribers,
  CASE WHEN n % 7 = 2 THEN CAST(COALESCE("Not_Active_subscribers", 0) AS DOUBLE) ELSE 0e0 END AS not_active_subscribers,
  CASE WHEN bad THEN 'Unknown' ELSE COALESCE("CRM_PID_Value_Segment", 'Unknown') END AS crm_segment,
  CASE WHEN bad THEN 'not a request' END AS raw_body
FROM (SELECT *, CAST("PID" AS BIGINT) AS n, CAST("PID" AS BIGINT) % 7 = 0 AS bad FROM crm_accounts)"""))
def payload_coerce(feeds: Feeds) -> DataFrame:
    """Request texts to typed columns with aliases and defaults."""
    names = ["customer_id", "total_subs", "total_revenue", "arpu", "active_subscribers", "not_active_subscribers",
             "crm_segment", "raw_body"]
    return rounded(payloads.with_request(request_bodies(feeds), "body").select("PID", "EffectiveSegment", *names))


@query("""SELECT event_id, CASE WHEN p >= 0 AND p <= 1 AND c >= 0 AND COALESCE(q BETWEEN 0 AND 1, TRUE) THEN p END AS churn_probability,
  CASE WHEN p >= 0 AND p <= 1 AND c >= 0 AND COALESCE(q BETWEEN 0 AND 1, TRUE) THEN q END AS previous_probability,
  CONCAT_WS(',', CASE WHEN NOT (p >= 0 AND p <= 1) THEN 'churn_probability' END, CASE WHEN c < 0 THEN 'action_cost' END,
    CASE WHEN NOT q BETWEEN 0 AND 1 THEN 'previous_probability' END) AS errors,
  p >= 0 AND p <= 1 AND c >= 0 AND COALESCE(q BETWEEN 0 AND 1, TRUE) AS valid
FROM (SELECT event_id, ROUND(value / 150, 6) AS p, value - 5 AS c,
  CASE WHEN event_id % 5 < 3 THEN NULL WHEN event_id % 5 = 3 THEN 0.25e0 ELSE ROUND(value / 100, 6) END AS q FROM events)""")
def validated_requests(feeds: Feeds) -> DataFrame:
    """Range checks with the names of the violated rules; empty words count as missing."""
    e = F.col("event_id")
    before = F.when(e % 5 == 0, "").when(e % 5 == 1, "None").when(e % 5 == 2, "null").when(e % 5 == 3, "0.25").otherwise(
        F.round(F.col("value") / 100, 6).cast("string"))
    df = feeds.table("events").select(
        "event_id", F.round(F.col("value") / 150, 6).alias("p"), (F.col("value") - 5).alias("cost"),
        payloads.empty_to_null(before).cast("double").alias("q"))
    errors = payloads.validation_errors({
        "churn_probability": F.col("p").between(0, 1), "action_cost": F.col("cost") >= 0,
        "previous_probability": F.col("q").between(0, 1)})
    checked = df.withColumn("errors", errors)
    valid = F.size("errors") == 0
    return checked.select("event_id", F.when(valid, F.col("p")).alias("churn_probability"),
                          F.when(valid, F.col("q")).alias("previous_probability"),
                          F.array_join("errors", ",").alias("errors"), valid.alias("valid"))


@query("""SELECT c_custkey, ROUND(CASE WHEN c_custkey % 13 = 0 THEN 0.9e0
  WHEN c_custkey % 6 IN (4, 5) THEN 0.5e0
  WHEN c_acctbal / 7919 BETWEEN 0 AND 1 THEN c_acctbal / 7919 ELSE 0.5e0 END, 6) AS threshold FROM customer""")
def resolve_threshold(feeds: Feeds) -> DataFrame:
    """Decision threshold from policy documents of several shapes, with an override."""
    k, value = F.col("c_custkey"), (F.col("c_acctbal") / 7919).cast("string")
    doc = (F.when(k % 6 == 0, F.concat(F.lit('{"selected_threshold": '), value, F.lit(', "best": {"threshold": 0.1}}')))
           .when(k % 6 == 1, F.concat(F.lit('{"best": {"f1": 0.2, "threshold": '), value, F.lit("}}")))
           .when(k % 6 == 2, F.concat(F.lit('{"best": {"f1": 0.2}, "best_validation": {"threshold": '), value, F.lit("}}")))
           .when(k % 6 == 3, F.concat(F.lit('{"selected_threshold": "'), value, F.lit('"}')))
           .when(k % 6 == 4, F.lit("{broken")).otherwise(F.lit('{"selected_threshold": "high", "best": {"threshold": 0.3}}')))
    override = F.when(k % 13 == 0, "0.9").when(k % 13 == 1, "")
    return rounded(feeds.table("customer").select("c_custkey", payloads.policy_threshold(doc, override).alias("threshold")))


@query("""SELECT batch_id, COUNT(*) AS total_customers, COUNT(*) FILTER (p >= 0.5) AS alert_required_count,
  ROUND(SUM(p), 6) AS probability_sum, MIN(k) AS first_customer,
  SUM(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS slack_gmail
FROM (SELECT o_orderkey AS k, o_orderkey // 50 AS batch_id, (o_totalprice % 1000) / 1000 AS p FROM orders) GROUP BY batch_id""")
def batch_envelope(feeds: Feeds) -> DataFrame:
    """Requests nested in batches opened, answered and closed again."""
    orders = feeds.table("orders").select(
        (F.floor(F.col("o_orderkey") / 50)).alias("batch_id"),
        F.struct(F.col("o_orderkey").alias("customer_id"), (F.col("o_totalprice") % 1000 / 1000).alias("score")).alias("c"))
    # a batch is fifty consecutive keys, so the list is bounded
    batches = orders.groupBy("batch_id").agg(F.sort_array(F.collect_list("c")).alias("customers"))
    requests = payloads.open_envelope(batches, "batch_id", "customers")
    alert = F.col("score") >= 0.5
    answers = requests.select("batch_id", "customer_id", "score", alert.alias("alert_required"),
                              F.when(alert, "Slack,Gmail").otherwise("None").alias("alert_channel"))
    closed = payloads.close_envelope(answers, "batch_id", "alert_required", "customer_id")
    return rounded(closed.select(
        "batch_id", "total_customers", "alert_required_count",
        F.aggregate("predictions", F.lit(0.0), lambda a, x: a + x["score"]).alias("probability_sum"),
        F.col("predictions")[0]["customer_id"].alias("first_customer"),
        F.size(F.filter("predictions", lambda x: x["alert_channel"] == "Slack,Gmail")).cast("bigint").alias("slack_gmail")))
