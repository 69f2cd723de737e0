"""Churn inputs derived from the star-schema tables of a test-data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BILLING_CUTOFF = "2000-12-31"
LABEL_END = "2001-03-31"
USAGE_CUTOFF = "2024-01-30"

_known_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; the schema is read from the footers once per process."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = _known_schemas.get(path)
    if schema is None:
        frame = spark.read.parquet(path)
        _known_schemas[path] = frame.schema
        return frame
    return spark.read.schema(schema).parquet(path)


class Feeds:
    """The reference inputs of the churn plans over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def usage_logs(self) -> DataFrame:
        """One row per entity and day with play-like counters."""
        kinds = {"num_25": "error", "num_50": "signup", "num_75": "click", "num_985": "view", "num_100": "purchase"}
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("entity_id"), F.to_date("ts").alias("log_date"))
            .agg(
                *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()],
                F.count_distinct("props").alias("num_unq"),
                F.sum("value").alias("total_secs"),
            )
        )

    def transactions(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("txn_id"),
            F.col("o_custkey").alias("entity_id"),
            F.to_date("o_orderdate").alias("txn_date"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_method_id"),
            (30 * (1 + key % 3)).cast("int").alias("plan_days"),
            (F.col("o_totalprice") * (1.0 + (key % 5).cast("double") * 0.05)).alias("list_price"),
            F.col("o_totalprice").alias("paid"),
            (F.col("o_orderstatus") == "F").cast("int").alias("is_auto_renew"),
            (F.col("o_orderstatus") == "P").cast("int").alias("is_cancel"),
        )

    def churn_labels(self) -> DataFrame:
        """Churned: no order in the three months after the billing cutoff."""
        day = F.to_date("o_orderdate")
        later = (day > F.lit(BILLING_CUTOFF).cast("date")) & (day <= F.lit(LABEL_END).cast("date"))
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("entity_id"))
            .agg(F.count_if(later).alias("_later"), F.min(day).alias("_first"))
            .where(F.col("_first") <= F.lit(BILLING_CUTOFF).cast("date"))
            .select("entity_id", (F.col("_later") == 0).cast("int").alias("is_churn"))
        )

    def members(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return (
            self.table("customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("entity_id"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("region"),
                F.col("c_mktsegment").alias("gender"),
                F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 80.0).cast("int")).alias("bd"),
            )
        )

    def crm_accounts(self) -> DataFrame:
        """Account lines; the account id repeats, several columns have gaps."""
        cust = F.col("o_custkey")
        price, even = F.col("o_totalprice"), F.col("o_orderkey") % 2 == 0
        # labels come from the same customer key: one shuffle serves both aggregates
        lines = (
            self.table("orders")
            .where(F.col("o_orderdate") <= F.lit(BILLING_CUTOFF).cast("timestamp_ntz"))
            .groupBy("o_custkey", "o_orderpriority")
            .agg(
                F.count(F.lit(1)).cast("int").alias("lines"),
                F.count_if(F.col("o_orderstatus") == "O").cast("int").alias("active"),
                F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("inactive"),
                F.count_if(F.col("o_orderstatus") == "P").cast("int").alias("suspended"),
                F.sum(F.when(even, price).otherwise(0.0)).alias("mobile"),
                F.sum(F.when(~even, price).otherwise(0.0)).alias("fixed"),
                F.sum(price).alias("revenue"),
            )
        )
        people = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "n_name", "c_mktsegment")
        )
        labels = self.churn_labels()
        return (
            lines.join(people, cust == F.col("c_custkey"))
            .join(labels, cust == F.col("entity_id"))
            .select(
                cust.cast("string").alias("PID"),
                F.col("n_name").alias("KA_name"),
                F.when(cust % 17 != 0, (1000 + (cust * 37) % 9000).cast("int")).alias("Billing_ZIP"),
                F.when(cust % 23 != 0, F.col("c_mktsegment")).alias("CRM_PID_Value_Segment"),
                F.col("o_orderpriority").alias("EffectiveSegment"),
                F.col("lines").alias("Total_SUBs"),
                F.col("active").alias("Active_subscribers"),
                F.nullif(F.col("inactive"), F.lit(0)).alias("Not_Active_subscribers"),
                F.nullif(F.col("suspended"), F.lit(0)).alias("Suspended_subscribers"),
                F.col("mobile").alias("AvgMobileRevenue"),
                F.col("fixed").alias("AvgFIXRevenue"),
                F.col("revenue").alias("TotalRevenue"),
                F.when(cust % 5 != 0, F.col("revenue") / F.col("lines")).alias("ARPU"),
                F.when(cust % 31 == 0, F.lit(None))
                .when(F.col("is_churn") == 1, F.lit("Yes"))
                .otherwise(F.lit(" no"))
                .alias("CHURN"),
            )
        )

    def scores(self) -> DataFrame:
        doc = F.col("doc_id")
        return (
            self.table("labels")
            .select("doc_id", "quality")
            .join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
            .select(
                doc.alias("row_id"),
                (1 - F.col("quality")).alias("y"),
                ((F.col("n_chars") % 997).cast("double") / 997.0).alias("s1"),
                (((doc * 37) % 101).cast("double") / 101.0).alias("s2"),
                F.when(doc % 4 != 0, ((doc * 53) % 89).cast("double") / 89.0).alias("s3"),
                F.when(doc % 5 == 0, "test").when(doc % 5 == 1, "val").otherwise("train").alias("split"),
            )
        )

    def alert_events(self) -> DataFrame:
        event = F.col("event_id")
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("event_time"),
            F.when(F.col("value") >= 150.0, 1.0).otherwise(F.col("value") / 150.0).alias("churn_probability"),
            F.when(event % 6 == 0, " Completed ").when(event % 6 == 1, "open").alias("response_status"),
            (F.col("user_id") % 7 == 0).alias("is_vip_customer"),
            (F.col("user_id") % 11 == 0).alias("is_high_revenue_customer"),
        )

    def retention_actions(self) -> DataFrame:
        key, rank = F.col("o_orderkey"), F.col("o_orderpriority")
        return self.table("orders").select(
            key.cast("string").alias("customer_id"),
            F.col("o_totalprice").alias("expected_revenue_loss"),
            (key % 2 == 0).alias("alert_sent"),
            F.when(key % 3 == 0, ((key % 40) * 10).cast("double")).alias("action_cost"),
            ((key % 7) * 10).cast("double").alias("coupon_cost"),
            ((key % 5) * 20).cast("double").alias("discount_cost"),
            F.lit(0.0).alias("consulting_cost"),
            F.when(rank.isin("1-URGENT", "2-HIGH"), "completed").when(rank != "5-LOW", "open").alias("response_status"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("actual_churn"),
            F.when(key % 13 == 0, F.lit(True)).alias("retention_success"),
        )
