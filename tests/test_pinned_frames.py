"""What a pinned frame leaves on disk: its checkpoint, not the shuffle files that made it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.session import pin

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def live_shuffles(spark):
    """The shuffles whose files the driver still knows."""
    return set(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().toSeq()
    ))


def test_a_pinned_frame_drops_its_shuffles_and_only_those(spark):
    rows = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    other = rows.repartition(3, "s")
    other.count()
    before, setting = live_shuffles(spark), spark.conf.get(SETTING)
    pinned = pin(rows.repartition(5, "s"))
    assert live_shuffles(spark) <= before and spark.conf.get(SETTING) == setting
    # the frame that was pinned from, and the pinned one, still give all rows
    assert pinned.columns == ["k", "s"] and pinned.count() == other.count() == 1000
    assert pinned.agg(F.sum("s")).first()[0] == sum(range(100_000))
