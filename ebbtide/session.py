"""Session settings shared by the bench, the tests and ad-hoc use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "ebbtide",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the plans are written for.

    ``master`` is left to spark-submit when it is not given. On a cluster start from
    many small shuffle partitions: adaptive execution merges them to the advisory size.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # states with timers need this store; large states stay out of the heap
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        # methods above 8 kB of bytecode are never compiled by the JVM: let wide projections fall back
        # to Spark's split methods instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # wide feature plans build thousands of column objects; do not trace each one's call site
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Drops the shuffle files of an execution when it ends. Otherwise they stay until the driver's garbage collector finds them unused.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a local session may fall back to a folder of its own; a cluster without the
    setting is an error, because a machine-local folder is lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ebbtide-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(rows: DataFrame) -> DataFrame:
    """Write ``rows`` once to the shared checkpoint folder and cut their lineage.

    The shuffle files that made them are dropped at once: nothing reads them again. Other executions keep the session's setting.
    """
    session = rows.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(session))
    before = session.conf.get(DROP_SHUFFLES)
    session.conf.set(DROP_SHUFFLES, "true")
    try:
        # an execution takes the setting that holds when its frame is made
        return rows.select("*").checkpoint(eager=True)
    finally:
        session.conf.set(DROP_SHUFFLES, before)
