"""Repeat-safe sinks and the scheduled run of a streaming plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_once(path: str, partition: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that a repeated batch cannot duplicate.

    Each batch owns the folder ``batch=<id>`` below ``path`` and overwrites it as a whole,
    so a batch that is replayed after a failure replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch={batch_id}")

    return write


def run_available(
    stream: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = (), mode: str = "append"
) -> StreamingQuery:
    """Handle everything that has arrived, then stop: the scheduled form of a stream.

    The checkpoint (a shared folder on a cluster) remembers what was read, so the next
    scheduled run continues there and sends no alert twice.
    """
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append_once(path, partition))
        .start()
    )


def read_log(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A log without repeated keys: the newest batch wins."""
    rest = [c for c in frame.columns if c not in keys]
    newest = frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
