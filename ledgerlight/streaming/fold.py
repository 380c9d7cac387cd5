"""The log fold as a stream.

Counters add, days take the least and the greatest.  The result after a finished
stream equals the batch fold of the whole log; verdicts are in ``streaming.sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import log as L
from ..sources import versions


def counters(log: DataFrame) -> DataFrame:
    """Per key: injects, pos, neg, first and last day; a commutative fold, so a streaming aggregation."""
    e = F.col("event")
    n = L.number(F.col("session"))
    amount = F.when(e.isin("inject", "recall"), 1).when(e == "inject-agg", F.when(n >= 1, n).otherwise(1)).otherwise(0)
    return log.groupBy("key").agg(
        F.sum(amount).cast("bigint").alias("injects"), F.sum((e == "outcome-positive").cast("bigint")).alias("pos"),
        F.sum((e == "outcome-negative").cast("bigint")).alias("neg"), F.min("date").alias("created"),
        F.max(F.when(e.isin("inject", "recall", "inject-agg"), F.col("date"))).alias("last_inject"),
    )


def start_counters(stream: DataFrame, name: str, checkpoint: str | None = None):
    """Start the fold of a streaming log (line_no, date, event, target, session) into the in-memory table ``name``, for looking at small logs."""
    writer = counters(L.keyed(stream)).writeStream.outputMode("complete").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def keep_counters(stream: DataFrame, path: str, checkpoint: str):
    """Start the fold of a streaming log into the versioned table at ``path``.

    A batch brings the new totals of the keys that it changed; these replace the
    old ones, and only buckets that hold such a key are written.  A batch that is tried again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if versions.latest(spark, path) is None:
            versions.replace(batch.limit(0), path, ["key"])
        versions.upsert(spark, path, batch.withColumn("deleted", F.lit(False)), f"counters-{number}")

    return counters(L.keyed(stream)).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def deduplicated(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The stream's rows once each, among those at most ``delay`` late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["date", "event", "target", "session"])
