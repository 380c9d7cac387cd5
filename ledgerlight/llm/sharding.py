"""Contiguous shards of equal byte size, from global prefix sums (DataFrame functions only).

Rows are put in a global order by range partitioning.  Each partition's total
is one row; a running sum over those few rows gives the bytes before each
partition, and a running sum inside the partition the rest.  A row's shard
follows from the middle of its byte range, cut at equal targets.  No task sees
more than its range, and all that is broadcast is one row per partition or
shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import doc_id, materialize, partitions

SHARDS = 40
#: Bytes counted for each row beside its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Shard all documents in order of ``doc_id``.

    Returns doc_id, size, text_crc32, shard (0 to ``shards`` - 1, rising with
    doc_id, byte totals at most one document apart from the target) and slot
    (position in the shard, gapless from 0).  A null text has no bytes and the
    checksum of an empty text; null doc_ids come first; equal doc_ids are
    ordered by checksum, and equal rows by their place in the input, so a hot
    id is split too.  A document larger than the target leaves shards it spans
    empty.  An empty table gives no rows; other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        doc_id(),
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Range bounds are sampled anew in each job, so the partition a row went to is written down once.
    placed = materialize(
        slim.repartitionByRange(partitions(spark), "doc_id", "text_crc32", "_row").withColumn("_part", F.spark_partition_id()),
        "shard-order",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "_row")
    start = F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size")
    middle = start * 2 + F.col("size")
    ranked = (
        placed.join(F.broadcast(totals), "_part")
        .withColumn("shard", F.least(F.floor(middle * shards / (F.col("_total") * 2)), F.lit(shards - 1)).cast("int"))
        .withColumn("_rank", F.col("_rows_before") + F.row_number().over(inside) - 1)
    )
    sizes = ranked.groupBy("shard").agg(F.count("*").alias("_n"))
    firsts = sizes.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return ranked.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).cast("long").alias("slot"))
