"""Token ids of a corpus in ORC files, in global order of the documents.

Rows are put in order by range partitioning and tokenised where they land, so a
file holds a contiguous run of documents.  A row is a document: its id, the
place of its first token in the file, and its ids, an integer column that ORC
writes in run-length encoded (bit-packed) form.  A file's stripes can be read by different tasks.
Stripes and row groups carry the range of their document ids and a Bloom filter
on them, by which a lookup skips what cannot hold an id.  The tokens before a
file are a running sum over one row per file, so nothing is rewritten.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import default_vocabulary, load_encoder
from .runtime import partitions, small_batches

#: Id after each document, and how the files are laid out: bytes of a stripe, rows of a row group (ORC's least), false positives of a Bloom filter.
END, STRIPE_BYTES, GROUP_ROWS, FALSE_POSITIVES = 0, 16 << 20, 1000, 0.01


def _fields(key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", key), T.StructField("file", T.IntegerType()), T.StructField("file_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Tokenise all ``docs`` (doc_id, text) and write them to the new folder ``path``, in ascending order of doc_id.

    A null text is empty and gives the end id alone; null ids come first; rows
    of one id stand in the order of a hash of their texts, equal rows in that of the input,
    and may be dealt to several files; texts of any length are one row.  An
    empty table gives files without rows.  Other columns are not read.  Ids
    equal those of the ``tokenizers`` library without special tokens added.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = vocabulary or default_vocabulary()
    order = ["doc_id", "tie", "row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = load_encoder(source)
        number, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.append(encoder.encode_to_numpy(t.as_py() or "", allowed_special="all").astype(np.int32, copy=False), np.int32(end)) for t in b.column(1)]
            sizes = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), number, np.int32)), pa.array(starts), pa.array(sizes), lists], names=["doc_id", "file", "file_start", "n_tokens", "ids"])

    layout = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.row.index.stride": GROUP_ROWS,
        "orc.rows.between.memory.checks": 256,  # rows are long, so a stripe's size is looked at often
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": FALSE_POSITIVES,
    }
    rows.mapInArrow(encode, _fields(docs.schema["doc_id"].dataType)).write.options(**layout).orc(path)


def read_tokens(spark: SparkSession, path: str, key: T.DataType | None = None) -> DataFrame:
    """(doc_id, file, file_start, n_tokens, ids) as written; a filter on doc_id skips stripes and row groups by their ranges and Bloom filters.

    ``key`` is the type of doc_id, a long by default.
    """
    return spark.read.schema(_fields(key or T.LongType())).orc(path)


def file_starts(tokens: DataFrame) -> DataFrame:
    """(file, before): tokens of all files before each one, from two columns of the files; one row per file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def token_digests(tokens: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of ``tokens``, from the ids as read.

    ``starts`` (of ``file_starts``) are those of the whole folder; they are needed if ``tokens`` is filtered.
    """
    small_batches(tokens.sparkSession)
    starts = file_starts(tokens) if starts is None else starts
    placed = tokens.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([tokens.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return placed.mapInArrow(digest, schema)
