"""Shared folder for intermediate tables, row keys, joins that split hot keys, and session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parts that the rows of one key of a join are dealt out to.
SALTS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (as in tests) takes a temporary
    folder; on a cluster this is an error, as executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="ledgerlight-")
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; ``release`` and ``sweep`` delete it as they do materialised tables."""
    path = f"{shared_dir(spark)}/ledgerlight-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: later stages, and retries after a lost executor, read files
    that every executor sees.  Shuffle files of the job are removed when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._ledgerlight_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    _delete(df.sparkSession, df._ledgerlight_path)


def written(spark: SparkSession) -> int:
    """How many tables have been materialised so far; the argument of ``sweep``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def sweep(keep: DataFrame, since: int) -> DataFrame:
    """Delete the tables materialised after the first ``since`` ones, but for ``keep``, which is returned."""
    spark = keep.sparkSession
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        if path != keep._ledgerlight_path:
            _delete(spark, path)
    paths[since:] = [keep._ledgerlight_path]
    return keep


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when no result is read any more."""
    _written.pop(spark.sparkContext.applicationId, None)
    _delete(spark, f"{shared_dir(spark)}/ledgerlight-{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Bound what is sent to a Python worker at once, in rows and in bytes, so that long texts don't pile up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def doc_id() -> Column:
    """The id as a long; null where it isn't a number."""
    return F.col("doc_id").try_cast("long").alias("doc_id")


def row_key() -> Column:
    """64-bit key of a row's id and text, the same for an id of any type; both sides of a join must take it from here."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def quoted(columns: list[str]) -> list[Column]:
    """The columns by their exact names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(df: DataFrame, run, *added: T.StructField) -> DataFrame:
    """``mapInArrow`` for tasks that keep all columns and put ``added`` after them; names may be any, so tasks see plain ones."""
    plain = [f"c{i}" for i in range(len(df.columns) + len(added))]
    fields = [*df.schema.fields, *added]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, fields)])
    return df.toDF(*plain[: len(df.columns)]).mapInArrow(run, schema).toDF(*[f.name for f in fields])


def spread_join(big: DataFrame, small: DataFrame, key: str, by: Column, how: str = "left") -> DataFrame:
    """``big`` joined with ``small`` (one row per ``key``) such that no task gets all rows of one key.

    Rows of a key are dealt out by a hash of ``by`` to at most ``SALTS`` parts,
    and only the parts that occur get a copy of the key's row of ``small``.
    """
    part = unused([*big.columns, *small.columns], "part")
    dealt = big.withColumn(part, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = dealt.select(key, part).distinct().join(small.hint("merge"), key)
    return dealt.join(copies.hint("merge"), [key, part], how).drop(part)
