"""Tables in numbered versions: keyed upserts that rewrite the touched buckets only, and readers that keep their version.

Rows are dealt to buckets by a hash of their key.  A version is one small
manifest that names, for each bucket, the folder that holds it; folders are never
changed once written.  A writer puts new folders beside the old ones and then
publishes the next manifest, claimed by an exclusive file first, so of two writers
one is told that it came too late.  A reader takes the newest manifest and keeps
reading its folders whatever is published later.  A batch's name is kept in the
manifest, so that applying a batch again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table, batch names a manifest keeps, and seconds after which a claim counts as left by a dead writer.
BUCKETS, BATCHES_KEPT, STALE_CLAIM = 16, 1000, 3600
_BUCKET = "ledger_bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that was to be written."""


def location(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, but for hidden ones; none if it doesn't exist."""
    fs, where = location(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in found if not n.startswith("."))


def modified(spark: SparkSession, path: str) -> int | None:
    """When a file, or the newest visible file of a folder, was last written, in milliseconds; null if there is none."""
    fs, where = location(spark, path)
    if not fs.exists(where):
        return None
    status = fs.getFileStatus(where)
    found = [status] if status.isFile() else [f for f in fs.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "._"]
    return max((f.getModificationTime() for f in found), default=None)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = location(spark, path)
    return read_bytes(spark, path, 0, fs.getFileStatus(where).getLen()).decode()


def read_bytes(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    """``size`` bytes of a file from ``start`` on."""
    fs, where = location(spark, path)
    stream = fs.open(where)
    try:
        stream.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it appears whole: under a hidden name first, then renamed."""
    fs, where = location(spark, path)
    folder, _, name = path.rpartition("/")
    _, draft = location(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(draft, where):
        fs.delete(draft, False)
        raise Conflict(path)


def _created(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it is there.  One of several callers succeeds: Hadoop's own check is no single step on local disks."""
    fs, where = location(spark, path)
    fs.mkdirs(where.getParent())
    if fs.getScheme() == "file":
        return spark.sparkContext._jvm.java.io.File(where.toUri().getPath()).createNewFile()
    try:
        fs.create(where, False).close()
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    return True


@contextmanager
def exclusive(spark: SparkSession, path: str, wait: float = 1.0, poll: float = 0.05, stale: float = STALE_CLAIM) -> Iterator[None]:
    """Hold the file ``path`` alone; ``Conflict`` after ``wait`` seconds.  A file older than ``stale`` seconds is taken over."""
    fs, where = location(spark, path)
    end = time.monotonic() + wait
    while not _created(spark, path):
        if fs.exists(where) and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 > stale:
            fs.delete(where, False)
        elif time.monotonic() >= end:
            raise Conflict(path)
        else:
            time.sleep(poll)
    try:
        yield
    finally:
        fs.delete(where, False)


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest version's number, from 0; null for a table that has none."""
    found = [int(n[:-5]) for n in names(spark, f"{path}/_versions") if n.endswith(".json")]
    return max(found, default=None)


def _manifest(spark: SparkSession, path: str, at: int) -> dict:
    return json.loads(read_text(spark, f"{path}/_versions/{at:010d}.json"))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, path: str, manifest: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    folders = [f"{path}/{f}" for b, f in sorted(manifest["parts"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """All rows of a version, the newest by default; later versions don't change what the result reads."""
    number = latest(spark, path) if at is None else at
    if number is None:
        raise FileNotFoundError(path)
    return _rows(spark, path, _manifest(spark, path, number))


def matching(spark: SparkSession, path: str, keys: DataFrame, at: int) -> DataFrame:
    """Rows of a version in the buckets that may hold a key of ``keys``; other buckets aren't read."""
    manifest = _manifest(spark, path, at)
    wanted = {r[0] for r in keys.select(_bucket(manifest["keys"], manifest["buckets"])).distinct().collect()}
    return _rows(spark, path, manifest, wanted)


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> dict[str, str]:
    """Write rows in buckets to a new folder; bucket -> folder."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, _bucket(keys, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    made = [n for n in names(rows.sparkSession, f"{path}/{folder}") if n.startswith(f"{_BUCKET}=")]
    return {n.split("=")[1]: f"{folder}/{n}" for n in made}


def _commit(spark: SparkSession, path: str, manifest: dict) -> int:
    number = manifest["version"]
    with exclusive(spark, f"{path}/_versions/{number:010d}.claim"):
        newest = latest(spark, path)
        if (-1 if newest is None else newest) != number - 1:
            raise Conflict(f"{path} has version {newest}")
        publish(spark, f"{path}/_versions/{number:010d}.json", json.dumps(manifest))
    return number


def replace(rows: DataFrame, path: str, keys: list[str], batch: str | None = None, buckets: int = BUCKETS, forget: tuple[str, ...] = ()) -> int:
    """Publish ``rows`` as the next version (the first one of a new table), whatever the table holds now; returns its number.

    Batches named in ``forget`` count as not applied from then on.
    """
    spark = rows.sparkSession
    base = latest(spark, path)
    before = [b for b in _manifest(spark, path, base)["batches"] if b not in forget] if base is not None else []
    if batch is not None and batch in before:
        return base
    parts = _write(rows, path, keys, buckets)
    batches = ([*before, batch] if batch is not None else before)[-BATCHES_KEPT:]
    return _commit(spark, path, {"version": 0 if base is None else base + 1, "keys": keys, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": parts, "batches": batches})


def restore(spark: SparkSession, path: str, at: int) -> int:
    """Publish version ``at`` anew, with the batches it had; no rows are written."""
    return _commit(spark, path, _manifest(spark, path, at) | {"version": latest(spark, path) + 1})


def applied(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch of that name is in the newest version."""
    number = latest(spark, path)
    return number is not None and batch in _manifest(spark, path, number)["batches"]


def upsert(spark: SparkSession, path: str, changes: DataFrame, batch: str, base: int | None = None) -> int:
    """Apply ``changes`` (the table's columns and a boolean ``deleted``) by key and publish the next version; returns its number.

    A key is changed by one row at most.  Only buckets with a changed key are
    read and written.  ``base`` is the version that the changes were worked out
    from (default: the newest); ``Conflict`` if another one was published since.
    A batch that was applied already changes nothing.
    """
    number = latest(spark, path)
    if number is None:
        raise FileNotFoundError(path)
    manifest = _manifest(spark, path, number)
    if batch in manifest["batches"]:
        return number
    if base is not None and base != number:
        raise Conflict(f"{path} has version {number}")
    keys, buckets = manifest["keys"], manifest["buckets"]
    touched = {r[0] for r in changes.select(_bucket(keys, buckets)).distinct().collect()}
    parts = {b: f for b, f in manifest["parts"].items() if int(b) not in touched}
    if touched:
        old = _rows(spark, path, manifest, touched)
        changed = changes.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        kept = old.join(changed, same, "left_anti")
        parts |= _write(kept.unionByName(changes.filter("not deleted").select(*old.columns)), path, keys, buckets)
    return _commit(spark, path, manifest | {"version": number + 1, "parts": parts, "batches": [*manifest["batches"], batch][-BATCHES_KEPT:]})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions, and folders that none of those names; returns how many folders went.

    Readers of older versions must be done, and no writer may be at work.
    """
    number = latest(spark, path)
    if number is None:
        return 0
    fs, _ = location(spark, path)
    kept = [n for n in range(max(0, number - keep + 1), number + 1) if f"{n:010d}.json" in names(spark, f"{path}/_versions")]
    used = {f.split("/")[1] for n in kept for f in _manifest(spark, path, n)["parts"].values()}
    for n in names(spark, f"{path}/_versions"):
        if not n.endswith(".json") or int(n[:-5]) not in kept:
            fs.delete(location(spark, f"{path}/_versions/{n}")[1], False)
    gone = [n for n in names(spark, f"{path}/data") if n not in used]
    for n in gone:
        fs.delete(location(spark, f"{path}/data/{n}")[1], True)
    return len(gone)
