"""Readers and writers of the engine's own formats: logs, fact files, transcripts, snapshots."""

from __future__ import annotations

import time
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_list
from ..schema import TAIL_BYTES
from . import versions


def read_log(spark: SparkSession, path: str, one_log: bool = False) -> DataFrame:
    """(line_no, value): lines in physical order, numbered from 1 in each file, or through all files in order of their names if they are ``one_log``.

    Files are read in splits, by as many tasks as there are; a line's number is
    its place in its split plus the lines of the splits before, which are a
    running sum over one row per split.  Lines end at ``\\n`` alone.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    # Ids of consecutive rows of a task are consecutive, and a split is read by one task.
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    order = (Window.orderBy("_file", "_block") if one_log else Window.partitionBy("_file").orderBy("_block")).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    return lines.join(splits, ["_file", "_block"]).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "value")


def split_frontmatter(content: str) -> tuple[dict[str, str], str]:
    """Keys of a leading ``---`` block, and the rest, trimmed.

    A byte-order mark and CRLF are accepted; quotes at either end of a value go;
    ``- item`` lines below a key without value are joined by commas; other
    indented lines are ignored; the later of two equal keys wins; an unclosed
    block is all body.
    """
    text = content.removeprefix("\ufeff")
    lines = text.split("\n")
    closing = next((i for i, x in enumerate(lines) if i and x.rstrip(" \t\r") == "---"), None) if text.startswith("---") else None
    if closing is None:
        return {}, text.strip()
    found: dict[str, str] = {}
    pending: str | None = None  # the key whose items may follow
    for line in lines[1:closing]:
        bare = line.strip()
        if pending is not None and bare.startswith("- "):
            item = bare[2:].strip().strip("\"'")
            found[pending] = f"{found[pending]}, {item}" if found[pending] else item
        elif not line.startswith((" ", "\t")):
            key, colon, value = line.partition(":")
            if colon and key:
                found[key.strip()] = value = value.strip().strip("\"'")
            pending = key.strip() if colon and key and not value else None
    return found, "\n".join(lines[closing + 1 :]).strip()


#: A leading block with its closing line and what ends that; white space as Python's ``strip`` has it.
_BLOCK, _SPACE = r"(?s)^\x{FEFF}?---.*?\n---[ \t\r]*(?:\n|\z)", r"\s\x1c-\x1f"


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _keys_of(block: pd.Series) -> pd.Series:
    return pd.Series([split_frontmatter(b or "")[0] for b in block])


def parse_frontmatter(content: Column) -> Column:
    """``split_frontmatter`` of a column, as a struct of fm and body; only the block goes to Python, however long the text is."""
    text = F.coalesce(content, F.lit(""))
    block = F.regexp_extract(text, _BLOCK, 0)
    rest = F.when(block == "", F.regexp_replace(text, r"^\x{FEFF}", "")).otherwise(F.substr(text, F.char_length(block) + 1))
    body = F.regexp_replace(rest, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+\z", "")
    return F.struct(_keys_of(block).alias("fm"), body.alias("body"))


def parse_facts(raw: DataFrame, project: str) -> DataFrame:
    """Fact rows of files (path, content): the ``*.md`` ones, without ``MEMORY.md``."""
    rows = raw.select(F.substring_index("path", "/", -1).alias("slug"), "path", "content").filter("endswith(slug, '.md') and slug <> 'MEMORY.md'")
    rows = rows.withColumn("p", parse_frontmatter(F.col("content").cast("string")))
    get = lambda k: F.coalesce(F.col("p.fm")[k], F.lit(""))
    return rows.select(
        "slug", "path", *[get(k).alias(k) for k in ("name", "description", "type", "created", "status", "skill")],
        *[parse_list(get(k)).alias(k) for k in ("keywords", "domains", "evidence")],
        get("precision_class").alias("precision_class"),
        F.coalesce(F.when(get("recurrence").rlike(r"^[+-]?\d{1,18}$"), get("recurrence").try_cast("bigint")), F.lit(0).cast("bigint")).alias("recurrence"),
        F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"), F.col("p.body").alias("body"), F.lit(project).alias("project"),
    )


def read_facts(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Fact rows of the files directly in a folder; none if there are no such files."""
    return parse_facts(spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path), project)


def scope_union(own: DataFrame, shared: DataFrame) -> DataFrame:
    """Facts of a project and of the global store together."""
    return own.unionByName(shared.withColumn("project", F.lit("global")))


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows (date, event, target, session) of a job to the folder of a log; without a check for repeats."""
    rows.select(F.concat_ws("|", "date", "event", "target", "session").alias("value")).write.mode("append").text(path)


def log_tail(spark: SparkSession, path: str, size: int = TAIL_BYTES) -> list[str]:
    """Whole lines among the last ``size`` bytes of a log: a file, or a folder of files in order of their names.

    Only these bytes are read, from the files that hold them.  If the log is
    longer, the first line of the stretch is left out, as it may be a part of one.
    """
    fs, where = versions.location(spark, path)
    if not fs.exists(where):
        return []
    files = [fs.getFileStatus(where)]
    if files[0].isDirectory():
        files = sorted((f for f in fs.listStatus(where) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    parts, left = [], size
    for f in reversed(files):
        if not left:
            break
        n = min(left, f.getLen())
        parts.append(versions.read_bytes(spark, f.getPath().toString(), f.getLen() - n, n))
        left -= n
    lines = b"".join(reversed(parts)).decode("utf-8", "replace").split("\n")
    if sum(f.getLen() for f in files) > size:
        lines = lines[1:]
    return [x for x in lines if x]


def append_line(spark: SparkSession, path: str, line: str, key: str | None = None, wait: float = 1.0) -> bool:
    """Append a line to the folder of a log, unless a line of its tail contains ``key``; tells whether it was written.

    Writers take turns (``versions.exclusive``), so two that bring the same key
    add one line.  A line is a file of its own, which appears whole; names sort
    by time, after those before.
    """
    fs, where = versions.location(spark, path)
    fs.mkdirs(where)
    with versions.exclusive(spark, f"{path}/_lock", wait):
        if key is not None and any(key in x for x in log_tail(spark, path)):
            return False
        last = max((n for n in versions.names(spark, path) if n.endswith(".log")), default="")
        number = max(int(time.time() * 1000), int(last[:15]) + 1 if last[:15].isdigit() else 0)
        versions.publish(spark, f"{path}/{number:015d}-{uuid.uuid4().hex}.log", line.replace("\n", " ") + "\n")
    return True


def store_projection(projection: DataFrame, path: str, batch: str | None = None) -> int:
    """Publish the projection (keys project, slug) as a table's next version; readers keep the version they have."""
    return versions.replace(projection, path, ["project", "slug"], batch)


def load_projection(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The stored projection, the newest version by default."""
    return versions.read(spark, path, at)


def projection_check(spark: SparkSession, path: str, log: str) -> tuple[str, str]:
    """(status, detail) of a stored projection beside its log: WARN if it is missing or older than the log's last write, else OK."""
    number = versions.latest(spark, path)
    written = versions.modified(spark, log)
    if number is None:
        return ("OK", "no projection yet") if written is None else ("WARN", "projection missing, log exists")
    built = versions.modified(spark, f"{path}/_versions/{number:010d}.json")
    if written is not None and built < written:
        return "WARN", "projection older than the log"
    return "OK", f"projection version {number}"


def envelope(rows: DataFrame) -> DataFrame:
    """(query_id, json): results as JSON objects."""
    return rows.select("query_id", F.to_json(F.struct(*[c for c in rows.columns if c != "query_id"])).alias("json"))
