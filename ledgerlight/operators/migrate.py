"""Planning a move of old files into the present layout, carrying it out, and taking it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ACTIVE_EVENTS
from ..sources import versions


def wal_active(wal: DataFrame) -> DataFrame:
    """(slug): targets, without .md, that the log shows in use."""
    return wal.filter(F.col("event").isin(*ACTIVE_EVENTS)).select(F.regexp_replace("target", r"\.md$", "").alias("slug")).distinct()


def approximate_days(later: Column, earlier: Column) -> Column:
    """Days between two days by year * 365 + month * 30 + day, not by the calendar."""
    def part(c: Column, k: int) -> Column:
        return F.regexp_extract(c, r"^(\d{4})-(\d{1,2})-(\d{1,2})", k).try_cast("int")

    return (part(later, 1) - part(earlier, 1)) * 365 + (part(later, 2) - part(earlier, 2)) * 30 + part(later, 3) - part(earlier, 3)


def prune_plan(files: DataFrame, wal: DataFrame, today: str) -> DataFrame:
    """(slug, project, pruned) of files (slug, project, status, ref_count, created): unpinned, unused, older than 30 days, not in the log.

    Files of unknown age are kept.
    """
    active = wal_active(wal).withColumn("_a", F.lit(True))
    age = approximate_days(F.lit(today), F.col("created"))
    f = files.withColumn("_b", F.regexp_replace("slug", r"\.md$", "")).join(active.withColumnRenamed("slug", "_b"), "_b", "left")
    pruned = (F.col("status") != "pinned") & (F.col("ref_count") == 0) & (age > 30) & F.col("_a").isNull()
    return f.select("slug", "project", F.coalesce(pruned, F.lit(False)).alias("pruned"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy(F.when(F.col("pruned"), "pruned").otherwise("kept").alias("action")).agg(F.count("*").alias("n"))


def route(files: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, project, target_dir): the directory of the project's working folder (names: project, cwd), global where unknown."""
    cwd = F.regexp_replace("cwd", "/", "-")
    known = F.col("cwd").isNotNull() & ~F.coalesce("project", F.lit("")).isin("", "global")
    return files.join(names, "project", "left").select("slug", "project", F.when(known, F.concat(F.lit("projects/"), cwd, F.lit("/memory"))).otherwise("global").alias("target_dir"))


def allocate(files: DataFrame) -> DataFrame:
    """(dir, sub, walk, slug) of files: the second and later of one dir and slug, in walk order, get their subfolder as prefix."""
    w = Window.partitionBy("dir", "slug").orderBy("walk")
    return files.withColumn("_n", F.row_number().over(w)).select("dir", "sub", "walk", F.when(F.col("_n") > 1, F.concat("sub", F.lit("-"), "slug")).otherwise(F.col("slug")).alias("slug"))


def humanize(slug: Column) -> Column:
    s = F.translate(slug, "-", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))


def first_line(body: Column) -> Column:
    """The first line that isn't blank without leading hashes, at most 100 characters."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 100), F.lit(""))


def to_native(files: DataFrame) -> DataFrame:
    """(slug, content) of files (slug, name, description, type, root_cause, prevention, body): the present form of a file."""
    quote = lambda c: F.concat(F.lit('"'), F.translate(c, '"', "'"), F.lit('"'))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    name = F.when(empty("name"), humanize(F.regexp_replace("slug", r"\.md$", ""))).otherwise(F.col("name"))
    text = F.when(empty("description"), first_line(F.col("body"))).otherwise(F.col("description"))
    body = F.concat(
        F.when(empty("root_cause"), "").otherwise(F.concat(F.lit("**Root cause:** "), "root_cause", F.lit("\n\n"))),
        F.when(empty("prevention"), "").otherwise(F.concat(F.lit("**Prevention:** "), "prevention", F.lit("\n\n"))),
        F.coalesce("body", F.lit("")),
    )
    content = F.concat(F.lit("---\nname: "), quote(name), F.lit("\ndescription: "), quote(text), F.lit("\ntype: "), "type", F.lit("\n---\n"), F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))
    return files.select("slug", content.alias("content"))


def backups(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, batch) of the complete backups in a folder, oldest first; one whose copy was never published doesn't count."""
    found = [(int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in versions.names(spark, folder) if n[:6].isdigit() and n[6:7] == "-"]
    return sorted((k, batch) for k, batch in found if versions.latest(spark, f"{folder}/{k:06d}-{batch}") is not None)


def back_up(spark: SparkSession, old: str, folder: str, batch: str) -> str:
    """Copy the newest version of the table ``old`` to a numbered backup; one that this batch made already is kept as it is."""
    done = backups(spark, folder)
    for number, name in done:
        if name == batch:
            return f"{folder}/{number:06d}-{batch}"
    target = f"{folder}/{max((k for k, _ in done), default=0) + 1:06d}-{batch}"
    versions.replace(versions.read(spark, old), target, ["project", "slug"], batch)
    return target


def execute(spark: SparkSession, old: str, new: str, folder: str, convert: Callable[[DataFrame], DataFrame], batch: str) -> int:
    """Move the table ``old`` (keys project, slug) into ``new`` (keys target_dir, slug): back up, write what is kept, drop it from ``old``.

    ``convert`` makes the plan (project, slug, action, target_dir, new_slug,
    content) from the old rows; rows of action ``keep`` move, the others stay.
    A new table is started where there is none.  If a step fails, ``old`` and
    ``new`` are put back as they were (``old`` from the newest backup) and the error is raised.  A batch that was
    carried out changes nothing.  Returns the new table's version.
    """
    if versions.applied(spark, old, batch):
        return versions.latest(spark, new)
    back_up(spark, old, folder, batch)
    before, base = versions.latest(spark, new), versions.latest(spark, old)
    try:
        plan = convert(versions.read(spark, old, base)).filter("action = 'keep'")
        rows = plan.select("target_dir", F.col("new_slug").alias("slug"), "content")
        if before is None:
            versions.replace(rows, new, ["target_dir", "slug"], batch)
        else:
            versions.upsert(spark, new, rows.withColumn("deleted", F.lit(False)), batch, before)
        gone = versions.read(spark, old, base).join(plan.select("project", "slug"), ["project", "slug"], "left_semi")
        versions.upsert(spark, old, gone.withColumn("deleted", F.lit(True)), batch, base)
    except Exception:
        if versions.latest(spark, new) != before and before is not None:
            versions.restore(spark, new, before)
        elif versions.latest(spark, new) != before:
            versions.replace(versions.read(spark, new).limit(0), new, ["target_dir", "slug"], forget=(batch,))
        if versions.latest(spark, old) != base:
            rollback(spark, old, folder)
        raise
    return versions.latest(spark, new)


def rollback(spark: SparkSession, old: str, folder: str) -> int:
    """Publish the newest backup as the next version of ``old``, in which its batch counts as not carried out; returns its number."""
    done = backups(spark, folder)
    if not done:
        raise FileNotFoundError(folder)
    number, batch = done[-1]
    return versions.replace(versions.read(spark, f"{folder}/{number:06d}-{batch}"), old, ["project", "slug"], forget=(batch,))
