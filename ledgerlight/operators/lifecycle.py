"""Retiring and reviving facts, and starting and stopping ablations: what changes in the store and what the log says.

The store is one table of facts (project, slug, archived, content): ``archived``
is null for a live fact and the file name in the archive otherwise.  So a fact
that moves is a change of one table, which is published whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..schema import DEFAULT_HOLDOUT, GLOBAL, SEPARATOR
from ..sources import versions

EVENTS = "date string, event string, target string, session string"
_FENCE = r"---[ \t\r]*"


def joined(text: Column) -> Column:
    """White space as underscores, so that the text is one field of a log row."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda x: x != ""), "_")


def qualified(project: Column, slug: Column) -> Column:
    return F.concat(project, F.lit(SEPARATOR), F.regexp_replace(slug, r"\.md$", ""))


def _given(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def stamped(content: Column, day: str, reason: Column, successor: Column) -> Column:
    """The file with the keys of a tombstone before the end of its first block; a file without a closed block gets one."""
    keys = F.concat(
        F.lit(f"retired: {day}\n"),
        F.when(_given(reason), F.concat(F.lit("retire-reason: "), reason, F.lit("\n"))).otherwise(""),
        F.when(_given(successor), F.concat(F.lit("superseded-by: "), successor, F.lit("\n"))).otherwise(""),
    )
    # Parts: the first fence and what is in the block, then the closing fence and the rest.
    head = F.regexp_extract(content, rf"(?s)\A({_FENCE}\n(?:.*?\n)??){_FENCE}(?:\n|\z)", 1)
    return F.when(head != "", F.concat(head, keys, F.substring(content, F.length(head) + 1, F.length(content)))).otherwise(F.concat(F.lit("---\n"), keys, F.lit("---\n"), content))


def unstamped(content: Column) -> Column:
    """The file without the keys of a tombstone in its first block; indented lines are no keys."""
    lines = F.split(content, "\n")
    fence = F.lit(rf"^{_FENCE}$")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    closing = F.coalesce(F.array_position(F.transform(rest, lambda x: F.regexp_like(x, fence)), True), F.lit(0))
    inside = F.when(closing > 0, closing - 1).otherwise(F.size(rest)).cast("int")
    key = r"^(?:retired|retire-reason|superseded-by)[ \t]*(?::|\s*$)"
    kept = F.filter(F.slice(rest, F.lit(1), inside), lambda x: ~x.rlike(key))
    after = F.slice(rest, inside + 1, F.size(rest))
    out = F.array_join(F.concat(F.slice(lines, 1, 1), kept, after), "\n")
    return F.when(F.regexp_like(F.get(lines, F.lit(0)), fence), out).otherwise(content)


def _resolved(orders: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Orders (own, slug, ...) with the one row of their scope whose ``column`` is their file name: project, content and how many there are."""
    asked = orders.withColumn("slug", F.concat(F.regexp_replace("slug", r"\.md$", ""), F.lit(".md"))).dropDuplicates(["own", "slug"])
    asked = asked.withColumn("project", F.explode(F.array_distinct(F.array("own", F.lit(GLOBAL)))))
    there = rows.select("project", F.col(column).alias("slug"), F.col("content").alias("_content"))
    found = asked.join(there.withColumn("_hit", F.lit(1)), ["project", "slug"], "left")
    first = F.min_by(F.struct("project", F.col("_content").alias("content")), F.when(F.col("_hit").isNotNull(), F.col("project") == GLOBAL))
    others = [F.first(c).alias(c) for c in orders.columns if c not in ("own", "slug")]
    found = found.groupBy("own", "slug").agg(F.count("_hit").alias("n"), first.alias("f"), *others)
    # Of projects that order one fact of the global store, the first by name gets it; for the others it is gone.
    turn = F.row_number().over(Window.partitionBy("f.project", "slug").orderBy("own"))
    return found.withColumn("_turn", turn).withColumn("n", F.when((F.col("n") > 0) & (F.col("_turn") > 1), F.lit(0)).otherwise(F.col("n"))).drop("_turn")


def archive_name(slug: Column, taken: Column) -> Column:
    """A name that isn't in ``taken`` (numbers in use: 1 for the slug itself, n for ``-n``): the slug, or the first free number."""
    n = F.get(F.filter(F.sequence(F.lit(1), F.size(taken) + 1), lambda k: ~F.array_contains(taken, k)), F.lit(0))
    return F.when(n == 1, slug).otherwise(F.concat(F.regexp_replace(slug, r"\.md$", ""), F.lit("-"), n.cast("string"), F.lit(".md")))


def retire(store: DataFrame, orders: DataFrame, day: str) -> DataFrame:
    """(own, slug, outcome, project, archived, content, target) of orders (own, slug, reason, successor).

    outcome: retired; missing (no such live fact in the project or the global
    store); ambiguous (in both).  ``archived`` is a file name that the project's
    archive doesn't hold, ``target`` that of the log row.  Repeated orders count once.
    """
    live, old = store.filter("archived is null"), store.filter("archived is not null")
    found = _resolved(orders, live, "slug").select("own", "slug", "n", F.col("f.project").alias("project"), F.col("f.content").alias("content"), "reason", "successor")
    # A name in the archive is in use as itself, and as a number of the name it extends.
    number = F.regexp_extract("archived", r"^(.*)-([1-9]\d{0,8})\.md$", 2)
    stem = F.regexp_extract("archived", r"^(.*)-([1-9]\d{0,8})\.md$", 1)
    uses = F.array(F.struct(F.col("archived").alias("slug"), F.lit(1).alias("k")), F.struct(F.concat(stem, F.lit(".md")).alias("slug"), F.coalesce(number.try_cast("int"), F.lit(0)).alias("k")))
    taken = old.select("project", F.inline(uses)).filter("k > 1 or (k = 1 and slug is not null)").groupBy("project", "slug").agg(F.collect_set("k").alias("taken"))
    found = found.join(taken, ["project", "slug"], "left")
    ok = F.col("n") == 1
    target = F.concat(
        qualified(F.col("project"), F.col("slug")),
        F.when(_given(F.col("successor")), F.concat(F.lit(">"), joined(F.col("successor")))).otherwise(""),
        F.when(_given(F.col("reason")), F.concat(F.lit(":"), joined(F.col("reason")))).otherwise(""),
    )
    return found.select(
        "own", "slug", F.when(ok, "retired").when(F.col("n") == 0, "missing").otherwise("ambiguous").alias("outcome"),
        F.when(ok, F.col("project")).alias("project"), F.when(ok, archive_name(F.col("slug"), F.coalesce("taken", F.array().cast("array<int>")))).alias("archived"),
        F.when(ok, stamped(F.col("content"), day, F.col("reason"), F.col("successor"))).alias("content"), F.when(ok, sanitize(target)).alias("target"),
    )


def revive(store: DataFrame, orders: DataFrame) -> DataFrame:
    """(own, slug, outcome, project, content, target) of orders (own, slug).

    outcome: revived; missing (no such name in the archives of the project and
    the global store; the project's comes first); taken (a live fact of that name is in its place).
    """
    found = _resolved(orders, store.filter("archived is not null"), "archived").select("own", "slug", "n", F.col("f.project").alias("project"), F.col("f.content").alias("content"))
    live = store.filter("archived is null").select("project", "slug", F.lit(True).alias("_live")).distinct()
    found = found.join(live, ["project", "slug"], "left")
    ok = (F.col("n") > 0) & F.col("_live").isNull()
    return found.select(
        "own", "slug", F.when(F.col("n") == 0, "missing").when(F.col("_live"), "taken").otherwise("revived").alias("outcome"),
        F.when(ok, F.col("project")).alias("project"), F.when(ok, unstamped(F.col("content"))).alias("content"), F.when(ok, sanitize(qualified(F.col("project"), F.col("slug")))).alias("target"),
    )


def ablation_events(orders: DataFrame, day: str, session: str = "cli", start: bool = True) -> DataFrame:
    """Log rows of ablations that start (project, slug, n: sessions, null for the default) or stop by hand."""
    n = F.coalesce(F.when(F.col("n") > 0, F.col("n")), F.lit(DEFAULT_HOLDOUT)).cast("string") if start else F.lit("manual")
    target = F.concat(qualified(F.col("project"), F.col("slug")), F.lit(":"), n)
    return orders.select(F.lit(day).alias("date"), F.lit("ablate-start" if start else "ablate-stop").alias("event"), sanitize(target).alias("target"), F.lit(session).alias("session"))


def events(done: DataFrame, event: str, day: str, session: str = "cli") -> DataFrame:
    """Log rows of the orders that were carried out."""
    return done.filter("target is not null").select(F.lit(day).alias("date"), F.lit(event).alias("event"), "target", F.lit(session).alias("session"))


def changes(store: DataFrame, done: DataFrame, event: str) -> DataFrame:
    """Rows of the store (keys project, slug, archived) that orders change, and ``deleted``."""
    moved = done.filter("target is not null")
    if event == "retire":
        gone = moved.select("project", "slug", F.lit(None).cast("string").alias("archived"))
        new = moved.select("project", "slug", "archived", "content")
    else:
        gone = moved.select("project", F.col("slug").alias("archived")).join(store.filter("archived is not null").select("project", "slug", "archived"), ["project", "archived"]).select("project", "slug", "archived")
        new = moved.select("project", "slug", F.lit(None).cast("string").alias("archived"), "content")
    gone = gone.select("*", F.lit(None).cast("string").alias("content"), F.lit(True).alias("deleted"))
    return gone.unionByName(new.withColumn("deleted", F.lit(False)))


def carry_out(spark: SparkSession, path: str, event: str, orders: DataFrame, batch: str, day: str, session: str = "cli") -> DataFrame:
    """Retire or revive in the versioned store at ``path``; returns the log rows, which are written before the version is published.

    Repeating a batch changes nothing and returns the same rows; ``versions.Conflict`` if another writer was faster.
    """
    where = f"{path}/events/{batch}"
    if not versions.applied(spark, path, batch):
        base = versions.latest(spark, path)
        store = versions.read(spark, path, base)
        done = retire(store, orders, day) if event == "retire" else revive(store, orders)
        events(done, event, day, session).write.mode("overwrite").parquet(where)
        versions.upsert(spark, path, changes(store, done, event), batch, base)
    return spark.read.schema(EVENTS).parquet(where)
