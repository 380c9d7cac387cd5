"""What time does to sessions: facts whose session never closed, and lists that are dropped unless written again.

Rows are log rows with a time (``ts``).  ``streaming.sessions`` gives the same rows as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CLOSING_EVENTS

HOUR = 3_600_000
#: Milliseconds after which a delivered fact of an unclosed session is silent, and after which a list of each kind is dropped.
CLOSE_WITHIN = 24 * HOUR
LIST_LIVES = {"injected": 7 * 24 * HOUR, "holdout": 7 * 24 * HOUR, "skill": 24 * HOUR}
#: Events that write to a list of a kind.
LIST_EVENTS = {"injected": ("inject", "recall"), "holdout": ("holdout-skip",), "skill": ("strategy-used",)}


def millis(ts: str = "ts") -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def day_of(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def retro_silent(log: DataFrame, now: Column) -> DataFrame:
    """(date, event, target, session): one late silent verdict for each fact injected into a session that then didn't close.

    A session counts as closed for a fact if it has a closing event up to 24
    hours after the fact's first inject; the verdict falls due at that time, and
    is given if that isn't after ``now``.  Rows without session or time are left out.
    """
    rows = log.filter("session is not null and ts is not null").withColumn("ms", millis())
    first = rows.filter("event = 'inject'").groupBy("session", "target").agg((F.min("ms") + CLOSE_WITHIN).alias("due")).filter(F.col("due") <= F.unix_millis(now.cast("timestamp")))
    closed = rows.filter(F.col("event").isin(*CLOSING_EVENTS)).groupBy("session").agg(F.min("ms").alias("closed"))
    late = first.join(closed, "session", "left").filter("closed is null or closed > due")
    return late.select(day_of(F.col("due")).alias("date"), F.lit("trigger-silent-retro").alias("event"), "target", "session")


def list_entries(log: DataFrame) -> DataFrame:
    """(session, kind, slug, ms): writes to a session's lists."""
    kind = F.lit(None).cast("string")
    for k, events in LIST_EVENTS.items():
        kind = F.when(F.col("event").isin(*events), k).otherwise(kind)
    # Tied to the time, so that in a stream no row is filtered before it has moved the watermark.
    kind = F.when(F.col("ts").isNotNull() & F.col("session").isNotNull(), kind)
    return log.select("session", kind.alias("kind"), F.col("target").alias("slug"), millis().alias("ms")).filter("kind is not null")


def lifetime(kind: Column) -> Column:
    out = F.lit(None).cast("long")
    for k, ms in LIST_LIVES.items():
        out = F.when(kind == k, F.lit(ms)).otherwise(out)
    return out


def list_lives(entries: DataFrame, now: Column) -> DataFrame:
    """(session, kind, last, slugs, live): every life of every list.

    A list is dropped when nothing was written to it for longer than its kind's
    time; what is written later starts a new one.  ``live`` tells whether the
    list is still there at ``now``; entries after ``now`` are left out.  Entries are
    reduced to one row per list, day and slug first, so a busy list is a row a day in the window.
    """
    until = F.unix_millis(now.cast("timestamp"))
    rows = entries.filter(F.col("ms") <= until).withColumn("day", F.floor(F.col("ms") / (24 * HOUR)))
    daily = rows.groupBy("session", "kind", "day", "slug").agg(F.min("ms").alias("low"), F.max("ms").alias("high"))
    days = daily.groupBy("session", "kind", "day").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("session", "kind").orderBy("day")
    # Lives are longer than a day at least, so a list ends between days only.
    ended = F.col("low") - F.lag("high").over(order) > lifetime(F.col("kind"))
    days = days.withColumn("ended", F.coalesce(ended, F.lit(False)).cast("int")).withColumn("life", F.sum("ended").over(order))
    lives = daily.join(days.select("session", "kind", "day", "life"), ["session", "kind", "day"]).groupBy("session", "kind", "life").agg(F.max("high").alias("last"), F.array_sort(F.collect_set("slug")).alias("slugs"))
    return lives.select("session", "kind", "last", "slugs", (until - F.col("last") <= lifetime(F.col("kind"))).alias("live"))
