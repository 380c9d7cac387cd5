"""The event log: parsing, validation, keys and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_HOLDOUT, SEPARATOR, TAIL_BYTES


def scan(lines: DataFrame) -> DataFrame:
    """(line_no, date, event, target, session) of well-formed lines (line_no, value); blank, ``#`` and short lines are left out."""
    value = F.regexp_replace("value", "\r$", "")
    parts = lines.select("line_no", value.alias("v")).filter("v <> '' and not startswith(v, '#')").select("line_no", F.split("v", r"\|", 4).alias("p"))
    return parts.filter(F.size("p") == 4).select("line_no", *[F.col("p")[i].alias(n) for i, n in enumerate(("date", "event", "target", "session"))])


def validate(lines: DataFrame) -> DataFrame:
    """(line_no, reason) of every non-blank line; reason is null for sound lines, else the first rule it breaks."""
    v = F.col("value")
    parts = F.split(v, r"\|", -1)
    reason = (
        F.when(F.size(parts) != 4, "columns")
        .when(~parts[0].rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(~parts[1].rlike("^[a-z][a-z0-9-]*$"), "event")
        .when(parts[2].contains("\r"), "target")
        .when(parts[3] == "", "session")
    )
    header = (F.col("line_no") == F.lit(1)) & v.rlike(r"^#|^date\|")
    return lines.filter(F.trim(v) != "").filter(~header).select("line_no", reason.alias("reason"))


def validate_report(lines: DataFrame) -> DataFrame:
    """(reason, n): lines by reason, ``ok`` for sound ones."""
    return validate(lines).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def bare(target: Column, trim: Column | None = None) -> Column:
    """The slug without project, ``.md`` and, where ``trim``, what follows ``>`` or ``:``."""
    rest = F.when(target.contains(SEPARATOR), F.substring_index(target, SEPARATOR, -1)).otherwise(target)
    cut = F.regexp_extract(rest, "^[^>:]*", 0)
    rest = cut if trim is None else F.when(trim, cut).otherwise(rest)
    return F.regexp_replace(rest, r"\.md$", "")


def keyed(wal: DataFrame, trim_all: bool = False) -> DataFrame:
    """The log with project (null if bare), slug (bare) and key (qualified where a project is given).

    Tails are cut off lifecycle events, or with ``trim_all`` off all events.
    """
    target = F.col("target")
    project = F.when(target.contains(SEPARATOR), F.substring_index(target, SEPARATOR, 1))
    slug = bare(target, None if trim_all else F.col("event").isin("retire", "revive", "ablate-start", "ablate-stop"))
    return wal.withColumns({"project": project, "slug": slug}).withColumn("key", F.when(F.col("project").isNotNull(), F.concat("project", F.lit(SEPARATOR), "slug")).otherwise(F.col("slug")))


def session_verdicts(log: DataFrame, retro: bool = True) -> DataFrame:
    """(key, session, useful): one verdict for each pair; useful beats silent. ``retro`` counts late silent events too."""
    silent = ("trigger-silent", "trigger-silent-retro") if retro else ("trigger-silent",)
    hits = log.filter(F.col("event").isin("trigger-useful", *silent))
    return hits.groupBy("key", "session").agg(F.max(F.col("event") == "trigger-useful").alias("useful"), F.min("line_no").alias("first_line"))


def number(text: Column) -> Column:
    """A decimal integer as the log's reader takes it (optional sign and digits only), else null."""
    return F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("bigint"))


def aggregates(log: DataFrame) -> DataFrame:
    """Per key: injects, pos, neg (outcome events), created, last_inject, confirmed, retired."""
    is_ = lambda *names: F.col("event").isin(*names)
    n = number(F.col("session"))
    amount = F.when(is_("inject", "recall"), 1).when(is_("inject-agg"), F.when(n >= 1, n).otherwise(1)).otherwise(0)
    last = F.max_by(F.when(is_("retire", "revive"), F.col("event")), F.when(is_("retire", "revive"), F.col("line_no")))
    return log.groupBy("key").agg(
        F.sum(amount).cast("bigint").alias("injects"),
        F.count_if(is_("outcome-positive")).alias("pos"),
        F.count_if(is_("outcome-negative")).alias("neg"),
        F.min("date").alias("created"),
        F.max(F.when(is_("inject", "recall", "inject-agg"), F.col("date"))).alias("last_inject"),
        F.max(is_("candidate-confirmed")).alias("confirmed"),
        F.coalesce(last == "retire", F.lit(False)).alias("retired"),
    )


def lifecycle(log: DataFrame) -> DataFrame:
    """(key, retired) of the keys with a lifecycle event: retired if the last of retire and revive is retire."""
    events = log.filter(F.col("event").isin("retire", "revive"))
    return events.groupBy("key").agg((F.max_by("event", "line_no") == "retire").alias("retired"))


def holdouts(log: DataFrame) -> DataFrame:
    """Per key with an ablation: n (sessions asked for by the latest start), stopped, and (key, session) skips counted as used.

    Skips count after the latest start and before the first stop that follows it.
    """
    w = Window.partitionBy("key")
    events = log.filter(F.col("event").isin("ablate-start", "ablate-stop", "holdout-skip"))
    start = F.max(F.when(F.col("event") == "ablate-start", F.col("line_no"))).over(w)
    rows = events.withColumn("start", start).filter("line_no >= start")
    stop = F.min(F.when(F.col("event") == "ablate-stop", F.col("line_no"))).over(w)
    rows = rows.withColumn("stop", stop)
    asked = number(F.regexp_extract("target", r":([^:]*)$", 1))
    used = (F.col("event") == "holdout-skip") & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    return rows.groupBy("key").agg(
        F.max(F.when(F.col("event") == "ablate-start", F.when(asked > 0, asked).otherwise(DEFAULT_HOLDOUT))).alias("n"),
        F.max(F.col("stop").isNotNull()).alias("stopped"),
        F.collect_set(F.when(used, F.col("session"))).alias("skips"),
    )


def holdout_remaining(log: DataFrame) -> DataFrame:
    """(key, remaining): sessions of the latest ablation that are still to come; 0 once stopped."""
    left = F.when(F.col("stopped"), F.lit(0)).otherwise(F.greatest(F.col("n") - F.size("skips"), F.lit(0)))
    return holdouts(log).select("key", left.cast("bigint").alias("remaining"))


def tail(lines: DataFrame, size: int = TAIL_BYTES) -> DataFrame:
    """(line_no, value): whole lines among the last ``size`` bytes of a log (line_no, value).

    If the log is longer, the first line of the stretch is left out, as it may
    be a part of one.  A line has a byte at least, so no more than ``size`` lines are looked at.
    """
    total = lines.agg(F.sum(F.octet_length("value") + 1).alias("total"))
    last = lines.orderBy(F.desc("line_no")).limit(size)
    w = Window.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    placed = last.withColumn("so_far", F.sum(F.octet_length("value") + 1).over(w)).join(F.broadcast(total), F.lit(True))
    return placed.filter((F.col("total") <= size) | (F.col("so_far") < size)).select("line_no", "value")


def append_probe(new: DataFrame, lines: DataFrame, size: int = TAIL_BYTES) -> DataFrame:
    """``new`` with ``fresh``: no line of the log's tail contains its ``key``; a null key is always fresh, an empty one never unless the tail is empty.

    The tail is one row of at most ``size`` bytes; keys hold no line end, so looking in the joined lines is looking in each.
    """
    joined = tail(lines, size).agg(F.array_join(F.collect_list("value"), "\n").alias("_tail"), F.count("*").alias("_n"))
    seen = (F.col("_n") > 0) & F.col("_tail").contains(F.col("key"))
    return new.join(F.broadcast(joined), F.lit(True)).withColumn("fresh", ~F.coalesce(seen, F.lit(False))).drop("_tail", "_n")


def append_dedup(new: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of ``new`` whose date, event, target and session aren't in ``log`` yet, each once."""
    columns = ["date", "event", "target", "session"]
    return new.select(columns).distinct().join(log.select(columns), columns, "left_anti")
