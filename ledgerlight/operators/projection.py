"""The projection: one row per fact, folded from the log, and the keyword index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..schema import DECAY_DAYS, DECAY_DEFAULT, DECAY_EXEMPT, SEPARATOR
from . import log as L


def effectiveness(pos: Column, neg: Column) -> Column:
    return (pos + 1) / (pos + neg + 2)


def fact_key(project: Column, slug: Column) -> Column:
    return F.concat(project, F.lit(SEPARATOR), F.regexp_replace(slug, r"\.md$", ""))


def _both_keys(facts: DataFrame) -> DataFrame:
    """One row per fact and key its history may stand under: qualified (rank 0) and bare (rank 1)."""
    q, b = fact_key(F.col("project"), F.col("slug")), F.regexp_replace("slug", r"\.md$", "")
    return facts.select("project", "slug", F.posexplode(F.array(q, b)).alias("key_rank", "key"))


def fact_history(facts: DataFrame, wal: DataFrame) -> DataFrame:
    """Per fact (project, slug): the merged history of both keys.

    Counters add, session verdicts unite with useful winning, flags are or-ed,
    the holdout size is the qualified key's if it has one.
    """
    log = L.keyed(wal)
    keys = _both_keys(facts)
    who = ["project", "slug"]
    sums = keys.join(L.aggregates(log), "key").groupBy(who).agg(
        F.sum("injects").alias("injects"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("created").alias("first_seen"),
        F.max("last_inject").alias("last_inject"), F.max("confirmed").alias("confirmed"), F.max("retired").alias("retired"),
    )
    verdicts = keys.join(L.session_verdicts(log), "key").groupBy(*who, "session").agg(F.max("useful").alias("useful"))
    verdicts = verdicts.groupBy(who).agg(F.count_if("useful").alias("useful"), F.count_if(~F.col("useful")).alias("silent"))
    held = keys.join(L.holdouts(log), "key").groupBy(who).agg(
        F.min_by("n", "key_rank").alias("n"), F.max("stopped").alias("stopped"), F.size(F.array_distinct(F.flatten(F.collect_list("skips")))).alias("used")
    )
    left = F.when(F.col("stopped"), 0).otherwise(F.greatest(F.col("n") - F.col("used"), F.lit(0)))
    held = held.select(*who, left.cast("bigint").alias("holdout_remaining"))
    return facts.select(who).distinct().join(sums, who, "left").join(verdicts, who, "left").join(held, who, "left")


def reproject(facts: DataFrame, wal: DataFrame) -> DataFrame:
    """The projection's row of every live fact."""
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    h = facts.join(fact_history(facts, wal), ["project", "slug"], "left")
    pos = F.coalesce("pos", zero) + F.coalesce("useful", zero)
    neg = F.when(F.col("precision_class") == "ambient", zero).otherwise(F.coalesce("neg", zero) + F.coalesce("silent", zero))
    graduated = F.coalesce("confirmed", no) | (pos > 0)
    status = F.when(F.col("status") == "pinned", "pinned").when((F.col("status") == "candidate") & ~graduated, "candidate").otherwise("active")
    return h.select(
        "slug", "content_sha", "type", "name", "description", "project", "domains",
        F.coalesce(F.when(F.col("created") != "", F.col("created")), F.col("first_seen")).alias("created"),
        F.col("last_inject").alias("last_injected"),
        F.coalesce("injects", zero).alias("ref_count"),
        status.alias("status"),
        effectiveness(pos, neg).alias("effectiveness"),
        F.coalesce("holdout_remaining", zero).alias("holdout_remaining"),
    )


def graduation(facts: DataFrame, wal: DataFrame) -> DataFrame:
    """(project, slug, graduated): confirmed, or positive at least once."""
    h = fact_history(facts, wal)
    zero = F.lit(0).cast("bigint")
    return h.select("project", "slug", (F.coalesce("confirmed", F.lit(False)) | (F.coalesce("pos", zero) + F.coalesce("useful", zero) > 0)).alias("graduated"))


def reconcile(projection: DataFrame, facts: DataFrame, wal: DataFrame, scope: list[str]) -> DataFrame:
    """(project, slug, status) after comparing a stored projection with the live files.

    Live facts keep their fresh status.  Rows of vanished files inside the
    scope become retired (if their history says so) or deleted; retired keys
    that were never stored are added; rows outside the scope stay.
    """
    live = reproject(facts, wal).select("project", "slug", F.col("status").alias("live_status"))
    in_scope = facts.select("project").distinct().union(projection.sparkSession.createDataFrame([(p,) for p in scope], "project string")).distinct().withColumn("inside", F.lit(True))
    history = L.keyed(wal)
    gone = L.lifecycle(history).filter("retired").select("key")
    named = history.filter("project is not null").select("key", "project", F.concat("slug", F.lit(".md")).alias("slug")).distinct().join(gone, "key", "left_semi").select("project", "slug")
    stored = projection.select("project", "slug", F.col("status").alias("old_status"))
    rows = stored.join(live, ["project", "slug"], "full_outer").join(named.withColumn("added", F.lit(True)), ["project", "slug"], "full_outer")
    rows = rows.join(F.broadcast(in_scope), "project", "left")
    bare_gone = gone.select(F.concat("key", F.lit(".md")).alias("slug"), F.lit(True).alias("bare_retired"))
    rows = rows.join(bare_gone, "slug", "left")
    inside = F.coalesce("inside", F.lit(False))
    status = (
        F.when(F.col("live_status").isNotNull(), F.col("live_status"))
        .when(inside & F.col("added"), "retired")
        .when(~inside | F.col("old_status").isin("deleted", "retired"), F.col("old_status"))
        .when(F.coalesce("bare_retired", F.lit(False)), "retired")
        .otherwise("deleted")
    )
    return rows.select("project", "slug", status.alias("status")).filter("status is not null")


def keyword_tf(facts: DataFrame) -> DataFrame:
    """(slug, project, term, weight): how often each term occurs in a fact's texts."""
    text = F.concat_ws(" ", "name", "description", F.array_join("keywords", " "), F.array_join("domains", " "), "body")
    return facts.select("slug", "project", F.explode(tokenize(text)).alias("term")).groupBy("slug", "project", "term").agg(F.count("*").cast("double").alias("weight"))


def stale_hits(projection: DataFrame, today: str) -> DataFrame:
    """Active rows that have not been used for longer than their type allows."""
    base = F.coalesce(F.try_to_date("last_injected", "yyyy-MM-dd"), F.try_to_date("created", "yyyy-MM-dd"))
    limit = F.coalesce(F.create_map(*[F.lit(x) for p in DECAY_DAYS.items() for x in p])[F.col("type")], F.lit(DECAY_DEFAULT))
    return projection.filter((F.col("status") == "active") & ~F.col("type").isin(*DECAY_EXEMPT) & (F.date_diff(F.lit(today).cast("date"), base) > limit))


def mark_stale(projection: DataFrame, today: str, strict_keys: bool = False) -> DataFrame:
    """The projection with stale rows marked; by slug alone unless ``strict_keys``, so that a namesake goes stale too."""
    key = ["slug", "project"] if strict_keys else ["slug"]
    hits = stale_hits(projection, today).select(key).distinct().withColumn("_hit", F.lit(True))
    status = F.when((F.col("status") == "active") & F.col("_hit"), "stale").otherwise(F.col("status"))
    return projection.join(hits, key, "left").withColumn("status", status).drop("_hit")
