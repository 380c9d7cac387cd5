"""The engine's inputs, derived from the test tables by a fixed mapping.

The tables hold no event log; each view here stands for one of the engine's
inputs.  The DuckDB side of the mapping is in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FACT_TYPES, GLOBAL

TODAY = "2024-01-31"
PROJECT = "src3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(value: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), value.cast("int"))


def wal(spark: SparkSession, sf_dir: str, malformed: bool = False, timed: bool = False) -> DataFrame:
    """Event log rows (line_no, date, event, target, session), one per row of ``events``.

    With ``malformed``, a few rows break one rule of the line format each; with
    ``timed``, rows have their time (ts) too.
    """
    owner = table(spark, sf_dir, "documents").filter("doc_id < 25").select(F.col("doc_id").alias("k"), "source")
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        (F.get_json_object("props", "$.k").cast("bigint") % 25).alias("k"),
        (F.col("user_id") % 30).alias("u"),
        (F.col("event_id") % 97).alias("r"),
        "event_type",
        *(["ts"] if timed else []),
    )
    e = e.join(F.broadcast(owner), "k", "left")  # 25 rows at most
    # Parts that the rules share are columns of their own, so that the chain of rules stays small.
    kinds = F.create_map(*[F.lit(x) for p in (("view", "inject"), ("click", "trigger-useful"), ("error", "trigger-silent"), ("purchase", "outcome-positive"), ("signup", "outcome-negative")) for x in p])
    e = e.withColumns({"bare": F.concat(F.lit("k"), "k"), "base_session": F.concat(F.lit("s"), "u", F.lit("-"), "date"), "metrics": F.concat(F.lit("error_count:"), F.col("u") % 4, F.lit(",tool_calls:"), "k", F.lit(",duration:60s"))})
    e = e.withColumns({"base_event": F.when(F.col("u") == 7, "inject").otherwise(kinds[F.col("event_type")]), "qs": F.concat("source", F.lit("\x1f"), "bare")})
    e = e.withColumn("base_target", F.when(F.col("line_no") % 4 != 0, F.concat("qs", F.lit(".md"))).otherwise(F.col("bare")))
    r, u, k = F.col("r"), F.col("u"), F.col("k")
    base_event, base_target, session, bare, qs, metrics = (F.col(c) for c in ("base_event", "base_target", "base_session", "bare", "qs", "metrics"))
    rules = [
        (r == 0, "inject-agg", base_target, (1 + u % 20).cast("string")),
        (r == 1, "recall", base_target, session),
        (r == 2, "retire", F.concat(qs, F.lit(">k"), (k + 1) % 25, F.lit(":superseded")), F.lit("cli")),
        (r == 3, "revive", qs, F.lit("cli")),
        (r == 4, "candidate-confirmed", qs, session),
        (r == 5, "ablate-start", F.concat(qs, F.lit(":"), 2 + u % 4), F.lit("cli")),
        (r == 6, "ablate-stop", F.concat(qs, F.lit(":manual")), F.lit("cli")),
        (r.between(7, 12), "holdout-skip", qs, session),
        (r.between(13, 15), "holdout-hit", qs, session),
        (r == 16, "holdout-miss", qs, session),
        (r == 17, "session-metrics", F.concat(F.lit("domains:d"), u % 5, F.lit(",d"), u % 3, F.lit(","), metrics), session),
        (r == 18, "session-metrics", F.concat(F.lit("d"), u % 5), metrics),
        (r == 19, "session-close", session, session),
        (r == 20, "trigger-silent-retro", base_target, session),
        *[(r == 21 + i, name, bare, session) for i, name in enumerate(("outcome-new", "clean-session", "strategy-used", "strategy-gap", "evidence-empty", "schema-error"))],
        (r == 27, "mystery-event", base_target, session),
    ]
    if malformed:
        rules += [
            (r == 28, base_event, base_target, F.concat(session, F.lit("|x"))),
            (r == 30, "Bad Event", base_target, session),
            (r == 31, base_event, base_target, F.lit("")),
        ]

    def chained(part: int, otherwise: Column) -> Column:
        out = F
        for rule in rules:
            value = rule[part]
            out = out.when(rule[0], value if isinstance(value, Column) else F.lit(value))
        return out.otherwise(otherwise)

    date = F.when(r == 29, F.lit("2024/01/02")).otherwise(F.col("date")) if malformed else F.col("date")
    # inline() makes the results plain columns, so that later expressions don't repeat the chains.
    row = F.struct(chained(1, base_event).alias("event"), chained(2, base_target).alias("target"), chained(3, session).alias("session"))
    return e.select("line_no", date.alias("date"), *(["ts"] if timed else []), F.inline(F.array(row)))


def wal_lines(spark: SparkSession, sf_dir: str, malformed: bool = False) -> DataFrame:
    """(line_no, value): the log as raw lines."""
    return wal(spark, sf_dir, malformed).select("line_no", F.concat_ws("|", "date", "event", "target", "session").alias("value"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows from ``documents``."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("k"), d, F.lit(".md")).alias("slug"),
        F.col("source").alias("project"),
        F.substring("text", 1, 40).alias("name"),
        F.substring("text", 41, 160).alias("description"),
        F.element_at(F.array(*[F.lit(t) for t in FACT_TYPES]), (d % 9 + 1).cast("int")).alias("type"),
        F.date_format(F.date_sub(F.lit("2024-01-01").cast("date"), (d % 120).cast("int")), "yyyy-MM-dd").alias("created"),
        F.when(d % 10 == 0, "pinned").when(d % 10 == 1, "candidate").otherwise("active").alias("status"),
        F.array(F.concat(F.lit("kw"), d % 13)).alias("keywords"),
        F.array("lang").alias("domains"),
        F.array(F.substring("text", 1, 12)).alias("evidence"),
        F.when(d % 3 == 0, "spark").otherwise("sql").alias("skill"),
        F.when(d % 7 == 0, "ambient").otherwise("").alias("precision_class"),
        (d % 4).alias("recurrence"),
        (d % 5).alias("success_count"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_sha"),
        F.col("text").alias("body"),
        d.alias("doc_id"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, project): ranking requests from ``benchmark``, dealt to the projects; every twentieth has no facts of its own."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), F.col("item_id") % 20).alias("project"))


def with_global(facts: DataFrame) -> DataFrame:
    """Facts of project src0 are those of the global store."""
    return facts.withColumn("project", F.when(F.col("project") == "src0", GLOBAL).otherwise(F.col("project")))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, line_no, value): session transcripts as JSON lines, from ``conversations``."""
    c = table(spark, sf_dir, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(False).alias("is_error"))
    tool = F.struct(F.when(F.col("role") == "assistant", "tool_use").otherwise("tool_result").alias("type"), F.lit(None).cast("string").alias("text"), (F.col("turn") % 3 == 0).alias("is_error"))
    content = F.when(F.col("turn") % 2 == 0, F.array(block, tool)).otherwise(F.array(block))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), stamp.alias("timestamp"), F.struct(content.alias("content")).alias("message")))
    return c.select(F.concat(F.lit("c"), "conv_id").alias("session"), F.col("turn").alias("line_no"), line.alias("value"))
