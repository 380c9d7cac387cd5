"""Profiles, health checks, promotion and ablation reports, offline replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import (
    CLOSING_EVENTS, DEFAULT_HOLDOUT, ERROR_EVENTS, HIT_RATE, INTUITION_DAYS, LOW_RATE, MIN_RECURRENCE, OPEN_WARN, OUTCOME_DAYS, SILENT_LIMIT, STREAK, W_EFFECT, W_RECENCY, W_USE,
)
from . import log as L
from .ranking import gate, recency


def cutoff(today: str, days: int) -> Column:
    return F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")


# --- profile -----------------------------------------------------------------


def session_metrics(wal: DataFrame) -> DataFrame:
    """(line_no, session, domains, error_count) of metrics rows in either form: ``domains:...`` in the target, or the blob in the session column."""
    rows = wal.filter("event = 'session-metrics'")
    new = F.col("target").startswith("domains:")
    rest = F.substring("target", 9, 1 << 20)
    domains = F.when(new, F.regexp_replace(rest, r",[A-Za-z0-9_]+:.*$", "")).otherwise(F.col("target"))
    blob = F.when(new, rest).otherwise(F.col("session"))
    errors = F.coalesce(F.regexp_extract(blob, r"error_count:(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return rows.select("line_no", "session", domains.alias("domains"), errors.alias("error_count"))


def calibration(wal: DataFrame, k: int = 5) -> DataFrame:
    """(domain, sessions, errors, rate): the k domains with most errors a session."""
    rows = session_metrics(wal).select(F.explode(F.split("domains", ",")).alias("domain"), "error_count").filter("domain not in ('', 'unknown')")
    by = rows.groupBy("domain").agg(F.count("*").alias("sessions"), F.sum("error_count").alias("errors"))
    return by.withColumn("rate", F.col("errors") / F.col("sessions")).orderBy(F.desc("rate"), "domain").limit(k)


def profile_triggers(wal: DataFrame, ambient: DataFrame, today: str, days: int = INTUITION_DAYS) -> DataFrame:
    """Per (raw target without .md, session) with a verdict: ambient, useful, and both within the recent window."""
    recent = F.col("date") >= cutoff(today, days)
    rows = wal.filter(F.col("event").isin("trigger-useful", "trigger-silent")).withColumn("bare", F.regexp_replace("target", r"\.md$", ""))
    useful = F.col("event") == "trigger-useful"
    g = rows.groupBy("bare", "session").agg(F.max(useful).alias("useful"), F.max(useful & recent).alias("useful_recent"), F.max(~useful & recent).alias("silent_recent"))
    return g.join(ambient.select("bare").distinct().withColumn("ambient", F.lit(True)), "bare", "left").fillna(False, ["ambient"])


def profile_signals(wal: DataFrame, facts: DataFrame, today: str) -> DataFrame:
    """One row of counters over the log; ``precision_pct`` and ``intuition`` are null where undefined.

    Targets are taken as written, so qualified events meet no bare outcome and
    no ambient fact, as in the engine that wrote such logs.
    """
    ambient = facts.filter("precision_class = 'ambient'").select(F.regexp_replace("slug", r"\.md$", "").alias("bare"))
    is_ = lambda n: F.count_if(F.col("event") == n)
    counts = wal.agg(
        F.count_distinct(F.when(F.col("event") == "session-metrics", F.col("session"))).alias("sessions"),
        is_("clean-session").alias("clean"), is_("outcome-positive").alias("positive"), is_("outcome-negative").alias("negative"),
        is_("strategy-used").alias("strategy_used"), is_("strategy-gap").alias("strategy_gap"), is_("outcome-new").alias("outcome_new"),
        F.count_distinct(F.when(F.col("event") == "evidence-empty", F.col("target"))).alias("evidence_empty"),
    )
    positive = wal.filter("event = 'outcome-positive'").select(F.regexp_replace("target", r"\.md$", "").alias("bare"), "session").distinct().withColumn("applied", F.lit(True))
    t = profile_triggers(wal, ambient, today).join(positive, ["bare", "session"], "left").fillna(False, ["applied"])
    measured, useful, applied = ~F.col("ambient"), F.col("useful"), F.col("applied")
    sums = t.agg(
        F.count_if("ambient").alias("ambient"),
        F.count_if(measured & useful).alias("useful"),
        F.count_if(measured & ~useful).alias("silent"),
        F.count_if(measured & ~useful & applied).alias("silent_applied"),
        F.count_if(measured & useful & F.col("useful_recent")).alias("_ur"),
        F.count_if(measured & ~useful & applied & F.col("silent_recent")).alias("_sr"),
    )
    both = counts.join(F.broadcast(sums), F.lit(True))  # one row each
    total = F.col("useful") + F.col("silent")
    ratio = F.try_divide(F.col("_sr"), F.col("_ur"))
    band = F.when(ratio.isNull(), "n/a").when(ratio >= 1.0, "high").when(ratio >= 0.6, "good").when(ratio >= 0.2, "some").otherwise("low")
    return both.select(
        "sessions", "clean", "positive", "negative", "strategy_used", "strategy_gap", "outcome_new", "evidence_empty", "ambient", "useful", "silent", "silent_applied",
        (F.col("silent") - F.col("silent_applied")).alias("silent_noise"),
        F.bround(F.try_divide((F.col("useful") + F.col("silent_applied")) * 100.0, total), 0).alias("precision_pct"),
        ratio.alias("intuition"), band.alias("intuition_band"),
    )


def profile_fractions(wal: DataFrame, facts: DataFrame, today: str, days: int = OUTCOME_DAYS, least: int = 5) -> DataFrame:
    """One row: the ambient share of the facts, and the share with at least ``least`` outcomes in the window (looked up by bare slug)."""
    recent = wal.filter(F.col("event").isin("outcome-positive", "outcome-negative") & (F.col("date") >= cutoff(today, days)))
    per = recent.groupBy(F.col("target").alias("bare")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    rows = facts.withColumn("bare", F.regexp_replace("slug", r"\.md$", "")).join(per, "bare", "left")
    return rows.agg(
        F.try_divide(F.count_if(F.col("precision_class") == "ambient"), F.count("*")).alias("ambient_fraction"),
        F.try_divide(F.count_if(F.col("n").isNotNull()), F.count("*")).alias("bayesian_fraction"),
    )


def weaknesses(facts: DataFrame, k: int = 5) -> DataFrame:
    return facts.filter("type = 'mistake' and recurrence > 0").select("slug", "project", "recurrence").orderBy(F.desc("recurrence"), "slug").limit(k)


def strengths(facts: DataFrame, k: int = 5) -> DataFrame:
    return facts.filter("type = 'strategy'").select("slug", "project", "success_count").orderBy(F.desc("success_count"), "slug").limit(k)


# --- health ------------------------------------------------------------------


def open_quanta(wal: DataFrame, today: str, days: int = 30) -> DataFrame:
    """One row: sessions with injects in the window, those that never closed, their injects, and the status."""
    rows = wal.filter(F.col("date") >= cutoff(today, days))
    injects = rows.filter("event = 'inject'").groupBy("session").agg(F.count("*").alias("n"))
    closed = rows.filter(F.col("event").isin(*CLOSING_EVENTS)).select("session").distinct().withColumn("c", F.lit(True))
    g = injects.join(closed, "session", "left").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("c").isNull()).alias("open"), F.coalesce(F.sum(F.when(F.col("c").isNull(), F.col("n"))), F.lit(0)).alias("lost_injects")
    )
    return g.withColumn("status", F.when(F.coalesce(F.try_divide(F.col("open"), F.col("sessions")), F.lit(0.0)) >= OPEN_WARN, "WARN").otherwise("OK"))


def wal_errors(wal: DataFrame, today: str, days: int = 7) -> DataFrame:
    return wal.filter(F.col("event").isin(*ERROR_EVENTS) & (F.col("date") >= cutoff(today, days))).groupBy("event").agg(F.count("*").alias("n"))


def corpus_counts(facts: DataFrame, projection: DataFrame) -> DataFrame:
    """(type, n, pinned, stale): facts by type, with the status of the projection's row of the slug (the last by project)."""
    status = projection.filter("status <> 'deleted'").groupBy("slug").agg(F.max_by("status", "project").alias("now"))
    kind = F.when(F.coalesce("type", F.lit("")) == "", "untyped").otherwise(F.col("type"))
    rows = facts.select("slug", kind.alias("type")).join(status, "slug", "left")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("now") == "pinned").alias("pinned"), F.count_if(F.col("now") == "stale").alias("stale"))


def _fallback(facts: DataFrame, history: DataFrame) -> DataFrame:
    """Facts joined to ``history`` by the qualified key or, where that has none, by the bare one."""
    columns = [c for c in history.columns if c != "key"]
    packed = history.select("key", F.struct(*columns).alias("h"))
    f = facts.withColumn("_b", F.regexp_replace("slug", r"\.md$", "")).withColumn("_q", F.concat("project", F.lit("\x1f"), "_b"))
    f = f.join(packed.select(F.col("key").alias("_q"), F.col("h").alias("hq")), "_q", "left").join(packed.select(F.col("key").alias("_b"), F.col("h").alias("hb")), "_b", "left")
    f = f.withColumn("h", F.coalesce("hq", "hb"))
    return f.select(*facts.columns, *[F.col(f"h.{c}").alias(c) for c in columns])


def candidate_check(facts: DataFrame, wal: DataFrame) -> DataFrame:
    """(slug, project, silent): candidates with enough silent sessions, none useful, never confirmed."""
    log = L.keyed(wal, trim_all=False)
    pick = lambda e: F.count_distinct(F.when(F.col("event") == e, F.col("session")))
    h = log.groupBy("key").agg(pick("trigger-useful").alias("n_useful"), pick("trigger-silent").alias("n_silent"), F.max(F.col("event") == "candidate-confirmed").alias("was_confirmed"))
    rows = _fallback(facts.filter("status = 'candidate'").select("slug", "project"), h)
    return rows.filter((F.col("n_useful") == 0) & ~F.col("was_confirmed") & (F.col("n_silent") >= SILENT_LIMIT)).select("slug", "project", F.col("n_silent").alias("silent"))


def doctor(facts: DataFrame, projection: DataFrame, wal: DataFrame, today: str) -> DataFrame:
    """(name, status, n): the checks on data, one row each."""
    corpus = facts.agg(F.lit("corpus").alias("name"), F.when(F.count("*") > 0, "OK").otherwise("WARN").alias("status"), F.count("*").alias("n"))
    errors = wal_errors(wal, today).agg(F.lit("wal_errors_7d").alias("name"), F.when(F.coalesce(F.sum("n"), F.lit(0)) > 0, "WARN").otherwise("OK").alias("status"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    quanta = open_quanta(wal, today).select(F.lit("open_quanta_last_30d").alias("name"), "status", F.col("open").alias("n"))
    flagged = candidate_check(facts, wal).agg(F.lit("candidate_corroboration").alias("name"), F.when(F.count("*") > 0, "WARN").otherwise("OK").alias("status"), F.count("*").alias("n"))
    quality = empty_status(facts).agg(F.lit("frontmatter_quality").alias("name"), F.when(F.count("*") > 0, "WARN").otherwise("OK").alias("status"), F.count("*").alias("n"))
    return corpus.union(errors).union(quanta).union(flagged).union(quality)


def empty_status(facts: DataFrame, column: str = "body") -> DataFrame:
    """(slug, project): files whose first fenced block has a ``status:`` without value."""
    fence = F.regexp_extract(column, r"(?s)\A---\n(.*?\n)---", 1)
    return facts.filter(fence.rlike(r"(?m)^status:[ \t]*$")).select("slug", "project")


# --- promotion and ablation ----------------------------------------------------


def useful_streak(wal: DataFrame, n: int = STREAK) -> DataFrame:
    """(key, streak): whether the last n sessions with a verdict, by first appearance, were all useful."""
    v = L.session_verdicts(L.keyed(wal, trim_all=True), retro=False)
    w = Window.partitionBy("key").orderBy(F.desc("first_line"))
    last = v.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return last.groupBy("key").agg((F.min("useful") & (F.count("*") == n)).alias("streak"))


def ablation_runs(log: DataFrame, key: str = "key") -> DataFrame:
    """Per key with an ablation start: requested, stopped (null, manual or expired), observed (distinct skips) and hits (those also hit), since the latest start."""
    w = Window.partitionBy(key)
    events = log.filter(F.col("event").isin("ablate-start", "ablate-stop", "holdout-skip", "holdout-hit"))
    rows = events.withColumn("_s", F.max(F.when(F.col("event") == "ablate-start", F.col("line_no"))).over(w)).filter("line_no >= _s")
    asked = L.number(F.regexp_extract("target", r":([^:]*)$", 1))
    per = rows.groupBy(key, "session").agg(F.max(F.col("event") == "holdout-skip").alias("skip"), F.max(F.col("event") == "holdout-hit").alias("hit"))
    per = per.groupBy(key).agg(F.count_if("skip").alias("observed"), F.count_if(F.col("skip") & F.col("hit")).alias("hits"))
    stop = F.col("event") == "ablate-stop"
    ends = rows.groupBy(key).agg(
        F.max(F.when(F.col("event") == "ablate-start", F.when(asked > 0, asked).otherwise(DEFAULT_HOLDOUT))).cast("bigint").alias("requested"),
        F.max_by(F.when(F.col("target").endswith(":expired"), "expired").otherwise("manual"), F.when(stop, F.col("line_no"))).alias("stopped"),
    )
    return ends.join(per, key)


def ablate_report(wal: DataFrame) -> DataFrame:
    """(slug, state, requested, observed, hits, rate, verdict) of the latest run of every bare slug."""
    r = ablation_runs(L.keyed(wal, trim_all=True), "slug").withColumn("rate", F.try_divide(F.col("hits"), F.col("observed")))
    verdict = F.when(F.col("rate").isNull(), "no observations").when(F.col("rate") >= HIT_RATE, "internalized").when(F.col("rate") <= LOW_RATE, "keep").otherwise("inconclusive")
    return r.select("slug", F.coalesce("stopped", F.lit("running")).alias("state"), "requested", "observed", "hits", "rate", verdict.alias("verdict"))


def promote(facts: DataFrame, wal: DataFrame) -> DataFrame:
    """(slug, project, kind, reason): what should become of a fact, by the first rule that fits."""
    log = L.keyed(wal, trim_all=True)
    v = L.session_verdicts(log, retro=False).groupBy("key").agg(F.count_if("useful").alias("n_useful"), F.count_if(~F.col("useful")).alias("n_silent"))
    confirmed = log.groupBy("key").agg(F.max(F.col("event") == "candidate-confirmed").alias("was_confirmed"))
    h = confirmed.join(v, "key", "left").join(useful_streak(wal), "key", "left").join(ablation_runs(log), "key", "left")
    rows = _fallback(facts.select("slug", "project", "type", "status", "recurrence"), h)
    zero = F.lit(0)
    done = (F.col("requested") > 0) & (F.col("stopped").isNotNull() | (F.col("observed") >= F.col("requested"))) & (F.col("observed") > 0)
    reason = (
        F.when((F.col("type") == "mistake") & (F.col("recurrence") >= MIN_RECURRENCE), "recurrence")
        .when(F.col("streak"), "streak")
        .when(done & (F.try_divide(F.col("hits"), F.col("observed")) >= HIT_RATE), "internalized")
        .when((F.col("status") == "candidate") & ~F.coalesce("was_confirmed", F.lit(False)) & (F.coalesce("n_useful", zero) == 0) & (F.coalesce("n_silent", zero) >= SILENT_LIMIT), "never-corroborated")
    )
    kind = F.when(F.col("reason") == "recurrence", "mechanical").when(F.col("reason") == "streak", "claudemd").otherwise("retire")
    return rows.withColumn("reason", reason).filter("reason is not null").select(F.regexp_replace("slug", r"\.md$", "").alias("slug"), "project", kind.alias("kind"), "reason")


# --- replay ------------------------------------------------------------------


def ab_pool(events: DataFrame) -> DataFrame:
    return events.select(F.col("target").alias("slug")).distinct()


def ab_eval_sessions(events: DataFrame) -> DataFrame:
    """(session, date, useful): sessions with a useful verdict, their first such date, and the useful targets."""
    return events.filter("event = 'trigger-useful'").groupBy("session").agg(F.min("date").alias("date"), F.array_sort(F.collect_set("target")).alias("useful"))


def ab_signals(events: DataFrame) -> DataFrame:
    """(date, slug, ref_count, pos, neg, last_inject): signals of each target strictly before each evaluation date.

    Daily sums per target are summed up along the days; evaluation dates enter as
    empty rows that come before their own day's events, so the work is linear.
    """
    n = L.number(F.col("session"))
    e = F.col("event")
    refs = F.when(e == "inject", 1).when(e == "inject-agg", F.when(n >= 1, n).otherwise(1)).otherwise(0)
    counted = events.filter(e.isin("inject", "inject-agg", "outcome-positive", "outcome-negative"))
    daily = counted.groupBy(F.col("target").alias("slug"), "date").agg(
        F.sum(refs).cast("bigint").alias("r"), F.count_if(e == "outcome-positive").alias("p"), F.count_if(e == "outcome-negative").alias("m"),
        F.max(F.when(e.isin("inject", "inject-agg"), F.col("date"))).alias("l"),
    ).withColumn("is_event", F.lit(1))
    dates = ab_eval_sessions(events).select("date").distinct()
    zero = F.lit(0).cast("bigint")
    marks = daily.groupBy("slug").agg(F.min("date").alias("from")).join(F.broadcast(dates), F.col("date") > F.col("from")).select("slug", "date")
    marks = marks.select("slug", "date", zero.alias("r"), zero.alias("p"), zero.alias("m"), F.lit(None).cast("string").alias("l"), F.lit(0).alias("is_event"))
    w = Window.partitionBy("slug").orderBy("date", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.unionByName(marks).select("slug", "date", "is_event", F.sum("r").over(w).alias("ref_count"), F.sum("p").over(w).alias("pos"), F.sum("m").over(w).alias("neg"), F.max("l").over(w).alias("last_inject"))
    return out.filter("is_event = 0").drop("is_event")


def ab_replay(events: DataFrame, ks: tuple[int, ...] = (3, 5, 8, 12)) -> DataFrame:
    """(k, sessions, recall): mean share of a session's useful targets among the k best, by signals before its date only.

    The ranking depends on the date alone, so it is made once per date.  Targets
    without signals tie; the first of them by name fill the places left.
    """
    top = max(ks)
    sessions = ab_eval_sessions(events)
    dates = sessions.select("date").distinct()
    eff = (F.col("pos") + 1) / (F.col("pos") + F.col("neg") + 2)
    score = W_USE * F.log10(1 + F.col("ref_count")) * gate(eff) + W_RECENCY * recency(F.col("last_inject"), F.lit(None).cast("string"), F.col("date")) + W_EFFECT * eff
    known = ab_signals(events).select("date", "slug", score.alias("score"))
    # Scores may fall below that of an unknown target, so all of these compete; the first by name of them are enough.
    firsts = ab_pool(events).orderBy("slug")
    seen = known.groupBy("date").agg(F.count("*").alias("n"))
    most = seen.agg(F.max("n")).first()[0] or 0
    idle = F.broadcast(dates).join(firsts.limit(top + most), F.lit(True)).join(known, ["date", "slug"], "left_anti").withColumn("score", F.lit(W_EFFECT * 0.5))
    w = Window.partitionBy("date").orderBy(F.desc("score"), "slug")
    ranked = known.unionByName(idle).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    hits = sessions.select("session", "date", F.size("useful").alias("size"), F.explode("useful").alias("slug")).join(ranked, ["date", "slug"], "left")
    per = hits.groupBy("session", "size").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.col("size")).alias("v")) for k in ks])
    return per.select(F.explode(pairs).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("sessions"), F.avg("x.v").alias("recall"))


def numbered_pool(events: DataFrame) -> DataFrame:
    """(slug, place): the pool in order of a digest, numbered from 0; a running sum over 4,096 classes, and an order within each."""
    pool = ab_pool(events).filter("slug is not null").withColumn("_d", F.md5("slug")).withColumn("_c", F.substring("_d", 1, 3))
    sizes = pool.groupBy("_c").agg(F.count("*").alias("_n"))
    before = sizes.select("_c", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_c").orderBy("_d", "slug"))
    return pool.join(F.broadcast(before), "_c").select("slug", (F.col("_before") + inside - 1).alias("place"))


def _primes(n: int = 16, below: int = 1 << 31) -> list[int]:
    """The ``n`` greatest primes below a bound."""
    found: list[int] = []
    x = below - 1
    while len(found) < n:
        if x % 2 and all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            found.append(x)
        x -= 2 if x % 2 else 1
    return found


def ab_random(events: DataFrame, ks: tuple[int, ...] = (3, 5, 8, 12), seed: int = 1) -> DataFrame:
    """(k, sessions, recall) of a seeded choice of exactly k targets of the pool per session, for comparison.

    Each session orders the pool anew, by ``(a * place + b) mod size`` with a
    prime ``a`` and a shift ``b`` from a digest of its name, and chooses the first
    k (all of a smaller pool).  As that is a permutation (pools are smaller than 2 ** 31), it is
    enough to look where the session's own useful targets come; the pool is never
    put against the sessions.
    """
    pool = numbered_pool(events)
    size = events.select(F.count_distinct("target").alias("_size"))
    sessions = ab_eval_sessions(events).withColumn("_d", F.md5(F.concat(F.lit(f"{seed}:"), "session")))
    draw = [F.conv(F.substring("_d", at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    factor = F.get(F.array(*[F.lit(p).cast("bigint") for p in _primes()]), (draw[0] % 16).cast("int"))
    rows = sessions.select("session", F.size("useful").alias("size"), factor.alias("_a"), draw[1].alias("_b"), F.explode("useful").alias("slug")).join(pool, "slug").join(F.broadcast(size), F.lit(True))
    at = (F.col("_a") * F.col("place") + F.col("_b")) % F.col("_size")
    per = rows.groupBy("session", "size").agg(*[F.count_if(at < k).alias(f"h{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"h{k}") / F.col("size")).alias("v")) for k in ks])
    return per.select(F.explode(pairs).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.count("*").alias("sessions"), F.avg("x.v").alias("recall"))
