"""Streams of sessions against their batch forms, on logs that arrive in several files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import log as L
from ledgerlight.operators import sessions as S
from ledgerlight.sources import versions
from ledgerlight.streaming import fold
from ledgerlight.streaming import sessions as T

LOG = "line_no bigint, ts timestamp, date string, event string, target string, session string"
START = datetime(2024, 3, 1)


def log_of(spark, rows):
    """rows: (hours, event, target, session)."""
    at = [START + timedelta(hours=h) if h is not None else None for h, *_ in rows]
    return spark.createDataFrame([(i, t, t.strftime("%Y-%m-%d") if t else None, *r[1:]) for i, (t, r) in enumerate(zip(at, rows))], LOG)


def played(spark, tmp_path, rows, build, parts=4):
    """What a stream over ``rows`` gives, a file at a time; its last row is late enough to end all timers."""
    rows = sorted(rows, key=lambda r: r[0])
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        log_of(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log_of(spark, [(24 * 60, "other", "x", "end")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    T.use_rocksdb(spark)
    stream = spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = build(stream)
    query.processAllAvailable()
    query.stop()


def in_memory(name, make):
    return lambda stream: make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()


def some_log(seed, n=120):
    r = random.Random(seed)
    events = ["inject"] * 4 + ["recall", "trigger-useful", "holdout-skip", "strategy-used", "clean-session", "outcome-new"]
    rows = [(r.randrange(0, 24 * 25 * 4) / 4, r.choice(events), f"k{r.randrange(6)}", f"s{r.randrange(9)}") for _ in range(n)]
    # Sessions longer than a week without a row would be forgotten; those are tested by hand.
    return rows


def test_late_verdicts_by_hand(spark, tmp_path):
    rows = [
        (0, "inject", "open", "a"), (5, "inject", "open", "a"), (30, "clean-session", "x", "a"),
        (0, "inject", "closed", "b"), (24, "trigger-useful", "closed", "b"),
        (10, "inject", "later", "b"), (0, "recall", "no", "c"), (1, "inject", "k", "d"),
    ]
    log = log_of(spark, rows + [(None, "inject", "k", "e"), (2, "inject", "k", None)])
    at = lambda h: F.lit((START + timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S"))
    got = lambda h: {(r["date"], r["target"], r["session"]) for r in S.retro_silent(log, at(h)).collect()}
    assert got(23.9) == set() and got(24) == {("2024-03-02", "open", "a")}
    assert got(100) == {("2024-03-02", "open", "a"), ("2024-03-02", "k", "d")}
    played(spark, tmp_path, rows, in_memory("late_hand", T.retro_silent))
    assert {(r["date"], r["target"], r["session"]) for r in spark.table("late_hand").collect()} == got(100)


def test_late_verdicts_equal_batch(spark, tmp_path):
    rows = some_log(3)
    rows = [(h, e, f"{t}-{int(h) // 100}", f"{s}-{int(h) // 100}") for h, e, t, s in rows]  # sessions of under a week
    played(spark, tmp_path, rows, in_memory("late", T.retro_silent))
    want = S.retro_silent(log_of(spark, rows), F.lit("2025-01-01 00:00:00")).collect()
    got = spark.table("late").select("date", "event", "target", "session").collect()
    assert len(got) > 5 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_lists_expire_as_in_batch(spark, tmp_path):
    hand = [(0, "inject", "a", "s"), (168, "recall", "b", "s"), (336.25, "inject", "c", "s"), (0, "strategy-used", "x", "s"), (24.25, "strategy-used", "y", "s"), (40, "strategy-used", "z", "s")]
    log = log_of(spark, hand + [(1, "inject", "q", None), (None, "inject", "q", "n")])
    now = lambda h: F.lit((START + timedelta(hours=h)).strftime("%Y-%m-%d %H:%M:%S"))
    got = {(r["kind"], tuple(r["slugs"])): r["live"] for r in S.list_lives(S.list_entries(log), now(400)).collect()}
    assert got == {("injected", ("a", "b")): False, ("injected", ("c",)): True, ("skill", ("x",)): False, ("skill", ("y", "z")): False}
    assert {tuple(r["slugs"]) for r in S.list_lives(S.list_entries(log), now(200)).filter("live").collect()} == {("a", "b")}
    rows = hand + some_log(5)
    played(spark, tmp_path, rows, in_memory("lists", T.expired_lists))
    want = S.list_lives(S.list_entries(log_of(spark, rows)), F.lit("2025-01-01 00:00:00")).collect()
    assert all(not r["live"] for r in want) and len(want) > 20
    show = lambda rs: sorted((r["session"], r["kind"], r["last"], tuple(r["slugs"])) for r in rs)
    assert show(spark.table("lists").collect()) == show(want)


def test_verdict_changes_keep_a_table_equal_to_the_fold(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.choice(["trigger-silent", "trigger-useful", "trigger-silent-retro", "inject"]), f"p\x1fk{r.randrange(5)}", f"s{r.randrange(4)}") for i in range(60)]
    path = f"file://{tmp_path}/counts"
    written = []

    def run(stream):
        add = T.add_changes(path)

        def each(batch, number):
            written.append(batch.select("key").distinct().count())
            add(batch, number)
            add(batch, number)  # a batch that is tried again

        return T.verdict_changes(stream).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()

    played(spark, tmp_path, rows, run)
    show = lambda df: sorted((r["key"], r["pos"], r["neg"]) for r in df.collect())
    assert show(versions.read(spark, path)) == show(T.verdict_counts(log_of(spark, rows)))
    assert len(written) >= 4 and written[-1] < 5


@pytest.mark.parametrize("first, then, want", [("trigger-silent", "trigger-useful", [(0, 1), (1, -1)]), ("trigger-useful", "trigger-silent", [(1, 0)]), ("trigger-silent", "trigger-silent-retro", [(0, 1)])])
def test_a_useful_verdict_takes_a_silent_one_back(spark, tmp_path, first, then, want):
    name = f"changes_{first}_{then}".replace("-", "_")
    played(spark, tmp_path, [(0, first, "k", "s"), (1, then, "k", "s")], lambda stream: T.verdict_changes(stream).writeStream.format("memory").queryName(name).outputMode("update").start(), parts=2)
    assert [(r["pos"], r["neg"]) for r in spark.table(name).collect()] == want


def test_counters_are_kept_in_a_table(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, r.choice(["inject", "recall", "outcome-positive", "outcome-negative", "inject-agg"]), f"k{r.randrange(40)}", str(r.randrange(3))) for i in range(160)]
    path = f"file://{tmp_path}/counters"
    played(spark, tmp_path, rows, lambda stream: fold.keep_counters(stream, path, f"{tmp_path}/ck"))
    columns = ["key", "injects", "pos", "neg", "created", "last_inject"]
    want = L.aggregates(L.keyed(log_of(spark, [*rows, (24 * 60, "other", "x", "end")]))).select(columns).collect()
    assert sorted(map(str, versions.read(spark, path).select(columns).collect())) == sorted(map(str, want))
    # A version for each batch that changed something, and one before the first.
    assert versions.latest(spark, path) >= 4


def test_repeated_rows_pass_once(spark, tmp_path):
    rows = [(0, "inject", "k", "s"), (1, "inject", "k", "s"), (2, "inject", "k", "t"), (3, "recall", "k", "s"), (20, "inject", "k", "s"), (100, "inject", "k", "s")]
    played(spark, tmp_path, rows, in_memory("once", lambda stream: fold.deduplicated(stream, "ts", "36 hours")), parts=3)
    got = sorted((r["date"], r["event"], r["session"]) for r in spark.table("once").filter("session <> 'end'").collect())
    assert got == [("2024-03-01", "inject", "s"), ("2024-03-01", "inject", "t"), ("2024-03-01", "recall", "s"), ("2024-03-05", "inject", "s")]
