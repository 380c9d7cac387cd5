"""Sessions as streams: late verdicts by timers, lists that expire, and verdict counts that take back what they said.

Each processor keeps state per key and acts on event time; a session must use the
RocksDB state store (``use_rocksdb``).  On a finished input every stream gives
what its batch form in ``operators`` gives.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import log as L
from ..operators import sessions as S
from ..schema import CLOSING_EVENTS
from ..sources import versions

#: Milliseconds without a row after which a session's state is dropped.
FORGET = 7 * 24 * S.HOUR
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class RetroSilent(StatefulProcessor):
    """State of a session: open facts with the time of their first inject, facts that are settled, its first close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "target string", "ms long")
        self.settled = handle.getMapState("settled", "target string", "ms long")
        self.closed = handle.getValueState("closed", "ms long")
        self.last = handle.getValueState("last", "ms long")

    def _value(self, state) -> int | None:
        return state.get()[0] if state.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        closed, last = self._value(self.closed), self._value(self.last)
        before = last
        for r in rows:
            if r["event"] in CLOSING_EVENTS:
                closed = r["ms"] if closed is None else min(closed, r["ms"])
            elif not self.settled.containsKey((r["target"],)):
                have = self.open.getValue((r["target"],))[0] if self.open.containsKey((r["target"],)) else None
                if have is None or r["ms"] < have:
                    self.open.updateValue((r["target"],), (r["ms"],))
                    self.handle.registerTimer(r["ms"] + S.CLOSE_WITHIN)
            last = r["ms"] if last is None else max(last, r["ms"])
        if closed is not None:
            self.closed.update((closed,))
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before + FORGET)
            self.last.update((last,))
            self.handle.registerTimer(last + FORGET)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, closed, last = expiredTimerInfo.getExpiryTimeInMs(), self._value(self.closed), self._value(self.last)
        due = sorted((ms[0] + S.CLOSE_WITHIN, target[0]) for target, ms in self.open.iterator() if ms[0] + S.CLOSE_WITHIN <= now)
        out = []
        for at, target in due:
            self.open.removeKey((target,))
            self.settled.updateValue((target,), (at,))
            if closed is None or closed > at:
                out.append(Row(ms=at, target=target, session=key[0]))
        if last is not None and now >= last + FORGET:
            for state in (self.open, self.settled, self.closed, self.last):
                state.clear()
        return iter(out)

    def close(self) -> None:
        pass


def retro_silent(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The rows of ``operators.sessions.retro_silent``, each when the watermark passes its time.

    A fact that is injected again into a session without a row for ``FORGET`` counts anew.
    """
    # Tied to the time, so that no row is filtered before it has moved the watermark.
    wanted = F.when(F.col("ts").isNotNull(), F.col("event").isin("inject", *CLOSING_EVENTS) & F.col("session").isNotNull())
    rows = log.withWatermark("ts", delay).filter(wanted).select("session", "event", "target", "ts", S.millis().alias("ms"))
    found = rows.groupBy("session").transformWithState(RetroSilent(), "ms long, target string, session string", "Append", "EventTime")
    return found.select(S.day_of(F.col("ms")).alias("date"), F.lit("trigger-silent-retro").alias("event"), "target", "session")


class ExpiringList(StatefulProcessor):
    """State of a list: its slugs and when it was last written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slugs = handle.getMapState("slugs", "slug string", "ms long")
        self.last = handle.getValueState("last", "ms long")

    def _ended(self, key, last: int) -> Row:
        found = sorted(s[0] for s in self.slugs.keys())
        self.slugs.clear()
        return Row(session=key[0], kind=key[1], last=last, slugs=found)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out, life = [], S.LIST_LIVES[key[1]]
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for ms, slug in sorted((r["ms"], r["slug"]) for r in rows):
            if last is not None and ms - last > life:  # one batch may span several lives
                out.append(self._ended(key, last))
            self.slugs.updateValue((slug,), (ms,))
            last = ms if last is None else max(last, ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + life + 1)
            self.last.update((last,))
            self.handle.registerTimer(last + life + 1)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.last.exists() or self.last.get()[0] + S.LIST_LIVES[key[1]] >= expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        out = self._ended(key, self.last.get()[0])
        self.last.clear()
        return iter((out,))

    def close(self) -> None:
        pass


def expired_lists(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(session, kind, last, slugs) of lists as they are dropped: the lives of ``operators.sessions.list_lives`` that are over."""
    rows = S.list_entries(log.withWatermark("ts", delay))
    return rows.groupBy("session", "kind").transformWithState(ExpiringList(), "session string, kind string, last long, slugs array<string>", "Append", "EventTime")


class VerdictChanges(StatefulProcessor):
    """State of a fact in a session: its verdict so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.useful = handle.getValueState("useful", "useful boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.useful.get()[0] if self.useful.exists() else None
        after = bool(before) or any([r["useful"] for r in rows])
        if after == before:
            return iter(())
        self.useful.update((after,))
        return iter((Row(key=key[0], pos=int(after), neg=int(not after) - int(before is False)),))

    def close(self) -> None:
        pass


def verdict_changes(log: DataFrame) -> DataFrame:
    """(key, pos, neg): changes to a fact's counts of useful and silent sessions; a useful verdict takes an earlier silent one back."""
    hits = L.keyed(log).filter(F.col("event").isin("trigger-useful", "trigger-silent", "trigger-silent-retro"))
    rows = hits.select("key", "session", (F.col("event") == "trigger-useful").alias("useful"))
    return rows.groupBy("key", "session").transformWithState(VerdictChanges(), "key string, pos long, neg long", "Update", "None")


def verdict_counts(log: DataFrame) -> DataFrame:
    """(key, pos, neg): the same counts of a whole log."""
    return L.session_verdicts(L.keyed(log)).groupBy("key").agg(F.count_if("useful").alias("pos"), F.count_if(~F.col("useful")).alias("neg"))


def add_changes(path: str, name: str = "verdicts"):
    """For foreachBatch: add a batch of changes to the versioned table (key, pos, neg) at ``path``, once however often it is tried.

    Only buckets that hold a changed key are read and written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if versions.latest(spark, path) is None:
            versions.replace(spark.createDataFrame([], "key string, pos long, neg long"), path, ["key"])
        base = versions.latest(spark, path)
        changes = batch.groupBy("key").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")).persist()
        try:
            have = versions.matching(spark, path, changes, base)
            both = changes.join(have, "key", "left")
            added = [(F.coalesce(c, F.lit(0)) + F.col(f"_{c}")).alias(c) for c in ("pos", "neg")]
            versions.upsert(spark, path, both.select("key", *added, F.lit(False).alias("deleted")), f"{name}-{number}", base)
        finally:
            changes.unpersist()

    return apply
