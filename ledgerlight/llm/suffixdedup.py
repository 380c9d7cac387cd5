"""Removal of repeated substrings by sorted suffixes, deep-shallow.

Every byte covered by a ``LENGTH``-byte string that starts anywhere else too goes.

*Which suffixes can matter.*  In every ``LENGTH``-byte window the least hash of
its ``ANCHOR``-byte substrings marks an anchor.  Equal windows have equal
anchors, and each window has one anchor, so windows are dealt out by anchor.
The windows of one anchor occurrence are consecutive; the bytes they cover are its
context.  An anchor that occurs once in the corpus is done; if all its contexts
are the same, all its windows repeat.  Only anchors with different contexts
are left, and of equal contexts one stands for all, so a passage that many
documents share is one row, with a count, already before the shuffle.

*Sorting.*  The suffixes at the windows of those contexts are sorted, deep-shallow:
multikey quicksort by 8-byte characters (one partitioning step for all groups
at once) down to ``SHALLOW`` bytes, then blind tries order each group
that still has a long common prefix.  A trie is built level by level for all groups
together: hashes give the length of a group's common prefix without reading
it, and one byte after it parts the group.  Suffixes that agree on ``LENGTH``
bytes are one leaf; windows in a leaf of two or more repeat.

Only positions, counts and differing contexts are shuffled, and the texts twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, doc_id, materialize, partitions, row_key, small_batches
from .textkit import chunks, mix, powers, prefix_hash, span_hash

LENGTH, ANCHOR, SHALLOW = 200, 64, 16
#: Bytes of contexts whose suffixes are sorted together (one anchor's are never parted).
JUDGED_BYTES = 1 << 19
_HIGH = np.uint64(2**64 - 1)


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first window start, number of windows) of every anchor occurrence; starts count from ``buf``'s begin."""
    n, width = len(buf), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    pre = prefix_hash(buf)
    _, down = powers(n)
    m = n - anchor + 1
    h = mix((pre[anchor:] - pre[:-anchor]) * down[:m])
    # Least value of every run of `width` hashes, from running minima inside blocks.
    padded = np.full(-(-m // width) * width, _HIGH)
    padded[:m] = h
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - length + 1], left[width - 1 : width + n - length])
    starts = np.arange(n - length + 1)
    text = np.searchsorted(offs, starts, side="right") - 1
    inside = starts + length <= offs[text + 1]
    # A run ends where the least value or the text changes, or the anchor (the leftmost, on ties) was the last window's begin.
    new = np.ones(len(starts), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (h[: len(starts) - 1] == low[:-1])
    first = np.flatnonzero(new & inside)
    bounds = np.flatnonzero(np.append(new | ~inside, True))
    count = bounds[np.searchsorted(bounds, first, side="right")] - first
    return text[first], low[first], first, count


def _occurrences(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Per task, batch, anchor and context: number of windows, of occurrences, and these (key, first window) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, buf, offs in chunks(batch.column(1)):
                text, h, first, count = anchors(buf, offs, length, anchor)
                context = span_hash(prefix_hash(buf), first, first + count - 1 + length) if len(first) else h
                order = np.lexsort((context, h))
                h, context, text, first, count = h[order], context[order], text[order], first[order], count[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
                at = np.flatnonzero(new)
                where = np.empty((len(h), 2), ">i8")
                where[:, 0], where[:, 1] = keys[a + text] if len(text) else 0, first - offs[text] if len(text) else 0
                members = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.append(at, len(h)) * 16).astype(np.int32).tobytes()), pa.py_buffer(where.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), pa.array(context[at].view(np.int64)), pa.array(count[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(h))).astype(np.int32)), members],
                    names=["anchor", "context", "windows", "n", "members"],
                )

    return docs.mapInArrow(run, "anchor long, context long, windows int, n int, members binary")


def deep_shallow_groups(buf: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Sizes of the leaves: for each of ``starts``, how many suffixes agree with it on ``length`` bytes, itself included.

    ``buf`` must reach ``length`` bytes beyond every start.
    """
    size = np.ones(len(starts), np.int64)
    index = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    for depth in range(0, min(shallow, length) // 8 * 8, 8):  # multikey quicksort: part all groups by the next character
        view = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        key = view[starts[index] + depth].copy().view(">u8").ravel().astype(np.uint64)
        index, group = _part(index, group, key)
    pre = prefix_hash(buf)
    _, down = powers(len(buf))

    def agrees(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (pre[a + k] - pre[a]) * down[a] == (pre[b + k] - pre[b]) * down[b]

    while len(index):  # blind tries, one level of all of them a turn
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.append(head, len(group)))
        me, lead = starts[index], np.repeat(starts[index[head]], count)
        same = agrees(me, lead, np.full(len(me), length))
        whole = np.logical_and.reduceat(same, head)
        done = np.repeat(whole, count)
        size[index[done]] = np.repeat(count, count)[done]
        index, group, me, lead, same = (x[~done] for x in (index, group, me, lead, same))
        if not len(index):
            break
        lo, hi = np.zeros(len(me), np.int64), np.full(len(me), length)
        while (hi - lo > 1).any():  # longest common prefix with the group's first, by bisection
            mid = (lo + hi) // 2
            ok = agrees(me, lead, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
        lo[same] = length
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        common = np.repeat(np.minimum.reduceat(lo, head), np.diff(np.append(head, len(group))))
        index, group = _part(index, group, buf[me + common].astype(np.uint64))
    return size


def _part(index: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part groups by ``key``; groups of one are left out, as they are in place."""
    order = np.lexsort((key, group))
    index, group, key = index[order], group[order], key[order]
    new = np.ones(len(index), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new)
    many = np.bincount(group)[group] > 1
    return index[many], group[many]


def _contexts(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of one context per row (anchor, context, windows, n, key, first)."""
    asked = rows.groupBy("key").agg(F.collect_list(F.struct("anchor", "context", "windows", "n", "first")).alias("asked"))
    joined = docs.join(asked, "key").select(F.col("text").cast("binary").alias("text"), F.explode("asked").alias("a"))
    return joined.select("a.anchor", "a.context", "a.windows", "a.n", F.substring("text", F.col("a.first").cast("int") + 1, F.col("a.windows") - 1 + length).alias("bytes"))


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, context, lo, hi): windows lo to hi - 1 of a context occur elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            if not rows:
                continue
            held += rows
            last = held[-1][0]
            cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != last), -1) + 1
            if cut:
                yield judge(held[:cut])
                held = held[cut:]
        if held:
            yield judge(held)

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        parts, size = [], 0
        out: list[tuple[int, int, int, int]] = []
        for k, row in enumerate(rows):
            if not parts or row[:2] != parts[-1][:2]:  # repeated rows give a context more than once
                parts.append(row)
                size += len(row[4])
            if k + 1 == len(rows) or row[0] != rows[k + 1][0] and size > JUDGED_BYTES:
                out += found(parts)
                parts, size = [], 0
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["anchor", "context", "lo", "hi"])

    def found(parts: list[tuple]) -> list[tuple[int, int, int, int]]:
        buf = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
        windows = np.array([p[2] for p in parts])
        base = np.cumsum([0] + [len(p[4]) for p in parts])[:-1]
        owner = np.repeat(np.arange(len(parts)), windows)
        rel = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        size = deep_shallow_groups(buf, base[owner] + rel, length)
        hit = np.flatnonzero((size > 1) | (np.array([p[3] for p in parts])[owner] > 1))
        if not len(hit):
            return []
        new = np.ones(len(hit), bool)
        new[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        at = np.flatnonzero(new)
        ends = hit[np.append(at[1:], len(hit)) - 1]
        return [(parts[o][0], parts[o][1], int(x), int(y) + 1) for o, x, y in zip(owner[hit[at]], rel[hit[at]], rel[ends])]

    ordered = contexts.repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor", "context")
    return ordered.mapInArrow(run, "anchor long, context long, lo int, hi int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per text key (``docs`` has key, text): array of the byte ranges to remove, merged, in order; texts without any are left out."""
    small_batches(docs.sparkSession)
    occurrences = _occurrences(docs.select("key", "text"), length, anchor)
    w = Window.partitionBy("anchor")
    flagged = (
        occurrences.withColumns({"_all": F.sum("n").over(w), "_lo": F.min("context").over(w), "_hi": F.max("context").over(w)})
        .filter("_all > 1")
        .withColumn("mixed", F.col("_lo") != F.col("_hi"))
        .drop("_lo", "_hi", "_all")
    )
    flagged = materialize(flagged, "anchors")
    mixed = flagged.filter("mixed")
    # The place of one occurrence stands for its context.
    one = mixed.groupBy("anchor", "context").agg(F.max("windows").alias("windows"), F.sum("n").alias("n"), F.min(F.substring("members", 1, 16)).alias("place"))
    place = one.select("anchor", "context", "windows", "n", _long(F.col("place"), 1).alias("key"), _long(F.col("place"), 9).alias("first"))
    contexts = materialize(_contexts(place, docs, length), "contexts")
    repeats = materialize(_repeats(contexts, length), "repeats")
    discard(contexts)
    plain = flagged.filter("not mixed").select("members", F.lit(0).alias("lo"), F.col("windows").alias("hi"))
    judged = mixed.join(repeats, ["anchor", "context"]).select("members", "lo", "hi")
    steps = F.sequence(F.lit(0), F.floor(F.length("members") / 16).cast("int") - 1)
    ranges = plain.union(judged).select("lo", "hi", F.explode(F.transform(steps, lambda i: F.substring(F.col("members"), i * 16 + 1, F.lit(16)))).alias("m"))
    ranges = ranges.select(_long(F.col("m"), 1).alias("key"), (_long(F.col("m"), 9) + F.col("lo")).alias("start"), (_long(F.col("m"), 9) + F.col("hi") - 1 + length).alias("end"))
    return ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _long(value: Column, at: int) -> Column:
    """The big-endian signed 64-bit integer at byte ``at`` (from 1) of a binary column."""
    return F.conv(F.hex(F.substring(value, at, 8)), 16, -10).cast("long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes, or null without ``with_text``).

    A null text is empty.  Texts under ``length`` bytes lose nothing.  Equal
    rows lose each other's bytes, so all of them do; null and repeated doc_ids
    are kept; overlaps inside one text count; an empty table gives no rows.
    What is kept may end inside a character, therefore it is binary.
    """
    base = docs.select(doc_id(), F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"))
    spans = repeated_spans(base, length, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            lists = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                n_removed = n_spans = 0
                kept = raw
                if lists[i].is_valid:
                    flat = lists[i].values
                    start, end = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    new = np.concatenate([[True], start[1:] > reach[:-1]])
                    a = start[new]
                    b = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    n_spans, n_removed = len(a), int((b - a).sum())
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                rows.append((len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = base.join(spans, "key", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


