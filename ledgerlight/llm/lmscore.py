"""Cross-entropy difference between a target and a background language model.

Both models are bigram models of one form over one vocabulary: every word of the
corpus, a class for all others, and a begin mark.  Counts cover every text.  A
bigram is discounted by ``DISCOUNT``; what that frees goes to the unigram model,
so each distribution sums to one.  No word or bigram is left out, at any size.

The models never are in one place.  Texts are held in chunks of about ``CHUNK``
bytes.  A chunk sends its distinct bigrams and words, sorted and packed, to
buckets by their hashes; a bucket adds up what all chunks sent and returns the
sums, in the order in which each chunk had sent its keys.  So nothing but packed
keys and counts is moved, no join is made, and a frequent word is one entry of
each chunk.  A bucket is dealt by both words of a bigram, so that the followers
of a frequent word are spread too.  The number of buckets grows with that of chunks.

A document's score is the mean over its words of target loss minus background
loss (natural logarithms): the lower, the closer to the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import doc_id, materialize, small_batches
from .textkit import buffer_of, chunks, mix, words_of

#: Absolute discount of a bigram's count, and what is added to each word's count.
DISCOUNT, PRIOR = 0.75, 0.1
#: Bytes of text in a chunk, and of those whose keys a bucket sums up.
CHUNK = BUCKET = 8 << 20
#: Stands before a text's first word.
BEGIN = 0x5851F42D4C957F2D


def _chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text and target with the chunk of each row: consecutive rows of about ``CHUNK`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            _, offs = buffer_of(b.column(1))
            ends = held + offs[1:]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk + ends // CHUNK)], names=["doc_id", "text", "target", "chunk"])
            held += int(offs[-1])

    return docs.select(doc_id(), "text", F.coalesce(F.col("target").cast("boolean"), F.lit(False)).alias("target")).mapInArrow(run, "doc_id long, text string, target boolean, chunk long")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and how often each occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], place, np.diff(np.append(first, len(keys)))


class _Keys:
    """A chunk's distinct words and, unless left out, bigrams, each in order of bucket and key, and where its words have them."""

    def __init__(self, texts: pa.Table, deal: tuple[int, int], pairs: bool = True):
        got = [words_of(buf, offs, lower=True) for _, _, buf, offs in chunks(texts["text"].combine_chunks())]
        words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in got)])
        n = np.concatenate([np.zeros(0, np.int64), *(np.diff(f) for _, f in got)])
        self.first = np.concatenate([[0], np.cumsum(n)])
        wanted = np.repeat(texts["target"].to_numpy().astype(bool), n)
        one, two = (np.uint64(x) for x in deal)
        # Words get their places first, so that bigrams are sorted by small numbers.
        known, at, _ = _distinct(np.append(words, np.uint64(BEGIN)))
        bucket = known % (one * two)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.words, self.word_bucket = known[order], bucket[order].astype(np.int64)
        self.word, begin = rank[at[:-1]], rank[at[-1]]
        self.past = np.empty_like(self.word)
        self.past[1:] = self.word[:-1]
        self.past[self.first[:-1][n > 0]] = begin
        self.used = [np.bincount(x[y], minlength=len(known)) for x in (self.word, self.past) for y in (slice(None), wanted)]  # as words, as histories; of all, of target texts
        if not pairs:
            return
        found, at, n = _distinct(self.past * len(known) + self.word)
        past, word = found // len(known), found % len(known)
        bucket = ((self.words[past] % one) * two + self.words[word] % two).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.pair, n = rank[at], n[order]
        self.h, self.w, self.pair_bucket = self.words[past[order]], self.words[word[order]], bucket[order]
        self.counts = [n, np.bincount(self.pair[wanted], minlength=len(n))]


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[at].tolist(), at.tolist(), np.append(at[1:], len(bucket)).tolist()))


def _pack(*columns: np.ndarray) -> bytes:
    """Counts side by side, after their width: the least of 1, 2, 4 and 8 bytes that holds all of them."""
    most = max((int(c.max()) for c in columns if len(c)), default=0)
    width = next(w for w in (1, 2, 4, 8) if not most >> 8 * w)
    return bytes([width]) + b"".join(c.astype(f"<u{width}").tobytes() for c in columns)


def _unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).reshape(columns, -1).astype(np.int64)


SENT = "bucket long, chunk long, keys binary, runs binary, others binary, counts binary"
BACK = "pairs boolean, bucket long, chunk long, counts binary"


def _sent(rows: DataFrame, deal: tuple[int, int], pairs: bool) -> DataFrame:
    """What every chunk sends to its buckets: its bigrams or its words."""

    def of(held: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        k = _Keys(pa.Table.from_batches(held).combine_chunks(), deal, pairs)
        out = []
        for bucket, a, b in _parts(k.pair_bucket) if pairs else ():
            heads = np.flatnonzero(np.concatenate([[True], k.h[a + 1 : b] != k.h[a : b - 1]]))
            runs = np.diff(np.append(heads, b - a))
            out.append((bucket, chunk, k.h[a:b][heads].tobytes(), runs.astype("<u4").tobytes(), k.w[a:b].tobytes(), _pack(*(c[a:b] for c in k.counts))))
        for bucket, a, b in () if pairs else _parts(k.word_bucket):
            out.append((bucket, chunk, k.words[a:b].tobytes(), None, None, _pack(*(c[a:b] for c in k.used))))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "chunk", "keys", "runs", "others", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            for chunk, x, y in _parts(b.column(2).to_numpy()):
                if held and chunk != now:
                    yield of(held, now)
                    held = []
                now = chunk
                held.append(b.slice(x, y - x))
        if held:
            yield of(held, now)

    return rows.select("text", "target", "chunk").mapInArrow(run, SENT)


def _sum(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (places of one of each), the sums of their counts, and for each key the place of its sum."""
    mixed = keys[0]
    for k in keys[1:]:
        mixed = mix(mixed) ^ k
    order = np.argsort(mixed)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    if (~same & (mixed[order][1:] == mixed[order][:-1])).any():  # different keys fell together
        order = np.lexsort(keys[::-1])
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[at], np.add.reduceat(counts[:, order], at, axis=1) if len(at) else counts, place


def _pair_sums(sent: DataFrame, deal: tuple[int, int]) -> DataFrame:
    """Sums of each bucket's bigrams, for every chunk that sent them; and, with a null chunk, how many words follow each history.

    The latter go to the buckets of words: keys are the histories, counts the followers in all and in target texts.
    """
    buckets = np.uint64(deal[0] * deal[1])

    def run(t: pa.Table) -> pa.Table:
        parts = list(zip(t["chunk"].to_pylist(), t["keys"].to_pylist(), t["runs"].to_pylist(), t["others"].to_pylist(), t["counts"].to_pylist()))
        h = np.concatenate([np.repeat(np.frombuffer(k, np.uint64), np.frombuffer(r, "<u4")) for _, k, r, _, _ in parts])
        w = np.concatenate([np.frombuffer(o, np.uint64) for *_, o, _ in parts])
        counts = [_unpack(c, 2) for *_, c in parts]
        at, sums, place = _sum((h, w), np.concatenate(counts, axis=1))
        mine = t["bucket"][0].as_py()
        out, a = [], 0
        for (chunk, *_), c in zip(parts, counts):
            b = a + c.shape[1]
            out.append((True, mine, chunk, None, _pack(*sums[:, place[a:b]])))
            a = b
        past, spot = np.unique(h[at], return_inverse=True)
        follow = [np.bincount(spot, x > 0, len(past)).astype(np.int64) for x in sums]
        order = np.argsort(past % buckets, kind="stable")
        for bucket, a, b in _parts((past[order] % buckets).astype(np.int64)):
            out.append((False, bucket, None, past[order[a:b]].tobytes(), _pack(*(f[order[a:b]] for f in follow))))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pairs", "bucket", "chunk", "keys", "counts"), zip(*out), (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))})

    return sent.groupBy("bucket").applyInArrow(run, "pairs boolean, bucket long, chunk long, keys binary, counts binary")


def _word_sums(sent: DataFrame) -> DataFrame:
    """Sums of each bucket's words for every chunk that sent them; and, with a null chunk, how many words there are and how often they occur.

    Counts are six a word: as a word and as a history, in all and in target texts, and its followers in both.
    """

    def run(t: pa.Table) -> pa.Table:
        parts = list(zip(t["chunk"].to_pylist(), t["keys"].to_pylist(), t["counts"].to_pylist()))
        words = np.concatenate([np.frombuffer(k, np.uint64) for _, k, _ in parts])
        counts = np.zeros((6, len(words)), np.int64)
        a, ends = 0, []
        for chunk, k, c in parts:
            b = a + len(k) // 8
            if chunk is None:
                counts[4:, a:b] = _unpack(c, 2)
            else:
                counts[:4, a:b] = _unpack(c, 4)
            ends.append((chunk, a, b))
            a = b
        _, sums, place = _sum((words,), counts)
        mine = t["bucket"][0].as_py()
        out = [(False, mine, chunk, _pack(*sums[:, place[a:b]])) for chunk, a, b in ends if chunk is not None]
        out.append((False, mine, None, _pack(np.array([(sums[0] > 0).sum(), sums[0].sum(), sums[1].sum()]))))
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pairs", "bucket", "chunk", "counts"), zip(*out), (pa.bool_(), pa.int64(), pa.int64(), pa.binary()))})

    return sent.groupBy("bucket").applyInArrow(run, BACK)


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (their difference) of every row of ``docs``, per word.

    The background is all rows, the target those whose ``target`` is true (null
    is false).  A null, empty or blank text has no tokens and null losses and
    score; texts of any length are counted and scored whole; equal texts get
    equal scores; null doc_ids are kept, ids that aren't numbers become null;
    an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = materialize(_chunked(docs), "lm-texts")
    buckets = max(1, -(-rows.select("chunk").distinct().count() * CHUNK // BUCKET))
    two = math.isqrt(buckets)
    deal = (-(-buckets // two), two)
    # What is sent lies only in the shuffle: texts are read once for bigrams and once for words, as keys don't compress.
    pairs = materialize(_pair_sums(_sent(rows, deal, True), deal), "lm-pairs")
    own = _sent(rows, deal, False).select("bucket", "chunk", "keys", "counts")
    words = materialize(_word_sums(own.union(pairs.filter("not pairs").select("bucket", "chunk", "keys", "counts"))), "lm-words")
    total = np.zeros(3, np.int64)
    for r in words.filter("chunk is null").select("counts").toLocalIterator():  # one short row a bucket
        total += _unpack(bytes(r[0]), 3)[:, 0]
    size = int(total[0]) + 2  # the class of other words and the begin mark
    found = pairs.filter("pairs").select("pairs", "bucket", "chunk", "counts").union(words.filter("chunk is not null"))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        k = _Keys(texts, deal)
        pair, word = np.zeros((2, len(k.w))), np.zeros((6, len(k.words)))
        at = {(True, b): (x, y) for b, x, y in _parts(k.pair_bucket)} | {(False, b): (x, y) for b, x, y in _parts(k.word_bucket)}
        for is_pair, bucket, data in zip(found["pairs"].to_pylist(), found["bucket"].to_pylist(), found["counts"].to_pylist()):
            x, y = at[is_pair, bucket]
            if is_pair:
                pair[:, x:y] = _unpack(data, 2)
            else:
                word[:, x:y] = _unpack(data, 6)
        n, losses = np.diff(k.first), []
        for side in (1, 0):  # target, background
            history = np.maximum(word[2 + side], 1)
            rest = np.where(word[2 + side] > 0, DISCOUNT * word[4 + side] / history, 1.0)
            unigram = (word[side] + PRIOR) / (int(total[1 + side]) + PRIOR * size)
            p = np.maximum(pair[side][k.pair] - DISCOUNT, 0) / history[k.past] + rest[k.past] * unigram[k.word]
            sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])[k.first]
            losses.append(np.diff(sums) / np.maximum(n, 1))
        none = n == 0
        t, b = losses
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": pa.array(n.astype(np.int64)), "loss_target": pa.array(t, mask=none), "loss_background": pa.array(b, mask=none), "score": pa.array(t - b, mask=none)})

    texts = rows.select("chunk", "doc_id", "text", "target")
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
