"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds.  Every benchmark item is split into ``SEED``-word n-grams of its
   case-folded words, punctuation stripped.  An alignment that reaches the
   threshold breaks at most once for each point it may lose, so it holds at
   least ``shared`` of them unbroken.  How many documents hold each n-gram is
   counted over the whole corpus (a scan that keeps counts of the item n-grams
   only).  An item's seeds are its rare n-grams: the most frequent ones, up to
   half of what must be shared, are left out, and so are those of no document.
2. Candidates.  A second scan joins the n-grams of every document with the
   seeds.  Where an item has as many hits as must be shared, less those left
   out, within the diagonals an alignment can span, they become one passage.
   No passage that reaches the threshold is missed.
3. Alignment.  Smith-Waterman over words scores the passage against the item.
   Its best score over the score of a full copy decides.

Items are worked through in blocks of about ``BLOCK_WORDS`` words, each against
all documents, so that the broadcast seeds of a block are bounded.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import doc_id, map_rows, small_batches
from .textkit import chunks, ngram_hash, prefix_hash, span_hash, word_spans

#: Words of a seed; three can't be relied on, as a copy with a word put in after every two still scores 0.75.
SEED = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a full copy's score; an item of fewer than ``MIN_WORDS`` words has to be found whole.
THRESHOLD, MIN_WORDS = 0.6, 5
#: Words of the items that are broadcast together.
BLOCK_WORDS = 1 << 20

_EDGE = np.zeros(256, bool)  # punctuation bytes trimmed from words
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


_GROWS = np.zeros(0x10000, bool)  # characters that folding makes several of
_GROWS[[c for c in range(0x10000) if len(chr(c).casefold()) > 1]] = True


def words(text: str | None) -> list[str]:
    """Case-folded (all of Unicode) words without ASCII punctuation at their edges; words of punctuation alone are dropped."""
    if not text:
        return []
    trimmed = (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in re.split(r"[\x20\x09-\x0D]+", text.casefold()))
    return [w for w in trimmed if w]


def _widths(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of code points; a surrogate stands for one byte that is no UTF-8."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000) - 2 * ((codes >= 0xDC80) & (codes <= 0xDCFF))


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _folded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts case-folded: bytes, offsets, and for each place between two characters its place in ``buf``."""
    raw = buf.tobytes()
    if raw.isascii():
        return np.frombuffer(raw.lower(), np.uint8), offs, np.arange(len(buf) + 1)
    text = raw.decode("utf-8", "surrogateescape")
    folded = text.casefold()
    old, new = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, folded))
    sizes = _widths(new)
    at, to = _before(_widths(old)), _before(sizes)
    if len(new) == len(old):  # one character for each
        char, ends = np.arange(len(new)), to
    else:
        many = np.ones(len(old), np.int64)
        odd = np.flatnonzero(_GROWS[np.minimum(old, len(_GROWS) - 1)])
        many[odd] = [len(chr(c).casefold()) for c in old[odd].tolist()]
        char, ends = np.repeat(np.arange(len(old)), many), to[_before(many)]
    back = np.empty(to[-1] + 1, np.int64)
    back[:-1] = np.repeat(at[char], sizes)
    back[ends] = at
    return np.frombuffer(folded.encode("utf-8", "surrogateescape"), np.uint8), ends[np.searchsorted(at, offs)], back


def _hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each text, and byte spans of the words as ``words`` has them; ``buf`` is folded."""
    starts, ends, _ = word_spans(buf, offs)
    while True:
        trim = (starts < ends) & _EDGE[buf[np.minimum(starts, len(buf) - 1)]] if len(starts) else np.zeros(0, bool)
        if not trim.any():
            break
        starts = starts + trim
    while True:
        trim = (starts < ends) & _EDGE[buf[ends - 1]] if len(starts) else np.zeros(0, bool)
        if not trim.any():
            break
        ends = ends - trim
    some = starts < ends
    starts, ends = starts[some], ends[some]
    return span_hash(prefix_hash(buf), starts, ends), np.searchsorted(starts, offs), starts, ends


def shared(n: int, threshold: float) -> tuple[int, int]:
    """Words of the seeds of an item of ``n`` words, and how many of its positions an alignment that scores ``threshold`` has seeds at.

    ``m`` matches earn 2m of the 2n points, each break between runs of matches
    costs one, so there are at most 2m - 2n * threshold + 1 runs, which hold
    2n * threshold - n - 1 neighbouring pairs or more.  Where that is none, the
    matches themselves are counted.
    """
    pairs = math.ceil((2 * threshold - 1) * n - 1 - 1e-9)
    return (SEED, pairs) if pairs > 0 else (1, max(1, math.ceil(threshold * n - 1e-9)))


def _grams(text: str | None, size: int) -> list[int]:
    raw = np.frombuffer((text or "").casefold().encode(), np.uint8)
    h, _, _, _ = _hashes(raw, np.array([0, len(raw)]))
    return ngram_hash(h, size).view(np.int64).tolist()


def align(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Smith-Waterman over words: best score, and start and end (exclusive) of the aligned words in ``passage``."""
    n, m = len(item), len(passage)
    if not n or not m:
        return 0, 0, 0
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([codes.setdefault(w, len(codes)) for w in passage])
    score, start = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = (0, 0, 0)
    steps = np.arange(n + 1)
    for j in range(m):
        diagonal = score[:-1] + np.where(a == b[j], MATCH, MISMATCH)
        new, src = np.zeros(n + 1, np.int64), np.full(n + 1, j + 1)
        up = score[1:] + GAP
        src[1:] = np.where(diagonal >= up, np.where(score[:-1] > 0, start[:-1], j), start[1:])
        new[1:] = np.maximum(diagonal, up)
        new = np.maximum(new, 0)
        run = np.maximum.accumulate(new - GAP * steps)  # gaps along the item, all at once
        from_left = run + GAP * steps > new
        if from_left.any():
            holder = np.maximum.accumulate(np.where(new - GAP * steps == run, steps, 0))
            src = np.where(from_left, src[holder], src)
            new = np.maximum(new, run + GAP * steps)
        src[new <= 0] = j + 1
        score, start = new, src
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), j + 1)
    return best


def reach(n: int, threshold: float) -> int:
    """Gap words that an alignment of ``n`` item words can hold and still score ``threshold``: each costs one of 2n points."""
    return int(2 * n * (1 - threshold) + 1e-9) + 1


class Item:
    """A benchmark item: its words, seeds as (position, n-gram), hits that a passage needs, and least score."""

    def __init__(self, item_id: int | None, text: str | None, threshold: float):
        self.item_id, self.words = item_id, words(text)
        n = len(self.words)
        self.threshold = threshold if n >= MIN_WORDS else 1.0
        size, self.need = shared(n, self.threshold)
        self.grams = list(enumerate(_grams(text, size)))

    def choose_seeds(self, df: dict[int, int]) -> None:
        """Leave out n-grams: those of no document, which can't be hit, and the most frequent ones, up to half of the hits needed.

        A passage needs that many hits less then.
        """
        out = self.need // 2
        rare = sorted((df.get(g, 0), p, g) for p, g in self.grams)[: len(self.grams) - out]
        self.need -= out
        self.grams = [(p, g) for n, p, g in rare if n]


def _blocks(items: DataFrame, threshold: float, block_words: int) -> Iterator[list[Item]]:
    """The distinct items with a word, in blocks of about ``block_words`` words; an item is never parted."""
    slim = items.select(F.col("item_id").try_cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull()).distinct()
    total = slim.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks if total else 0):
        rows = slim.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        block = [Item(i, t, threshold) for i, t in zip(rows["item_id"].to_pylist(), rows["text"].to_pylist())]
        if block := [x for x in block if x.words]:
            yield block


def document_frequency(docs: DataFrame, grams: np.ndarray) -> dict[int, int]:
    """Number of documents that hold each of ``grams`` (sorted, bounded by the block size)."""
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                h, first, _, _ = _hashes(*_folded(buf, offs)[:2])
                _, doc, slot = _hits(h, first, known)
                if len(doc):
                    pairs = np.unique(doc * len(known) + slot) % len(known)
                    counts += np.bincount(pairs, minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows["gram"].to_pylist(), rows["n"].to_pylist()))


def _find(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(known, values), len(known) - 1)


def _hits(h: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions whose n-gram is in ``known`` (sorted) and stays inside one text, their texts, and their places in ``known``."""
    out = [(np.zeros(0, np.int64),) * 3]
    # A bitmap of the low hash bits drops nearly all positions before the search.
    bits = np.zeros(1 << 20, bool)
    bits[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for size in (1, SEED):
        grams = ngram_hash(h, size)
        if not len(grams) or not len(known):
            continue
        at = np.flatnonzero(bits[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        slot = _find(grams[at], known)
        same = known[slot] == grams[at]
        at, slot = at[same], slot[same]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + size <= first[doc + 1]
        out.append((at[inside], doc[inside], slot[inside]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _passages(pair: np.ndarray, diagonal: np.ndarray, pos: np.ndarray, need: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(pair, least and greatest diagonal) where at least ``need`` positions of the item are hit within ``gap`` diagonals.

    All arrays are by hit.  Overlapping stretches are joined.
    """
    order = np.lexsort((diagonal, pair))
    pair, diagonal, pos, need, gap = (x[order] for x in (pair, diagonal, pos, need, gap))
    width = int(diagonal.max() - diagonal.min() + gap.max() + 1)
    key = pair * width + (diagonal - diagonal.min())
    last = np.searchsorted(key, key + gap, side="right")  # never beyond the pair, as its keys end gap before the next one's
    start = np.arange(len(key))
    full = np.flatnonzero(last - start >= need)
    open_: tuple[int, int, int] | None = None
    for k in full.tolist():
        if last[k] - k < 4096 and len(np.unique(pos[k : last[k]])) < need[k]:
            continue
        p, lo, hi = int(pair[k]), int(diagonal[k]), int(diagonal[last[k] - 1])
        if open_ and open_[0] == p and lo <= open_[2]:
            open_ = (p, open_[1], hi)
        else:
            if open_:
                yield open_
            open_ = (p, lo, hi)
    if open_:
        yield open_


class _Searcher:
    """Finds the items of one block in texts; sent to the tasks once."""

    def __init__(self, block: list[Item]):
        self.items = block
        seeds = sorted((g & (2**64 - 1), k, p) for k, x in enumerate(block) for p, g in x.grams)
        self.known, counts = np.unique(np.array([g for g, _, _ in seeds], np.uint64), return_counts=True)
        self.at_seed = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.item, self.pos = np.array([k for _, k, _ in seeds], np.int64), np.array([p for _, _, p in seeds], np.int64)
        self.need = np.array([x.need for x in block], np.int64)
        self.gaps = np.array([reach(len(x.words), x.threshold) for x in block], np.int64)

    def search(self, texts: pa.Array) -> list[tuple]:
        """(row, item_id, score, start, end) of the best passage of each row and item."""
        rows: list[tuple] = []
        items = self.items
        for a, _, buf, offs in chunks(texts) if len(self.known) else ():
            buf, folded_offs, back = _folded(buf, offs)
            h, first, starts, ends = _hashes(buf, folded_offs)
            at, doc, slot = _hits(h, first, self.known)
            if not len(at):
                continue
            # One row for each hit and each item position that has the n-gram.
            many = np.diff(self.at_seed)[slot]
            seed = np.repeat(self.at_seed[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            item, pos = self.item[seed], self.pos[seed]
            found = _passages(np.repeat(doc, many) * len(items) + item, np.repeat(at, many) - pos, pos, self.need[item], self.gaps[item])
            raw, best = None, {}
            for pair, low, high in found:
                d, k = divmod(pair, len(items))
                target, slack = items[k].words, int(self.gaps[k])
                lo = max(int(first[d]), low - slack)
                hi = min(int(first[d + 1]), high + len(target) + slack)
                raw = buf.tobytes() if raw is None else raw
                passage = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                got, x, y = align(target, passage)
                score = got / (MATCH * len(target))
                if score >= items[k].threshold and score > best.get((d, k), (0.0,))[0]:
                    best[d, k] = (score, lo + x, lo + y)
            rows += [(a + d, items[k].item_id, score, int(back[starts[x]] - offs[d]), int(back[ends[y - 1]] - offs[d])) for (d, k), (score, x, y) in best.items()]
        return rows


def _searchers(docs: DataFrame, items: DataFrame, threshold: float, block_words: int) -> Iterator:
    """A broadcast searcher for each block of items, with seeds that are rare in ``docs``."""
    for block in _blocks(items, threshold, block_words):
        known = np.unique(np.array([g for x in block for _, g in x.grams], np.int64).view(np.uint64))
        df = document_frequency(docs, known)
        for x in block:
            x.choose_seeds(df)
        yield docs.sparkSession.sparkContext.broadcast(_Searcher(block))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and item of which a copy, exact or edited, stands in the document.

    Returns doc_id, item_id, score (best alignment over that of a full copy, 0
    to 1), start and end (bytes of the UTF-8 text that the passage covers).
    The best passage of each item is given, the first on ties.  An item of fewer
    than ``MIN_WORDS`` words counts where all its words stand in a row; one
    without words is in no document.  Items are told apart by id and text: all
    texts of a repeated or null item_id are searched, and each that is found gives
    a row; repeated items count once.  Null texts have no words; repeated
    documents are judged each; ids that aren't numbers become null; an empty
    table on either side gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(doc_id(), "text")
    schema = "doc_id long, item_id long, score double, start long, end long"
    names = ["doc_id", "item_id", "score", "start", "end"]
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = shared.value.search(batch.column(1))
                index = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1))], names=names)

        return slim.mapInArrow(run, schema)

    out = None
    for shared in _searchers(docs, items, threshold, block_words):
        found = searched(shared)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item was found; nulls and edge cases as in ``find_leaks``.

    Every block of items is one narrow pass over the rows; nothing is joined.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def passed(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in shared.value.search(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        return map_rows(rows, run)

    out = docs
    for shared in _searchers(docs, items, threshold, block_words):
        out = passed(out, shared)
    return out
