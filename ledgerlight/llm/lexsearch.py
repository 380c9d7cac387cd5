"""Exact ranked search over dual-sorted posting lists in wavelet trees, one tree per shard.

A shard holds the documents of a stretch of an input partition, numbered by
ascending doc_id.  The posting lists of all its terms, each ordered by impact
(highest first), stand one after another in a sequence of document numbers,
and that sequence is a wavelet tree: each level splits the documents of a node
in two halves and keeps the order of postings on either side.  So one structure
is sorted both ways.  A list mapped into a node is still ordered by impact, hence its first
posting there is the highest of that list among the node's documents; and a
leaf holds all postings of one document.

A search starts with the items' lists at the root and always opens the node of
the highest bound, the sum of its lists' first impacts.  Opening maps the lists
into both halves by bit ranks; a list's first posting goes to one of them, and
that of the other half is found by following its bits down.  Nodes of a few
documents are finished by following all their postings down.  A node whose
bound can't beat the worst result so far is dropped, so the result is exact.

Shards are built where documents are read, so no text is shuffled; each task
sends at most ``k`` results an item.  The index holds every term and knows no
item: it is written once and can be searched any number of times.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from .runtime import materialize, small_batches

TOP = 10
#: Text bytes and documents after which a shard is closed (its last document may be of any size).
SHARD_BYTES, SHARD_DOCS = 32 << 20, 1 << 16
#: Terms of items that are searched together, at most but for a single item's; documents of a node that is finished at once, as a power of two; nodes opened an item and round.
BLOCK_TERMS, FINISH, AT_ONCE = 1 << 18, 32, 4
#: Constants of the score.
WEIGHT, IMPACT, LENGTH_SHARE, LENGTH_FACTOR = 1000, 10**9, 90, 8

#: Bytes to term bytes: letters A-Z lower, digits, lower-case letters and all bytes beyond ASCII as they are, all others to blanks.
_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order, with repeats."""
    return raw.translate(_BYTES).split()


def _raw(text) -> bytes:
    buffer = text.as_buffer()
    return b"" if buffer is None else buffer.to_pybytes()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(terms(_raw(t))) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _fields(key: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("n_docs", T.LongType()),
            T.StructField("n_terms", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(key)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("doc_terms", T.BinaryType()),
            T.StructField("bits", T.BinaryType()),
            T.StructField("tf", T.BinaryType()),
        ]
    )


def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (IMPACT * tf) // (WEIGHT * tf + LENGTH_FACTOR * length)


def wavelet(docs: np.ndarray, levels: int) -> np.ndarray:
    """Bits of a sequence of document numbers, one row of 64-bit words (and one empty word) per level."""
    words = len(docs) // 64 + 1
    out = np.zeros((levels, words), np.uint64)
    docs = docs.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels):
        packed = np.packbits((docs >> (levels - 1 - level)) & 1, bitorder="little")
        out[level].view(np.uint8)[: len(packed)] = packed
        docs = docs[np.argsort(docs >> (levels - 1 - level), kind="stable")]
    return out


class _Builder:
    """Gathers the documents of one shard."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.vocabulary: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, raw: bytes) -> None:
        found = terms(raw)
        if not found:
            return
        counts, known = Counter(found), self.vocabulary
        self.ids.append(doc_id)
        self.lengths.append(100 - LENGTH_SHARE + LENGTH_SHARE * len(found) * self.n_docs // self.n_terms)
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.bytes += len(raw)

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def row(self, shard: int, key: pa.DataType) -> pa.RecordBatch:
        ids = pa.array(self.ids, key)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        n = len(order)
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        lengths = np.array(self.lengths, np.int64)[order]
        vocabulary = sorted(self.vocabulary)
        renumber = np.empty(len(vocabulary), np.int32)
        renumber[[self.vocabulary[t] for t in vocabulary]] = np.arange(len(vocabulary), dtype=np.int32)
        sizes = np.array([len(x) for x in self.terms])
        doc, term, tf = np.repeat(place, sizes), renumber[np.concatenate(self.terms)], np.concatenate(self.tfs)
        impacts = impact(tf.astype(np.int64), lengths[doc]).astype(np.int32)
        lists = np.lexsort((doc, -impacts, term))
        leaves = np.lexsort((term, doc))
        columns = [
            pa.array([shard], pa.int64()),
            pa.array([self.n_docs], pa.int64()),
            pa.array([self.n_terms], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.take(pa.array(order))),
            *(
                pa.array([x], pa.binary())
                for x in (
                    lengths.tobytes(),
                    b" ".join(vocabulary),
                    np.bincount(term, minlength=len(vocabulary)).astype(np.int32).tobytes(),
                    sizes[order].astype(np.int32).tobytes(),
                    wavelet(doc[lists], max(0, (n - 1).bit_length())).tobytes(),
                    tf[leaves].tobytes(),
                )
            ),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_fields(T.LongType()).names)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all ``docs`` (doc_id, text): one row per shard, written to the shared folder.

    A null text has no terms; documents without terms can't be found and aren't
    stored; repeated rows are documents of their own; a doc_id may be null and of
    any type that can be ordered; a text of any length is one document.  Other
    columns are not read.  The text is read twice: the corpus's size, which orders
    the lists, comes first.
    """
    small_batches(docs.sparkSession)
    n_docs, n_terms = corpus_size(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, builder = TaskContext.get().partitionId() << 32, _Builder(n_docs, n_terms)
        key = None
        for b in batches:
            key = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                builder.add(doc_id, _raw(text))
                if builder.full():
                    yield builder.row(number, key)
                    number, builder = number + 1, _Builder(n_docs, n_terms)
        if builder.ids:
            yield builder.row(number, key)

    return materialize(docs.select("doc_id", "text").mapInArrow(build, _fields(docs.schema["doc_id"].dataType)), "lexical-index")


class Shard:
    """One shard's tree, with ranks."""

    def __init__(self, doc_ids: list, lengths: bytes, vocabulary: bytes, counts: bytes, doc_terms: bytes, bits: bytes, tf: bytes):
        self.doc_ids = doc_ids
        self.lengths = np.frombuffer(lengths, np.int64)
        self.tf = np.frombuffer(tf, np.int32)
        self.vocabulary = vocabulary.split(b" ")
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)])
        n = len(doc_ids)
        self.levels = max(0, (n - 1).bit_length())
        self.words = np.frombuffer(bits, np.uint64)
        self.width = len(self.tf) // 64 + 1
        ones = np.bitwise_count(self.words).astype(np.int64).reshape(self.levels, self.width)
        self.before = (np.cumsum(ones, axis=1) - ones).ravel()
        #: Postings of the documents before each one, up to the full number of leaves.
        self.starts = np.full((1 << self.levels) + 1, len(self.tf), np.int64)
        self.starts[: n + 1] = np.concatenate([[0], np.cumsum(np.frombuffer(doc_terms, np.int32), dtype=np.int64)])

    def rank(self, level, place) -> np.ndarray:
        """Ones of the level's row before each place."""
        at = level * self.width + (place >> 6)
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & below)

    def down(self, level: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, its impact) of the postings at ``place`` in nodes given by level and first document."""
        level, doc, place = level.copy(), doc.copy(), place.copy()
        live = np.flatnonzero(level < self.levels)
        while len(live):
            lv, d, p = level[live], doc[live], place[live]
            one = (self.words[lv * self.width + (p >> 6)] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            start = self.starts[d]
            ones = self.rank(lv, p) - self.rank(lv, start)
            half = np.int64(1) << (self.levels - 1 - lv)
            place[live] = np.where(one, self.starts[d + half] + ones, p - ones)
            doc[live] = d + np.where(one, half, 0)
            level[live] = lv + 1
            live = live[lv + 1 < self.levels]
        return doc, impact(self.tf[place].astype(np.int64), self.lengths[doc])


def _later(doc_id) -> tuple:
    return doc_id is None, doc_id


class _Best:
    """The ``k`` best results of an item so far; ties go to the smaller doc_id, null being the largest."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def takes(self, score: int, doc_id) -> bool:
        """Whether a result of that score, or of less, and of that id, or a later one, can still enter."""
        if score <= 0:
            return False
        if len(self.rows) < self.k:
            return True
        worst = self.rows[-1]
        return score > worst[0] or (score == worst[0] and _later(doc_id) < _later(worst[1]))

    def add(self, score: int, doc_id) -> None:
        if self.takes(score, doc_id):
            self.rows.append((score, doc_id))
            self.rows.sort(key=lambda r: (-r[0], *_later(r[1])))
            del self.rows[self.k :]


def search_shard(shard: Shard, items: list[tuple[np.ndarray, np.ndarray]], best: list[_Best]) -> int:
    """Bring ``best`` up to date with a shard; ``items`` are (term numbers, weights).  Returns how many nodes were opened.

    All items advance together, a few nodes each a round, so that ranks are whole-array steps.
    """
    levels, starts, ids = shard.levels, shard.starts, shard.doc_ids
    heaps: list[list] = [[] for _ in items]
    made = opened = 0
    sizes = np.array([len(t) for t, _ in items], np.int64)
    if not sizes.sum():
        return 0
    which = np.concatenate([t for t, _ in items])
    weights = np.concatenate([w for _, w in items])
    low, high = shard.offsets[which], shard.offsets[which + 1]
    none = np.zeros(len(which), np.int64)
    first = weights * shard.down(none, none, low)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        bound = int(first[a:b].sum())
        if a < b and best[i].takes(bound, ids[0]):
            heaps[i].append((-bound, made, 0, 0, low[a:b], high[a:b], weights[a:b], first[a:b]))
            made += 1
    active = [i for i, h in enumerate(heaps) if h]
    finish = max(0, levels - (FINISH - 1).bit_length())
    while active:
        popped, small = [], []
        for i in active:
            heap, mine = heaps[i], best[i]
            for _ in range(AT_ONCE):
                if not heap:
                    break
                node = heappop(heap)
                if not mine.takes(-node[0], ids[node[3]]):
                    if len(mine.rows) == mine.k and -node[0] < mine.rows[-1][0]:
                        heap.clear()
                    continue
                (small if node[2] >= finish else popped).append((i, node))
        opened += len(popped) + len(small)
        if small:
            _finish(shard, small, best)
        if popped:
            owner = np.repeat(np.arange(len(popped)), [len(n[4]) for _, n in popped])
            level = np.array([n[2] for _, n in popped], np.int64)
            doc = np.array([n[3] for _, n in popped], np.int64)
            low, high, weights, first = (np.concatenate([n[k] for _, n in popped]) for k in (4, 5, 6, 7))
            half = np.int64(1) << (levels - 1 - level)
            start, middle = starts[doc], starts[doc + half]
            base = shard.rank(level, start)
            lv = level[owner]
            ones_low = shard.rank(lv, low) - base[owner]
            ones_high = shard.rank(lv, high) - base[owner]
            right = (shard.words[lv * shard.width + (low >> 6)] >> (low & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            for side in (0, 1):
                a, b = (middle[owner] + ones_low, middle[owner] + ones_high) if side else (low - ones_low, high - ones_high)
                there = np.flatnonzero(a < b)
                if not len(there):
                    continue
                a, b, own, w = a[there], b[there], owner[there], weights[there]
                child = doc + half if side else doc
                top = first[there]
                new = np.flatnonzero(right[there] != bool(side))  # the list's first posting went to the other half
                if len(new):
                    top[new] = w[new] * shard.down(level[own[new]] + 1, child[own[new]], a[new])[1]
                bounds = np.zeros(len(popped), np.int64)
                np.add.at(bounds, own, top)
                cut = np.searchsorted(own, np.arange(len(popped) + 1)).tolist()
                for k, (bound, x, y, d) in enumerate(zip(bounds.tolist(), cut[:-1], cut[1:], child.tolist())):
                    if x < y:
                        i, node = popped[k]
                        if best[i].takes(bound, ids[d]):
                            heappush(heaps[i], (-bound, made, node[2] + 1, d, a[x:y], b[x:y], w[x:y], top[x:y]))
                            made += 1
        active = [i for i in active if heaps[i]]
    return opened


def _finish(shard: Shard, nodes: list[tuple[int, tuple]], best: list[_Best]) -> None:
    """Score all documents of small nodes exactly, from all their postings."""
    span = 1 << (shard.levels - nodes[0][1][2])  # all stand on the first level that is finished
    owner = np.repeat(np.arange(len(nodes)), [len(n[4]) for _, n in nodes])
    low, high, weights = (np.concatenate([n[k] for _, n in nodes]) for k in (4, 5, 6))
    level, doc = (np.array([n[k] for _, n in nodes], np.int64) for k in (2, 3))
    sizes = high - low
    place = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    own = np.repeat(owner, sizes)
    found, impacts = shard.down(level[own], doc[own], place)
    scores = np.zeros(len(nodes) * span, np.int64)
    np.add.at(scores, own * span + found - doc[own], np.repeat(weights, sizes) * impacts)
    worst = np.array([mine.rows[-1][0] if len(mine.rows) == mine.k else 1 for mine in (best[i] for i, _ in nodes)], np.int64)
    for at in np.flatnonzero(scores >= np.repeat(worst, span)).tolist():
        i, node = nodes[at // span]
        best[i].add(int(scores[at]), shard.doc_ids[node[3] + at % span])


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    """(number, item_id, distinct terms) of all items, in blocks of about ``size`` terms; they come one partition at a time."""
    block, held = [], 0
    for number, row in enumerate(items.select("item_id", "text").distinct().toLocalIterator()):
        found = sorted(set(terms((row["text"] or "").encode("utf-8", "replace"))))
        if block and held + len(found) > size:
            yield block
            block, held = [], 0
        if found:
            block.append((number, row["item_id"], found))
            held += len(found)
    if block:
        yield block


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) its ``k`` best documents with a score above 0.

    Items are told apart by id and text: each text of a repeated or null item_id
    is ranked for itself, and repeated items count once.  Items without terms,
    or without a term that any document holds, give no rows.  Equal scores are
    ranked by ascending doc_id, null last.  The items are a stated query set,
    taken in blocks of bounded size; each block reads the index once for document
    counts (terms only) and once to search.
    """
    spark = index.sparkSession
    small_batches(spark)
    key, item_type = index.schema["doc_ids"].dataType.elementType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", item_type), T.StructField("doc_id", key), T.StructField("score", T.LongType())])
    size = index.agg(F.max("n_docs")).first()[0]
    out = None
    for block in _blocks(items, block_terms) if size else ():
        wanted = spark.sparkContext.broadcast(frozenset(t for _, _, found in block for t in found))

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for vocabulary, counts in zip(b.column(0), b.column(1)):
                    rows = [(t, n) for t, n in zip(_raw(vocabulary).split(b" "), np.frombuffer(_raw(counts), np.int32).tolist()) if t in wanted.value]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

        df = {bytes(r[0]): r[1] for r in index.select("terms", "counts").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n")).collect()}
        weighted = [(number, item_id, [(t, w) for t in found if (w := weight(size, df[t]) if t in df else 0) > 0]) for number, item_id, found in block]
        shared = spark.sparkContext.broadcast(weighted)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best = [_Best(k) for _ in asked]
            names = {t for _, _, found in asked for t, _ in found}
            kind = None
            for b in batches:
                kind = b.schema.field(0).type.value_type
                for r in range(b.num_rows):
                    shard = Shard(b.column(0)[r].as_py(), *(_raw(b.column(c)[r]) for c in range(1, 7)))
                    at = {t: i for i, t in enumerate(shard.vocabulary) if t in names}
                    here = [[(at[t], w) for t, w in found if t in at] for _, _, found in asked]
                    search_shard(shard, [(np.array([x[0] for x in h], np.int64), np.array([x[1] for x in h], np.int64)) for h in here], best)
            rows = [(number, item_id, *reversed(row)) for (number, item_id, _), of in zip(asked, best) for row in of.rows]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], to_arrow(item_type)), pa.array(columns[2], kind or to_arrow(key)), pa.array(columns[3], pa.int64())], names=schema.names)

        found = index.select("doc_ids", "lengths", "terms", "counts", "doc_terms", "bits", "tf").mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = TOP) -> str:
    """The same rows by DuckDB, from all postings of the items' terms."""
    find = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH words AS (
        SELECT doc_id, {find} AS found FROM documents
    ), size AS (
        SELECT count(*) AS docs, sum(len(found))::BIGINT AS terms FROM words WHERE len(found) > 0
    ), wanted AS (
        SELECT DISTINCT item_id, unnest({find}) AS term FROM benchmark
    ), postings AS (
        SELECT doc_id, any_value(n) AS n, term, count(*) AS tf
        FROM (SELECT doc_id, len(found) AS n, unnest(found) AS term FROM words)
        WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term
    ), weights AS (
        SELECT term, floor({WEIGHT} * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, size GROUP BY term
    ), scored AS (
        SELECT item_id, doc_id, sum(w * (({IMPACT} * tf) // ({WEIGHT} * tf + {LENGTH_FACTOR} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // terms))))::BIGINT AS score
        FROM wanted JOIN postings USING (term) JOIN weights USING (term), size GROUP BY item_id, doc_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}
    """
