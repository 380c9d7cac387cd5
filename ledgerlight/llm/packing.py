"""Packing documents into training sequences by order-preserving dynamic programming.

Documents of an input partition form one token stream, in row order.  Cuts are
chosen among document ends, sentence ends and (in long stretches without either)
a token grid, so that the sum of padding and cut penalties is least.  With
``best[i]`` the least cost of the stream's first ``i`` tokens,

    best[i] = penalty(i) + min over i - window <= j < i of best[j] + window - (i - j)

so the inner minimum is over ``best[j] + j``: a monotone queue gives it in
amortised constant time.  Padding counts as lost room at every length: a short
power of two, which needs no padding, would lose the rest of a sequence all the
same.  Only a task's last window of tokens, which cannot fill its sequence, may
be cut into powers of two; they enter there as direct transitions.  The stream
is cut in bounded buffers; the last sequence of a buffer is carried into the
next one.

Nothing is shuffled: each task packs what it scans, so the plan is one narrow
stage at any size, and a lost task is redone alone with the same result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import doc_id, small_batches

WINDOW = 2048
EOS = 1
#: Costs, in tokens of padding: of any sequence, of a cut at a sentence end inside a document, of a cut elsewhere inside one.
OPEN_COST, SENTENCE_COST, HARD_COST = 8.0, 8.0, 32.0
#: Tokens between the grid's cut places, and tokens held before a buffer is cut.
GRID, BUFFER_TOKENS = 64, 1 << 20

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("input_ids", T.BinaryType()),
    ]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """A byte-level BPE of the vocabulary and merges in ``path``, and the flags of ids that end a sentence.

    The file is the JSON form of a public tokenizer.  Ids equal those that the
    ``tokenizers`` library's ``encode`` gives for every text: the string of an
    added token has that token's id, and parts the text.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(printable))}
    raw = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in to_byte for c in token) and token not in added}
    encoder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens=added)
    ends = np.zeros(max(*raw.values(), *added.values()) + 1, bool)
    for token, i in raw.items():
        ends[i] = token.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in token
    ends[[EOS, *added.values()]] = True
    return encoder, ends


def token_ids(encoder, text: str | None) -> np.ndarray:
    """Ids of a text (null: empty) and the end mark."""
    return np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), EOS).astype(np.uint32, copy=False)


def choose_cuts(n: int, places: np.ndarray, costs: np.ndarray, window: int, tail: int | None = None) -> list[int]:
    """Ends of the sequences of a stream of ``n`` tokens.

    Sequences from place ``tail`` on (none by default) have no cost of padding
    at a power of two.

    ``places`` are the allowed cut places in rising order, the last being ``n``;
    consecutive ones, and 0 and the first, are at most ``window`` apart.
    ``costs`` are their penalties.  Ties go to the longer sequence.
    """
    at = places.tolist()
    cost = costs.tolist()
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    tail = n if tail is None else tail
    best, back = {0: 0.0}, {}
    queue: deque[tuple[int, float]] = deque([(0, 0.0)])  # rising in best[j] + j
    get = best.get
    for i, c in zip(at, cost):
        while queue[0][0] < i - window:
            queue.popleft()
        j, key = queue[0]
        low, source = key + window - i, j
        if i > tail:
            for p in powers:
                b = get(i - p) if i - p >= tail else None
                if b is not None and b < low:
                    low, source = b, i - p
        low += c + OPEN_COST
        best[i], back[i] = low, source
        key = low + i
        while queue and queue[-1][1] > key:
            queue.pop()
        queue.append((i, key))
    cuts, i = [], n
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def cut_places(ends: np.ndarray, doc_ends: np.ndarray, window: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Allowed places and their penalties; ``ends`` flags tokens that end a sentence, ``doc_ends`` are document ends."""
    n = len(ends)
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(ends) + 1] = SENTENCE_COST
    marks = np.concatenate([[0], np.flatnonzero(np.isfinite(cost)), [n]])
    gaps = np.diff(marks)
    for g in np.flatnonzero(gaps > GRID):
        cost[marks[g] + GRID : marks[g + 1] : GRID] = HARD_COST
    if last:  # the tail may be cut into lengths that need no padding
        tail = np.arange(n - GRID, max(0, n - window), -GRID)
        cost[tail] = np.minimum(cost[tail], HARD_COST)
    cost[doc_ends] = 0.0
    cost[n] = 0.0
    cost[0] = np.inf
    places = np.flatnonzero(np.isfinite(cost))
    return places, cost[places]


class _Packer:
    """Cuts one task's stream; rows of the pieces gather in ``out``."""

    def __init__(self, partition: int, window: int, sentence_ends: np.ndarray, with_ids: bool):
        self.next_id, self.window, self.sentence_ends, self.with_ids = partition << 36, window, sentence_ends, with_ids
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, start of what is held, ids held, all ids
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= BUFFER_TOKENS:
            self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.held:
            return
        stream = np.concatenate([d[2] for d in self.docs])
        doc_ends = np.cumsum([len(d[2]) for d in self.docs])
        places, costs = cut_places(self.sentence_ends[stream], doc_ends, self.window, last)
        cuts = choose_cuts(len(stream), places, costs, self.window, max(0, len(stream) - self.window) if last else None)
        if not last:
            cuts = cuts[:-1]
        done, k, a = 0, 0, 0
        for end in cuts:
            offset = 0
            while a < end:
                doc_id, start, ids, total = self.docs[k]
                first = int(doc_ends[k]) - len(ids)
                b = min(end, int(doc_ends[k]))
                piece = stream[a:b].astype("<u4", copy=False).tobytes()
                self.out.append((doc_id, start + a - first, b - a, zlib.crc32(piece), total, self.next_id, offset, piece if self.with_ids else None))
                offset += b - a
                a = b
                k += b == doc_ends[k]
            self.next_id += 1
            done = end
        rest = []
        for (doc_id, start, ids, total), end in zip(self.docs[k:], doc_ends[k:]):
            first = int(end) - len(ids)
            skip = max(0, done - first)
            rest.append((doc_id, start + skip, ids[skip:], total))
        self.docs, self.held = rest, len(stream) - done

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [[]] * len(SCHEMA)
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SCHEMA.names)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Takes ``doc_id`` and ``text``; other columns, whatever their names, are not
    read.  Returns one row per piece (see ``SCHEMA``); ``input_ids`` holds the
    piece's ids as little-endian unsigned 32-bit integers, or null without
    ``with_ids``.  A null or empty text is a document of one id, the end mark;
    a null ``doc_id`` is kept; repeated rows are packed as often as they occur;
    texts of any length are cut as often as needed; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = load_encoder(path)
        packer = _Packer(TaskContext.get().partitionId(), window, ends, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, token_ids(encoder, text.as_py()))
                if len(packer.out) >= 4096:
                    yield packer.take()
        packer.flush(True)
        yield packer.take()

    return docs.select(doc_id(), F.col("text")).mapInArrow(run, SCHEMA)
