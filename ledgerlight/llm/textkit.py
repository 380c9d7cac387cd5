"""Vectorised text kernels shared by the corpus operators.

Texts of an Arrow batch are viewed as one byte buffer plus offsets; words, word
hashes and shingles come from whole-array numpy steps, so no Python loop runs
over characters or words.  White space is the ASCII set 0x20, 0x09-0x0D, a word
is a maximal run of other bytes.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse, modulo 2**64, for exponents 0..n."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        down[0] = 1
        _powers["up"] = np.multiply.accumulate(up)
        _powers["down"] = np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits of a hash are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive pieces of about ``limit`` bytes."""
    raw, offs = buffer_of(texts)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 entries)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~SPACE[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: entry i covers the first i bytes."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the first word's index of each text (n + 1 entries)."""
    if lower:
        buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return span_hash(prefix_hash(buf), starts, ends), first


_FACTORS = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25)]


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len(words) - n + 1 entries, or none)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        h += words[k : k + m] * _FACTORS[k % 8] + np.uint64(k)
        h = h ^ (h >> np.uint64(29))
    return mix(h)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text (repeats kept) and each text's first index among them.

    A text with fewer than ``n`` words, but at least one, has one shingle: its whole sequence.
    """
    grams, counts = ngram_hash(words, n), np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint64)
    full = counts >= n
    if full.any():
        idx = np.arange(sizes[full].sum()) - np.repeat(np.cumsum(sizes[full]) - sizes[full], sizes[full])
        out[np.repeat(at[:-1][full], sizes[full]) + idx] = grams[np.repeat(first[:-1][full], sizes[full]) + idx]
    for i in np.flatnonzero((counts > 0) & ~full):
        out[at[i]] = ngram_hash(words[first[i] : first[i + 1]], int(counts[i]))[0]
    return out, at
