"""Language identification by words first, with backoff to shorter and shorter character n-grams.

Training counts words and character n-grams per language over a bounded,
documented sample of labelled texts.  A word that was seen scores by its
log frequency in each language.  An unseen word is read from left to right:
at each place the longest n-gram known there (``MAX_GRAM`` characters, then one
fewer, down to one) scores with its log frequency, discounted per step back.
The model is bounded by its parameters, so it is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import map_rows, quoted, small_batches

#: Labelled texts taken at most (those whose id hashes lowest), and n-gram length.  Every word and n-gram of the sample is learned.
SAMPLE, MAX_GRAM = 4000, 4
#: Factor for each character that an n-gram is shorter than the longest, and words remembered by a worker.
BACKOFF, REMEMBERED = 0.6, 400_000

_WORD = re.compile(r"[^\W\d_]+")
#: Combining marks of the basic plane and of the planes beyond it; a class of both is searched by ranges, many times as slowly.
_BASIC, _BEYOND = ("".join(chr(c) for c in r if unicodedata.category(chr(c))[0] == "M") for r in (range(0x300, 0x10000), range(0x10000, 0x20000)))
_MARK, _FAR_MARK = re.compile(f"[{_BASIC}]"), re.compile(f"[{_BEYOND}]")
_MARKED_WORD = re.compile(rf"(?:[^\W\d_]|[{_BASIC}{_BEYOND}])+")


def _marked(text: str) -> bool:
    """Whether a mark stands in ``text``; only texts with characters beyond the basic plane are searched for marks from there."""
    if text.isascii():
        return False
    return bool(_MARK.search(text)) or (len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text) and bool(_FAR_MARK.search(text)))


def tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and of the marks that combine with them (as in Indic scripts)."""
    text = text.lower()
    return (_MARKED_WORD if _marked(text) else _WORD).findall(text)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id's text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Rows(dict):
    """Word to row of the score matrix; a word that isn't there is scored by its n-grams and remembered."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model = model
        self.matrix = np.vstack([model.word_scores, np.zeros((1024, len(model.langs)), np.float32)])

    def __missing__(self, w: str) -> int:
        row = len(self)
        if row == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[row] = self.model.backoff(w)
        self[w] = row
        return row


class Model:
    """Per-language log scores of words and character n-grams, as differences from the mean over the languages."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: dict[str, list[int]], totals: tuple[list[int], list[int]]):
        """``words`` and ``grams`` map to counts per language; ``totals`` are all words and all n-grams per language."""
        self.langs = langs

        def scores(counts: dict[str, list[int]], total: list[int]) -> np.ndarray:
            table = np.array(list(counts.values()), float).reshape(-1, max(1, len(langs)))
            logs = np.log((table + 0.5) / (np.array(total or [0], float) + 1))
            return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

        self.words = {k: i for i, k in enumerate(words)}
        self.grams = {k: i for i, k in enumerate(grams)}
        self.word_scores = scores(words, totals[0])
        back = np.array([BACKOFF ** (MAX_GRAM - len(g)) for g in grams], np.float32).reshape(-1, 1)
        self.gram_scores = scores(grams, totals[1]) * back
        self.rows: _Rows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def backoff(self, w: str) -> np.ndarray:
        """Scores of an unseen word: at each place the longest known n-gram."""
        padded, found, get = f"_{w}_", [], self.grams.get
        size = len(padded)
        for i in range(size):
            for j in range(min(i + MAX_GRAM, size), i, -1):
                g = get(padded[i:j])
                if g is not None:
                    found.append(g)
                    break
        if not found:
            return np.zeros(len(self.langs), np.float32)
        return self.gram_scores[found].sum(axis=0) / size**0.5

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the evidence, 0 to 1; ``und`` and 0 for a text without letters."""
        found = tokens(text) if text and self.langs else []
        if not any(c.isalpha() for w in found for c in w):  # superscripts and the like are no letters
            return "und", 0.0
        if self.rows is None or len(self.rows) > len(self.words) + REMEMBERED:
            self.rows = _Rows(self)
        at = np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))
        score = self.rows.matrix[at].sum(axis=0, dtype=np.float64)
        score *= min(1.0, 40 / len(found))  # words of a text aren't independent
        p = np.exp(score - score.max())
        k = int(score.argmax())
        return self.langs[k], float(p[k] / p.sum())


def _tokens(lang: str, texts: list[str]) -> Iterator[tuple[int, str, str, int]]:
    words: Counter[str] = Counter()
    for t in texts:
        words.update(tokens(t))
    grams: Counter[str] = Counter()
    for w, c in words.items():
        padded = f"_{w}_"
        for i in range(len(padded)):
            for n in range(1, min(MAX_GRAM, len(padded) - i) + 1):
                grams[padded[i : i + n]] += c
    for kind, table in ((0, words), (1, grams)):
        for k, c in table.items():
            yield kind, lang, k, c


def train(labelled: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows with a text and a label, chosen by a hash of their key, the same at every run.

    Counting is distributed; the driver gets the distinct words and n-grams of
    the sample, which bounds them.  Rows without text or label teach nothing,
    repeated rows count as often as they occur, rows whose hash is the bound's are
    taken up to the bound, and an empty table gives a model that knows no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col(key), "text").alias("_h"))
    last = rows.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]  # ids only: texts of other rows aren't moved
    rows = rows.filter(F.col("_h") <= F.lit(0 if last is None else last)).limit(sample).select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
        for lang, of in texts.items():
            found = list(_tokens(lang, of))
            columns = list(zip(*found)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["kind", "lang", "token", "n"])

    counts = rows.mapInArrow(count, "kind int, lang string, token string, n long").groupBy("kind", "lang", "token").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    tables: tuple[dict, dict] = ({}, {})
    totals = ([0] * len(langs), [0] * len(langs))
    for kind, lang, token, n in zip(*(found[c].to_pylist() for c in ("kind", "lang", "token", "n"))):
        tables[kind].setdefault(token, [0] * len(langs))[at[lang]] = n
        totals[kind][at[lang]] += n
    return Model(langs, tables[0], tables[1], totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and, after them, lang_pred and score, from the whole ``text`` alone.

    A null, empty or letterless text gives ``und`` and 0; ties go to the first
    language in alphabetical order; rows are neither added nor dropped.  If the
    input has columns named lang_pred or score, these are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[f"c{i}" for i in range(len(kept) + 2)])

    return map_rows(docs.select(*quoted(kept)), run, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
