"""Plain, slow statements of what the corpus operators compute."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def shingle_set(text, n, lower=True):
    w = WORD.findall((text or "").translate(LOWER) if lower else text or "")
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(rows, n, num, den):
    """doc index -> (set size, least index reachable)."""
    sets = [shingle_set(t, n) for _, t in rows]
    index, parent = defaultdict(list), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in index[g])
        for j, c in common.items():
            if c * den >= num * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(i)
    return [(len(sets[i]), root(i)) for i in range(len(rows))]


def repeats(texts, length):
    """(bytes, removed, spans, sha256 of the rest) of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + length] for t in raw for s in range(len(t) - length + 1))
    out = []
    for t in raw:
        spans = []
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        out.append((len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def counts(text):
    """The base counts of the quality rules."""
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def clashing(df):
    """``df`` with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("key", "_key", "shard", "sid", "token", "size", "h", "score", "spans", "site", "n", "a", "kept", "_flags", "_c", "part", "chunk", "target", "label", "lang_pred", "a.b")
    return df.withColumns({c: F.lit("x") for c in names})
