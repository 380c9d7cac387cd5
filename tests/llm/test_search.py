"""Ranked lexical search: the wavelet trees, and results against a plain ranking."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import lexsearch as S
from ledgerlight.llm import queries

from ..conftest import DATA
from . import helpers as H

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(H.LOWER))


def plain_ranking(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text), all different."""
    found = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c, n in found:
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item_id, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 700])
def test_tree_maps_lists_down(n):
    """Every posting leads to its document and impact, and ranks count ones."""
    r = random.Random(n)
    builder = S._Builder(n, 20 * n)
    ids = r.sample(range(10 * n), n)
    texts = [[f"t{min(r.randrange(40), r.randrange(40))}" for _ in range(r.randrange(1, 40))] for _ in range(n)]
    for i, t in zip(ids, texts):
        builder.add(i, " ".join(t).encode())
    row = builder.row(5, pa.int64())
    shard = S.Shard(row.column(3)[0].as_py(), *(S._raw(row.column(c)[0]) for c in range(4, 10)))
    assert shard.doc_ids == sorted(ids) and shard.vocabulary == sorted({w.encode() for t in texts for w in t})
    by_id = dict(zip(ids, texts))
    total = len(shard.tf)
    zero = np.zeros(total, np.int64)
    doc, impacts = shard.down(zero, zero, np.arange(total))
    for t, a, b in zip(shard.vocabulary, shard.offsets[:-1], shard.offsets[1:]):
        listed = [(int(impacts[p]), shard.doc_ids[doc[p]]) for p in range(a, b)]
        lengths = {i: 10 + 90 * len(x) * n // (20 * n) for i, x in by_id.items()}
        want = [(10**9 * c // (1000 * c + 8 * lengths[i]), i) for i, x in by_id.items() if (c := x.count(t.decode()))]
        assert listed == sorted(want, key=lambda x: (-x[0], x[1]))
    for level in range(shard.levels):
        ones = np.unpackbits(shard.words[level * shard.width : (level + 1) * shard.width].view(np.uint8), bitorder="little")
        at = np.arange(total + 1)
        assert (shard.rank(np.full(total + 1, level), at) == np.concatenate([[0], np.cumsum(ones)])[: total + 1]).all()


@pytest.mark.parametrize("finish,at_once,shard_docs", [(1, 1, 17), (4, 2, 1 << 16), (32, 4, 100)])
def test_equals_a_plain_ranking(spark, monkeypatch, finish, at_once, shard_docs):
    monkeypatch.setattr(S, "FINISH", finish)
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    monkeypatch.setattr(S, "SHARD_DOCS", shard_docs)
    r = random.Random(finish)
    docs = [(i, " ".join(f"W{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randrange(0, 60)))) for i in r.sample(range(5000), 600)]
    docs += [(6000 + i, docs[3][1]) for i in range(25)] + [(7000, None), (7001, ""), (7002, "w1 " * 40_000), (7003, "Été\u00a0x w1_w2\x00W3"), (None, docs[5][1]), (docs[9][0], docs[9][1])]
    items = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 320}" for _ in range(r.randrange(1, 30)))) for i in range(30)]
    items += [(40, docs[3][1]), (41, None), (42, " -- "), (43, "nowhere"), (44, "été\u00a0X"), (45, "Été\u00a0x w3 w3 w3")]
    index = S.build_index(H.clashing(H.documents(spark, docs).repartition(3)))
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_ranking(docs, items)
    assert rows_of(S.search(index, H.clashing(asked))) == want
    assert rows_of(S.search(index, asked, block_terms=20)) == want
    assert rows_of(S.search(index, asked.union(asked), k=3)) == [w for w in want if w[1] <= 3]


def test_best_first_opens_few_nodes():
    """A rare exact match leaves most of the tree closed."""
    r = random.Random(1)
    docs = [(i, " ".join(f"w{r.randrange(20000)}" for _ in range(60))) for i in range(4096)]
    builder = S._Builder(4096, 60 * 4096)
    for i, t in docs:
        builder.add(i, t.encode())
    row = builder.row(0, pa.int64())
    shard = S.Shard(row.column(3)[0].as_py(), *(S._raw(row.column(c)[0]) for c in range(4, 10)))
    at = {t: i for i, t in enumerate(shard.vocabulary)}
    best = [S._Best(1)]
    found = [at[t] for t in set(S.terms(docs[77][1].encode()))]
    opened = S.search_shard(shard, [(np.array(found), np.full(len(found), 5000))], best)
    assert best[0].rows[0][1] == 77 and opened < 60


def test_empty_tables_and_other_ids(spark):
    items = spark.createDataFrame([("q", "alpha beta"), ("q", "gamma"), (None, "alpha")], "item_id string, text string")
    none = S.search(S.build_index(H.documents(spark, [])), items)
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    docs = spark.createDataFrame([("d2", "alpha"), ("d1", "alpha"), ("d3", "gamma delta")], "doc_id string, text string")
    got = [r[:3] for r in rows_of(S.search(S.build_index(docs), items))]
    assert sorted(got, key=str) == sorted([("q", 1, "d1"), ("q", 2, "d2"), ("q", 1, "d3"), (None, 1, "d1"), (None, 2, "d2")], key=str)
    assert S.search(S.build_index(docs), items.limit(0)).count() == 0


def test_query_equals_duckdb(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows_of(queries.op13_lexical_search(spark, DATA)) == sorted(con.execute(queries.oracle_sql()["op13_lexical_search"]).fetchall(), key=str)
