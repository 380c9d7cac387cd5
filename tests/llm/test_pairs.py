"""Jaccard join, suffix dedup and decontamination against brute force."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import decontam, jaccard, suffixdedup
from ledgerlight.llm.components import connected_components

from . import helpers as H


def edited(words, seed, n):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus():
    rows = []
    for base in range(6):
        w = H.prose(base, 120)
        rows += [" ".join(edited(w, 100 * base + k, k % 5)) for k in range(9)]
    rows += ["one two", "One TWO", "", None, " \n\t ", "x", rows[0], rows[0], " ".join(H.prose(77, 3000))]
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus()
    for gram, num, den in ((4, 85, 100), (5, 80, 100)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(H.clashing(H.documents(spark, rows)), gram, (num, den)).collect()}
        assert got == dict(enumerate(H.components(rows, gram, num, den)))


def test_one_large_family(spark):
    w = H.prose(5, 100)
    rows = [(i, " ".join(edited(w, i, i % 7))) for i in range(150)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(H.documents(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(H.components(rows, 4, 85, 100))}


def test_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(H.documents(spark, [])).count() == 0
    text = " ".join(H.prose(1, 30))
    got = jaccard.jaccard_components(H.documents(spark, [(None, text), (7, text), (7, text), (3, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 7), (3, 3), (7, 7), (7, 7)]


def test_keep_one(spark):
    rows = corpus()
    kept = {r["doc_id"] for r in jaccard.keep_one_per_group(H.clashing(H.documents(spark, rows))).collect()}
    assert kept == {i for i, (_, c) in enumerate(H.components(rows, 5, 80, 100)) if c == i}
    w = H.prose(8, 60)
    near = [" ".join(w), " ".join(w[:-1]), " ".join(w[1:])]
    assert jaccard.keep_one_per_group(H.documents(spark, [(None, t) for t in near])).count() == 1
    assert [r["doc_id"] for r in jaccard.keep_one_per_group(H.documents(spark, [(None, near[0]), (4, near[1]), (9, near[2])])).collect()] == [4]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (101, 100)], "a long, b long")
    got = {r["v"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def suffix_corpus():
    r = random.Random(4)
    passage = " ".join(H.prose(9, 90, 10**6))
    rows = [" ".join(H.prose(20 + i, 60, 10**6)) for i in range(8)]
    rows[0] += " " + passage
    rows[1] = passage + " " + rows[1] + " " + passage
    rows[2] += passage[3:260] + "é" + passage[300:]
    rows += ["ab" * 300, "ü" * 220, passage, passage, "short", "", None]
    for k in range(12):
        cut = r.randrange(len(passage))
        rows.append(passage[:cut] + "#" + passage[cut:])
    return rows


def test_repeats_equal_brute_force(spark):
    rows = suffix_corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(H.clashing(H.documents(spark, list(enumerate(rows))))).collect()}
    assert got == dict(enumerate(H.repeats(rows, 200)))


def test_repeats_edge_cases(spark):
    assert suffixdedup.remove_repeats(H.documents(spark, [])).count() == 0
    same = "q" * 10 + " ".join(H.prose(3, 80, 10**6))
    got = suffixdedup.remove_repeats(H.documents(spark, [(1, same), (1, same), (None, same)])).collect()
    assert len(got) == 3 and all(r["n_removed"] == len(same) and r["kept"] == b"" for r in got)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=12))
def test_deep_shallow_leaves(texts):
    raw = "".join(texts).encode() + b"\0" * 16
    starts = np.arange(len(raw) - 16)
    size = suffixdedup.deep_shallow_groups(np.frombuffer(raw, np.uint8), starts, 12, 8)
    strings = [raw[s : s + 12] for s in starts]
    assert size.tolist() == [strings.count(x) for x in strings]


def local_score(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if x == y else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=20))
def test_alignment_score(a, b):
    score, start, end = decontam.align(a, b)
    assert score == local_score(a, b)
    assert score == local_score(a, b[start:end])


def test_leaks_equal_brute_force(spark):
    items = [(i, " ".join(H.prose(200 + i, 30, 10**5))) for i in range(6)] + [(90, "four short words here"), (91, None), (None, "a b c d e f g h"), (92, "word"), (92, "a second text of one id")]
    texts = []
    for i in range(6):
        w = items[i][1].split()
        texts.append(" ".join(H.prose(i, 50)) + " " + items[i][1].upper().replace("W", "w") + ", " + " ".join(H.prose(i + 50, 50)))
        texts.append(" ".join(H.prose(i, 20) + edited(w, i, 5) + H.prose(i + 1, 20)))
        texts.append(" ".join(w[:8] + H.prose(i, 60)))
        texts.append(" ".join(w[:12] + ["ins"] + w[12:20] + w[22:]))
    texts += ["", None, " ".join(H.prose(1, 5000)), "Four short, words here", "four short other words here", "x a b c d e f g h", "word", "so a second text of one id"]
    docs, bench = H.documents(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id bigint, text string")
    expected = set()
    for d, t in enumerate(texts):
        passage = decontam.words(t)
        for i, x in items:
            w = decontam.words(x)
            if w and local_score(w, passage) / (2 * len(w)) >= (decontam.THRESHOLD if len(w) >= decontam.MIN_WORDS else 1):
                expected.add((d, i))
    got = decontam.find_leaks(H.clashing(docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    assert {i for _, i in expected} >= {90, None, 92}
    for r in got:
        if r["doc_id"] >= 27:
            continue
        span = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert local_score(decontam.words(dict(items)[r["item_id"]]), decontam.words(span)) / (2 * len(decontam.words(dict(items)[r["item_id"]]))) == pytest.approx(r["score"])
    for words in (decontam.BLOCK_WORDS, 40):  # one block of items, and several
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench, block_words=words).collect()} == expected
        clean = decontam.drop_leaking(H.clashing(docs), bench, block_words=words)
        assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}
        assert clean.columns == H.clashing(docs).columns and {r["_key"] for r in clean.collect()} == {"x"} == {r["a.b"] for r in clean.collect()}


def test_ids_of_any_type(spark):
    """Whatever the type of doc_id, the same rows go; those of a null id are judged by their texts."""
    item = " ".join(H.prose(600, 20, 10**5))
    rows = [(1, "own text " + " ".join(H.prose(1, 30, 10**5))), (2, "leak " + item), (None, item), (None, "another clean text " + " ".join(H.prose(2, 30, 10**5))), (3, "own text " + " ".join(H.prose(1, 30, 10**5)))]
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    for kind in ("int", "string", "long"):
        docs = H.clashing(H.documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind)))
        kept = decontam.drop_leaking(docs, bench)
        assert kept.dtypes == docs.dtypes
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
        one = jaccard.keep_one_per_group(docs)
        assert one.dtypes == docs.dtypes and {r["_key"] for r in one.collect()} == {"x"}
        assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "None"]
        assert suffixdedup.remove_repeats(docs).count() == 5
    docs = H.documents(spark, rows).withColumn("doc_id", F.concat(F.lit("id-"), F.col("doc_id").cast("string")))
    assert sorted(str(r["doc_id"]) for r in decontam.drop_leaking(docs, bench).collect()) == ["None", "id-1", "id-3"]


def test_very_long_texts(spark):
    """Texts beyond a chunk of the kernels, with a leak, a repeated passage and a near copy at their ends."""
    item = " ".join(H.prose(601, 50, 10**5))
    assert len(item) >= suffixdedup.LENGTH  # the least that a repeat covers
    long = " ".join(H.prose(44, 250_000, 10**6))
    assert len(long) > decontam.chunks.__defaults__[0]
    texts = [long + " " + item, "short " + item, long]
    docs = H.documents(spark, list(enumerate(texts)))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(docs, bench).collect()} == {0, 1}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {0: 0, 1: 1, 2: 0}
    got = {r["doc_id"]: r["n_removed"] for r in suffixdedup.remove_repeats(docs, with_text=False).collect()}
    assert got == {0: len(texts[0]), 1: len(item) + 1, 2: len(long)}


def test_leak_with_one_long_insertion(spark):
    w = H.prose(300, 37, 10**5)
    texts = [" ".join(H.prose(k, 40) + w[:18] + H.prose(k + 9, n) + w[18:] + H.prose(k + 20, 40)) for k, n in enumerate((20, 29, 30))]
    bench = spark.createDataFrame([(1, " ".join(w))], "item_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.find_leaks(H.documents(spark, list(enumerate(texts))), bench).collect()}
    assert got == {0: pytest.approx(54 / 74), 1: pytest.approx(45 / 74)}


def test_every_copy_that_scores_shares_seeds(spark):
    r, texts, items = random.Random(8), [], []
    for i in range(40):
        w = H.prose(700 + i, r.choice((5, 6, 7, 11, 20, 37)), 10**5)
        items.append((i, " ".join(w)))
        copy = []
        for k, x in enumerate(w):
            kind = r.random()
            copy += [x, f"z{k}"] if kind < 0.25 else [f"y{k}"] if kind < 0.35 else [x]
        texts.append(" ".join(H.prose(i, 30) + copy + H.prose(i + 1, 30)))
    w = H.prose(900, 36, 10**5)
    items.append((40, " ".join(w)))
    texts.append(" ".join(x for k in range(0, 36, 2) for x in (*w[k : k + 2], f"z{k}")))  # a word after every two: no three in a row
    expected = {(d, i) for d, t in enumerate(texts) for i, x in items if local_score(x.split(), t.split()) / (2 * len(x.split())) >= decontam.THRESHOLD}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(H.documents(spark, list(enumerate(texts))), bench).collect()}
    assert (40, 40) in expected and len(expected) > 20
    assert got == expected


def test_leak_in_capitals(spark):
    item = "Ein größerer Élan für die Straße über Ñandú, où çà älter wäre: Öl, Übung"
    texts = [f"Prosa İß vorher {x} und ﬁn" for x in (item, item.upper(), item.lower())]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.find_leaks(H.documents(spark, [*enumerate(texts), (9, "ganz ANDERER Text über etwas")]), bench).collect()}
    assert sorted(got) == [0, 1, 2]
    for d, r in got.items():
        assert r["score"] == 1 and texts[d].encode()[r["start"] : r["end"]].decode().casefold() == item.casefold()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("aÉßİﬁ 𐐀,.", max_size=8).map(str.encode), st.binary(max_size=6)), max_size=6))
def test_folded_places(texts):
    raw, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    try:
        whole = [t.decode() for t in texts]
    except UnicodeDecodeError:
        assert len(decontam._folded(raw, offs)[1]) == len(offs)
        return
    buf, at, back = decontam._folded(raw, offs)
    assert [buf.tobytes()[a:b].decode() for a, b in zip(at, at[1:])] == [t.casefold() for t in whole]
    assert back[at].tolist() == offs.tolist()


def test_no_items_or_documents(spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.find_leaks(H.documents(spark, [(1, "a b c")]), empty).count() == 0
    assert decontam.find_leaks(H.documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0
