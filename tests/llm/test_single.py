"""Packing, sharding, quality rules, line dedup, language, extraction and scoring."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.llm import extraction, langid, linededup, lmscore, packing, quality, queries, sharding

from ..conftest import DATA
from . import helpers as H

VARIED = ["A b. C d! e", "", None, "x", "naïve café — ok.\n" * 40, "<|endoftext|> text", "a <|endoftext|>\n<|endoftext|><|endoftext|>b <|endoftext|", "word " * 9000, "日本語 текст"]


# --- packing ---------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(VARIED)) + [(None, "no id"), (3, "x")]
    got = packing.pack_documents(H.clashing(H.documents(spark, rows).coalesce(1))).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r["input_ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["input_ids"]) == r["ids_crc32"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(pieces[doc_id, len(ids)], key=lambda p: p[0])
        joined = np.concatenate([p[1] for p in mine])
        assert joined[: len(ids)].tolist() == ids or doc_id == 3
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(H.documents(spark, [])).count() == 0


def test_ids_equal_the_tokenizer_on_the_test_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, _ = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    texts += [x or "" for x in VARIED]
    assert [packing.token_ids(encoder, x).tolist() for x in texts] == [e.ids + [packing.EOS] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_little_padding_on_the_test_table(spark):
    for table in (f"{DATA}/documents.parquet", "/root/testdata/sf0.01/documents.parquet"):
        got = packing.pack_documents(spark.read.parquet(table), with_ids=False).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        sizes = [r["n"] for r in got]
        padding = sum(packing.WINDOW - n for n in sizes if n & (n - 1))
        assert padding < 0.01 * sum(sizes)
    assert len(sizes) <= 1.02 * sum(sizes) / packing.WINDOW + 1


def test_buffers_part_no_document_wrongly(spark, monkeypatch):
    r = random.Random(5)
    streams = [(i, np.array([r.randrange(2, 9000) for _ in range(r.choice([0, 3, 700, 6000]))] + [packing.EOS], np.uint32)) for i in range(60)]
    _, ends = packing.load_encoder(packing.default_vocabulary())
    monkeypatch.setattr(packing, "BUFFER_TOKENS", 5000)
    packer = packing._Packer(0, packing.WINDOW, ends, True)
    for doc_id, ids in streams:
        packer.add(doc_id, ids)
    packer.flush(True)
    joined, filled = {}, Counter()
    for doc_id, start, length, _, total, sequence, offset, piece in packer.out:
        have = joined.setdefault(doc_id, [])
        assert len(have) == start and offset == filled[sequence] and total == len(dict(streams)[doc_id])
        have += np.frombuffer(piece, "<u4").tolist()
        filled[sequence] += length
    assert {i: ids.tolist() for i, ids in streams} == joined
    assert max(filled.values()) <= packing.WINDOW and sorted(filled) == list(range(len(filled)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=60), st.integers(0, 9), st.integers(0, 60))
def test_cuts_are_optimal(flags, seed, tail):
    window, n = 16, len(flags)
    r = random.Random(seed)
    places = np.array([i for i in range(1, n) if flags[i] or i % 8 == 0] + [n])
    costs = np.array([r.choice([0.0, 2.0, 12.0]) for _ in places])

    def padding(start, size):
        return 0 if start >= tail and size & (size - 1) == 0 else window - size

    def total(cuts):
        cost, at, by = 0.0, 0, dict(zip(places.tolist(), costs.tolist()))
        for c in cuts:
            size = c - at
            assert 0 < size <= window
            cost += by[c] + packing.OPEN_COST + padding(at, size)
            at = c
        return cost

    best = {0: 0.0}
    for i, c in zip(places.tolist(), costs.tolist()):
        best[i] = min(best[j] + c + packing.OPEN_COST + padding(j, i - j) for j in best if 0 < i - j <= window)
    assert total(packing.choose_cuts(n, places, costs, window, tail)) == pytest.approx(best[n])


# --- sharding and quality -----------------------------------------------------------


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(300)] + [(None, None), (None, "é"), (5, "dup"), (5, "dup")] + [(9, "hot")] * 200
    got = sharding.shard_by_bytes(H.clashing(H.documents(spark, rows)), 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 2 * 516
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first = {s: min(r["doc_id"] or -1 for r in got if r["shard"] == s) for s in sizes}
    assert [first[s] for s in sorted(first)] == sorted(first.values())
    assert sharding.shard_by_bytes(H.documents(spark, [])).count() == 0


def test_quality_counts_equal_brute_force(spark):
    texts = VARIED + ["a b c d e f a b c d e g", "l\nl\n \nl\n", "## $a% b|c", "w " * 6] + [" ".join(H.prose(i, 80, 6)) for i in range(20)]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.measure(H.clashing(H.documents(spark, list(enumerate(texts))))).collect()}
    assert got == {i: H.counts(t) for i, t in enumerate(texts)}


def test_quality_thresholds_adapt(spark):
    clean = [(i, " ".join(H.prose(i, 60, 10**6)), "en", "a") for i in range(60)]
    noisy = [(100 + i, " ".join(f"{w}###" for w in H.prose(i, 60, 10**6)), "en", "b") for i in range(60)]
    odd = [(200, clean[0][1].replace(" ", "### "), "en", "a"), (201, "few words", None, None), (202, None, None, None), (203, " ".join(["x"] * 50), "en", "a")]
    got = {r["doc_id"]: r for r in quality.apply_rules(H.documents(spark, clean + noisy + odd)).collect()}
    assert all(got[i]["kept"] for i in range(60)) and all(got[100 + i]["kept"] for i in range(60))
    assert not got[200]["kept"] and not got[200]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (201, 202, 203))
    assert quality.apply_rules(H.documents(spark, [])).count() == 0


# --- line dedup -------------------------------------------------------------------------


def test_lines_equal_duckdb(spark):
    rows = [(i, f"menu of links\nown line {i}\nsecond own line {i}\n\nshared by few {i % 40}", "en", f"s{i % 12}") for i in range(60)]
    rows += [(70 + i, f"copy first line\ncopy second line\nx{i}", "en", f"s{i}") for i in range(9)]
    rows += [(90, None, "en", "s1"), (91, "", "en", None), (92, "menu of links\n \nlong tail of words here", "en", None), (92, "menu of links\n \nlong tail of words here", "en", None)]
    df = H.documents(spark, rows)
    ours = sorted(map(str, linededup.remove_boilerplate(H.clashing(df)).select("doc_id", "n_lines", "n_flagged", "n_removed", "text").toPandas().astype(str).itertuples(index=False)))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    theirs = con.execute(linededup.oracle()).df()[["doc_id", "n_lines", "n_flagged", "n_removed", "text"]].astype(str)
    assert ours == sorted(map(str, theirs.itertuples(index=False)))
    kept = {r["doc_id"]: r for r in linededup.remove_boilerplate(df).collect()}
    assert kept[0]["n_removed"] == 1 and "menu" not in kept[0]["text"]
    assert kept[70]["n_flagged"] == 2 and kept[70]["n_removed"] == 0
    assert linededup.remove_boilerplate(H.documents(spark, [])).count() == 0


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(f"l{n}", f"s{k}") for n in range(1, 30) for k in range(n)]
    lines = spark.createDataFrame(rows, "line string, site string").select(F.xxhash64("line").alias("h"), "site")
    flagged = {r["h"] for r in linededup.flagged_lines(lines, 8).collect()}
    names = {r["h"]: r["line"] for r in spark.createDataFrame([(f"l{n}",) for n in range(1, 30)], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    assert {names[h] for h in flagged} == {f"l{n}" for n in range(8, 30)}


# --- language -----------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs.filter(langid.held_out(F.col("doc_id"))).filter("lang is not null"), model).collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 100 and right / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, "the and of with", "en") for i in range(4)] + [(10 + i, "und der die das", "de") for i in range(4)]
    model = langid.train(H.documents(spark, rows))
    tests = H.documents(spark, [(1, None), (2, ""), (3, "123 -- ! ² ½"), (4, "the"), (5, "der"), (6, "unden"), (6, "unden")])
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(H.clashing(tests), model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "de"), (6, "de")]
    none = langid.train(H.documents(spark, []))
    assert langid.identify(tests, none).filter("lang_pred <> 'und'").count() == 0


def test_words_with_combining_marks():
    marks = "".join(chr(c) for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M")
    plain, marked = re.compile(r"[^\W\d_]+"), re.compile(rf"(?:[^\W\d_]|[{marks}])+")
    for text in ("हिन्दी पाठ", "ab\U0001d165c d", "Été 12", "\U0001f600 plain é", "\U00011000न x", "e\u0301te\u0301", "", "abc d_e", "\ud800 ab"):
        low = text.lower()
        assert langid.tokens(text) == (marked if any(c in marks for c in low) else plain).findall(low)


def test_language_of_a_long_text(spark):
    model = langid.train(H.documents(spark, [(i, "the and of with", "en") for i in range(4)] + [(10 + i, "und der die das", "de") for i in range(4)]))
    got = langid.identify(H.documents(spark, [(1, "der die das " * 200_000), (2, "the and " * 200_000)]), model).collect()
    assert [r["lang_pred"] for r in got] == ["de", "en"]


# --- extraction ---------------------------------------------------------------------------


def test_extraction_on_unseen_pages():
    model = extraction.default_model()
    pages = extraction.labelled_pages(120, seed=4321)
    wrong = total = 0
    for page, labels in pages:
        wrong += int((model.decode(extraction.blocks(page)) != np.array(labels)).sum())
        total += len(labels)
    assert wrong / total < 0.03


def test_viterbi_is_the_best_path():
    model = extraction.default_model()
    for page, _ in extraction.labelled_pages(25, seed=5):
        found = extraction.blocks(page)[:9]
        scores = [model.scores(b, i, len(found)) for i, b in enumerate(found)]
        paths = [[k >> i & 1 for i in range(len(found))] for k in range(1 << len(found))]
        value = lambda p: sum(s[x] for s, x in zip(scores, p)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))
        assert value(model.decode(found)) == pytest.approx(max(map(value, paths)))


def test_extraction_edge_cases(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><!-- c --><article><h1>A &amp; B</h1><p>One\n <b>two</b>&nbsp;three.<p>Next long paragraph of the article text, with words.</article><div class=comments><p>Reader says this.</p></div><script>var a='<p>';</script><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<!-- open"), (None, "u", page), (1, "u", page)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extraction.extract(H.clashing(df)).collect()]
    text = "A & B\nOne two three.\nNext long paragraph of the article text, with words."
    assert got[0] == (1, text, len(text)) and got[6] == got[0] and got[5][1] == text
    assert [g[1] for g in got[1:3]] == ["", ""] and len(got) == 7
    assert extraction.extract(df.limit(0)).count() == 0


# --- language models ------------------------------------------------------------------------


def plain_scores(texts, target, vocabulary):
    """Losses by dictionaries, with every bigram kept."""
    words = [H.WORD.findall((t or "").translate(H.LOWER)) for t in texts]
    known = vocabulary
    ids = [[w if w in known else "<unk>" for w in x] for x in words]
    size = len(known) + 2

    def model(docs):
        uni, bi, past = Counter(), Counter(), Counter()
        for x in docs:
            for a, b in zip(["<s>", *x], x):
                uni[b] += 1
                bi[a, b] += 1
                past[a] += 1
        total = sum(uni.values()) + lmscore.PRIOR * size
        return uni, bi, past, total

    both = [model([ids[i] for i in target]), model(ids)]
    pairs = set(both[1][1])
    out = []
    for x in ids:
        loss = []
        for uni, bi, past, total in both:
            s = 0.0
            for a, b in zip(["<s>", *x], x):
                n = max(past[a], 1)
                freed = 1 - sum(max(bi[p] - lmscore.DISCOUNT, 0) for p in pairs if p[0] == a) / n
                s -= math.log(max(bi[a, b] - lmscore.DISCOUNT, 0) / n + freed * (uni[b] + lmscore.PRIOR) / total)
            loss.append(s / len(x) if x else None)
        out.append(tuple(loss))
    return out


def check_scores(rows, texts, target):
    got = {r["doc_id"]: (r["loss_target"], r["loss_background"], r["score"], r["n_tokens"]) for r in rows}
    assert len(rows) == len(got) == len(texts)
    known = {w for t in texts for w in H.WORD.findall((t or "").translate(H.LOWER))}
    for i, (t, b) in enumerate(plain_scores(texts, target, known)):
        if t is None:
            assert got[i] == (None, None, None, 0)
        else:
            assert got[i][:3] == (pytest.approx(t, abs=1e-6), pytest.approx(b, abs=1e-6), pytest.approx(t - b, abs=1e-6))


def test_scores_equal_plain_models(spark, monkeypatch):
    """One chunk, and texts that are spread over many chunks and buckets."""
    texts = [" ".join(H.prose(i, 12 + 9 * i, 8 + i)) for i in range(20)] + ["", None, "W1 w1 w2", " \n "]
    df = H.clashing(H.documents(spark, list(enumerate(texts)))).withColumn("target", F.when(F.col("doc_id") < 4, True))
    check_scores(lmscore.score_corpus(df).collect(), texts, [0, 1, 2, 3])
    monkeypatch.setattr(lmscore, "CHUNK", 300)
    monkeypatch.setattr(lmscore, "BUCKET", 300)
    check_scores(lmscore.score_corpus(df).collect(), texts, [0, 1, 2, 3])


def test_a_text_longer_than_a_chunk(spark):
    long = " ".join(H.prose(3, 400_000, 5000))
    texts = [long, long[:900], "w1 w2", None]
    assert len(long) > 2 << 20
    df = H.documents(spark, list(enumerate(texts))).withColumn("target", F.col("doc_id") == 1)
    got = {r["doc_id"]: r for r in lmscore.score_corpus(df).collect()}
    assert got[0]["n_tokens"] == 400_000 and got[1]["score"] < got[0]["score"] and got[3]["score"] is None


def test_the_query_scores_labelled_documents(spark, tmp_path):
    """The target are the documents labelled as good and not toxic, each counted once."""
    texts = [" ".join(H.prose(i, 12, 8)) for i in range(10)] + ["", None, "W1 w1 w2"]
    H.documents(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 4), 0) for i in range(8)] + [(9, 1, 1), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    check_scores(queries.op10_lm_scoring(spark, str(tmp_path)).collect(), texts, [0, 1, 2, 3])
    empty = H.documents(spark, []).withColumn("target", F.lit(True))
    assert lmscore.score_corpus(empty).count() == 0
