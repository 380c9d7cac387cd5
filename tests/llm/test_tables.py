"""The filter audit and the token files."""

import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow.orc
import pytest

from ledgerlight.llm import audit, queries, sharding, tokenfile
from ledgerlight.llm.runtime import new_path

from ..conftest import DATA
from . import helpers as H

# --- filter audit -----------------------------------------------------------------


def fails(text):
    t = text or ""
    w = H.WORD.findall(t)
    found = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
    return found + "D" * any(c in "#$%&*|" for c in t)


def plain_audit(rows, labels):
    """rows: (doc_id, text, source)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    docs = [(fails(t) + "E" * (i is not None and first[t or ""] < i), s or "", any(k == i is not None and q == 1 for k, q, _ in labels), any(k == i is not None and x == 1 for k, _, x in labels)) for i, t, s in rows]
    for part in {d[1] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[1] == part]
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = [d for d in docs if d[1] == part and f in d[0]]
                total[f] += len(gone)
                out[part, order, k] = [len(left), len(gone), len(failing) - len(gone), sum(d[0] == f for d in failing), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order, 1):
                out[part, order, k].append(total[f])
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def counts_of(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_equals_plain_counts(spark):
    long = " ".join(H.prose(1, 260, 10**5))
    texts = [long, long, None, "", "Few Words", "a " * 250, long + " #1", long.upper(), " \t\n", "ÄÖ é " * 90, "x" * 300 + " A&B", "w\u00a0w " * 300]
    rows = [(i, t, ("s1", "s2", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, long, "s1"), (None, None, None), (5, "a " * 250, "s2"), (0, long, "s1"), (0, long, "s1"), (0, "other", "s1"), (40, "word " * 150_000, "s2")]
    labels = [(0, 1, 0), (0, 0, 0), (1, 1, 1), (5, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    docs = H.documents(spark, [(i, t, "en", s) for i, t, s in rows])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert counts_of(audit.filter_audit(H.clashing(docs), H.clashing(marks))) == plain_audit(rows, labels)
    assert audit.filter_audit(docs.limit(0), marks).count() == 0
    assert counts_of(audit.filter_audit(docs, marks.limit(0))) == plain_audit(rows, [])


def test_audit_of_one_hot_text_and_other_filters(spark):
    rows = [(i, "same words here", "hot") for i in range(3000)]
    got = counts_of(audit.filter_audit(H.documents(spark, [(i, t, "en", s) for i, t, s in rows]), spark.createDataFrame([(7, 1, 0)], "doc_id bigint, quality int, toxic int")))
    assert got["hot", "EABCD", 1] == [1, 2999, 0, 0, 1, 0, 60 * 2999] and got["hot", "ABCDE", 1][:2] == [0, 3000] and len(got) == 600
    cells = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 3, 1, 0, 0), ("p", 0, 2, 2, 0), ("p", 2, 4, 0, 4)], "part string, mask int, n bigint, good bigint, toxic bigint")
    assert counts_of(audit.interactions(cells, "xy")) == {
        ("p", "xy", 1): [6, 6, 0, 0, 1, 0, 6],
        ("p", "xy", 2): [2, 4, 6, 4, 0, 4, 14],
        ("p", "yx", 1): [2, 10, 0, 4, 1, 4, 14],
        ("p", "yx", 2): [2, 0, 6, 0, 0, 0, 6],
    }
    for bad in ("", "aab", "abcdefgh"):
        with pytest.raises(ValueError):
            audit.interactions(cells, bad)


def test_audit_query_equals_duckdb(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    theirs = con.execute(queries.oracle_sql()["op11_filter_audit"]).df()
    ours = counts_of(queries.op11_filter_audit(spark, DATA))
    assert ours == {(r.part, r.filter_order, r.step): [getattr(r, c) for c in COUNTS] for r in theirs.itertuples()}


# --- token files --------------------------------------------------------------------

VARIED = ["A b. C d! e", "", None, "x", "naïve café — ok.\n" * 40, "<|endoftext|> text", "word " * 300_000, "日本語 текст"]


def plain_tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [tokenfile.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def digest(ids):
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    rows = [(5 * i, t) for i, t in enumerate(VARIED)] + [(3, "x"), (3, "y z"), (3, "x"), (None, "no id"), (-7, "first")]
    path = new_path(spark, "t")
    tokenfile.write_tokens(H.clashing(H.documents(spark, rows).repartition(4)), path)
    tokens = tokenfile.read_tokens(spark, path)
    got = tokenfile.token_digests(tokens).orderBy("start").collect()
    want = dict(zip((i for i, _ in rows), map(digest, plain_tokens([t for _, t in rows]))))
    assert [r["doc_id"] for r in got] == [None, -7, 0, 3, 3, 3, 5, 10, 15, 20, 25, 30, 35]
    at = 0
    for r in got:
        assert r["start"] == at and (r["doc_id"] == 3 or (r["n_tokens"], r["ids_crc32"]) == want[r["doc_id"]])
        at += r["n_tokens"]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] == 3) == sorted(map(digest, plain_tokens(["x", "y z", "x"])))
    some = tokenfile.token_digests(tokens.filter("doc_id = 30"), tokenfile.file_starts(tokens)).collect()
    assert some == [r for r in got if r["doc_id"] == 30]
    empty = new_path(spark, "t")
    tokenfile.write_tokens(H.documents(spark, []), empty)
    assert tokenfile.token_digests(tokenfile.read_tokens(spark, empty)).count() == 0


def test_token_files_keep_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), ("c", None)], "doc_id string, text string")
    path = new_path(spark, "t")
    tokenfile.write_tokens(docs, path)
    got = tokenfile.token_digests(tokenfile.read_tokens(spark, path, docs.schema["doc_id"].dataType)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == ["a", "b", "c"]


def scanned(df):
    """Rows that the file scan of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    node = plan.collectLeaves().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_lookups_skip_stripes_and_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(H.documents(spark, [(2 * i, f"text {i} " * 200) for i in range(12_000)]).repartition(3), path)
    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert len(files) == 3 and all(pyarrow.orc.ORCFile(f).nrows > 1000 for f in files)
    tokens = tokenfile.read_tokens(spark, path)
    assert scanned(tokens.filter("doc_id = 9000").select("n_tokens")) <= tokenfile.GROUP_ROWS
    assert scanned(tokens.filter("doc_id between 2000 and 2100").select("n_tokens")) <= 2 * tokenfile.GROUP_ROWS
    # Odd ids lie within the ranges, so that only the Bloom filters tell that they are absent.
    assert sum(scanned(tokens.filter(f"doc_id = {i}").select("n_tokens")) for i in range(2001, 3001, 100)) <= 2 * tokenfile.GROUP_ROWS


def test_stripes_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "STRIPE_BYTES", 1 << 16)
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(H.documents(spark, [(i, " ".join(H.prose(i, 150, 10**6))) for i in range(4000)]).coalesce(1), path)
    assert sum(pyarrow.orc.ORCFile(f).nstripes for f in tmp_path.glob("tokens/*.orc")) > 6
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "262144")
    try:
        tokens = tokenfile.read_tokens(spark, path)
        assert tokens.rdd.getNumPartitions() > 3 and tokenfile.token_digests(tokens).count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_token_file_query_equals_the_tokenizer(spark):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()), key=lambda r: r[0])
    at, want = 0, []
    for (i, _), ids in zip(docs, plain_tokens([t for _, t in docs])):
        want.append((i, at, *digest(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op12_token_files(spark, DATA).collect())) == want


# --- shards ---------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_plain_prefix_sums(spark, shards):
    rows = [(i * 7 % 101, "é" * (i * 37 % 300)) for i in range(250)] + [(None, None), (None, "x"), (5, "dup"), (5, "dup")] + [(9, "hot")] * 90 + [(50, "long " * 4000)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, zlib.crc32((rows[k][1] or "").encode()), k))
    sizes = [len((rows[k][1] or "").encode()) + sharding.ROW_BYTES for k in order]
    total, before, slots, want = sum(sizes), 0, {}, []
    for k, size in zip(order, sizes):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        want.append((rows[k][0], size, zlib.crc32((rows[k][1] or "").encode()), shard, slots[shard]))
        before += size
    got = sharding.shard_by_bytes(H.documents(spark, rows).coalesce(1), shards).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
