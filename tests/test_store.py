"""Versioned tables, the similarity join and merges after a write."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.similarity import with_token_set_ratio
from ledgerlight.operators import gates as G
from ledgerlight.operators import simjoin as J
from ledgerlight.sources import bind, versions

ROWS = "k string, v bigint"


def table_of(spark, **rows):
    return spark.createDataFrame(list(rows.items()), ROWS)


def contents(df):
    return {r["k"]: r["v"] for r in df.collect()}


def changes(spark, put=(), gone=()):
    return spark.createDataFrame([(k, v, False) for k, v in dict(put).items()] + [(k, None, True) for k in gone], ROWS + ", deleted boolean")


# --- versions ----------------------------------------------------------------------


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert versions.latest(spark, path) is None
    assert versions.replace(table_of(spark, **{f"k{i}": i for i in range(200)}), path, ["k"]) == 0
    before = versions._manifest(spark, path, 0)["parts"]
    assert versions.upsert(spark, path, changes(spark, {"k3": 33, "new": 1}, ["k4", "absent"]), "b1") == 1
    after = versions._manifest(spark, path, 1)["parts"]
    moved = {b for b in before if before[b] != after[b]}
    assert 1 <= len(moved) <= 4 and len(before) == versions.BUCKETS
    want = {f"k{i}": i for i in range(200) if i != 4} | {"k3": 33, "new": 1}
    assert contents(versions.read(spark, path)) == want
    assert contents(versions.read(spark, path, 0)) == {f"k{i}": i for i in range(200)}


def test_a_batch_counts_once_and_writers_collide(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    versions.replace(table_of(spark, a=1), path, ["k"], batch="load")
    assert versions.replace(table_of(spark, a=9), path, ["k"], batch="load") == 0
    assert versions.upsert(spark, path, changes(spark, {"a": 2}), "b") == 1
    assert versions.upsert(spark, path, changes(spark, {"a": 3}), "b") == 1 and contents(versions.read(spark, path)) == {"a": 2}
    with pytest.raises(versions.Conflict):
        versions.upsert(spark, path, changes(spark, {"a": 4}), "c", base=0)
    manifest = versions._manifest(spark, path, 1)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, manifest)
    assert versions.names(spark, f"{path}/_versions") == ["0000000000.json", "0000000001.json"]


def test_readers_keep_their_version_and_failed_writes_leave_it(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace(table_of(spark, a=1, b=2), path, ["k"])
    reader = versions.read(spark, path)
    versions.upsert(spark, path, changes(spark, {"a": 5}, ["b"]), "x")
    assert contents(reader) == {"a": 1, "b": 2} and contents(versions.read(spark, path)) == {"a": 5}

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", broken)
        with pytest.raises(OSError):
            versions.upsert(spark, path, changes(spark, {"a": 7}), "y")
    assert contents(versions.read(spark, path)) == {"a": 5}
    assert versions.upsert(spark, path, changes(spark, {"a": 7}), "y") == 2
    assert versions.vacuum(spark, path, keep=1) > 0 and contents(versions.read(spark, path)) == {"a": 7}
    assert versions.vacuum(spark, path, keep=1) == 0
    assert versions.upsert(spark, path, changes(spark, gone=["a"]), "z") == 3 and versions.read(spark, path).count() == 0
    assert versions.upsert(spark, path, changes(spark), "none") == 4


def test_exclusive_files(spark, tmp_path):
    lock = f"file://{tmp_path}/lock"
    with versions.exclusive(spark, lock):
        with pytest.raises(versions.Conflict):
            with versions.exclusive(spark, lock, wait=0.2):
                pass
        with versions.exclusive(spark, lock, stale=-1):  # left by a dead writer
            pass
    with versions.exclusive(spark, lock, wait=0):
        pass


# --- similarity join -------------------------------------------------------------------


def all_pairs(new, known, at_least):
    """Best of every pair, without filters."""
    rated = with_token_set_ratio(new.crossJoin(known.withColumnRenamed("cause", "other")), "cause", "other")
    best = rated.groupBy("new_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "ord", "id")).alias("b")).collect()
    return {r["new_id"]: (r["b"]["id"], round(-r["b"]["n"], 6)) if -r["b"]["n"] >= at_least else (None, None) for r in best}


def sentences(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 10))) for _ in range(words)] + ["naïve", "ещё", "x1"]
    out = []
    for _ in range(n):
        text = " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 9)))
        out.append(text if r.random() < 0.7 or not out else out[r.randrange(len(out))].replace("a", "e", r.randrange(3)).upper())
    return out


@pytest.mark.parametrize("at_least, rows", [(50.0, 25), (80.0, 2000)])
def test_best_matches_equal_all_pairs(spark, monkeypatch, at_least, rows):
    monkeypatch.setattr(J, "BLOCK_ROWS", rows)
    texts = sentences(7, 160)
    known = [(f"m{i}", t, i) for i, t in enumerate(texts[:110])] + [("none", None, 500), ("blank", " .. ", 501), ("twin", texts[3], 502)]
    new = [(i, t) for i, t in enumerate(texts[110:])] + [(900, texts[3]), (901, None), (902, "--"), (903, texts[3]), (904, " ".join(texts[:30]))]
    k = spark.createDataFrame(known, "id string, cause string, ord bigint")
    n = spark.createDataFrame(new, "new_id bigint, cause string")
    got = {r["new_id"]: (r["best_id"], r["score"] and round(r["score"], 6)) for r in J.best_matches(n, k, at_least).collect()}
    assert got == all_pairs(n, k, at_least) and got[900][1] == 100
    assert [r["best_id"] for r in J.best_matches(n, k.limit(0), at_least).collect()] == [None] * len(new)
    assert J.best_matches(n.limit(0), k, at_least).count() == 0


def test_sides_are_prepared_once_for_all_blocks(spark, monkeypatch):
    """The matches read stored sides: no plan of a block goes back to the texts."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 10)
    texts = sentences(8, 60)
    k = spark.createDataFrame([(f"m{i}", t, i) for i, t in enumerate(texts[:30])], "id string, cause string, ord bigint")
    n = spark.createDataFrame([(i, t) for i, t in enumerate(texts[30:])], "new_id bigint, cause string")
    plan = J.best_matches(n, k, 50.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # the new ids


def test_few_pairs_are_verified(spark):
    """Of all pairs of the largest test tables, under one in a hundred reaches the subsequence function."""
    d = "/root/testdata/sf0.1"
    new = bind.requests(spark, d).select(F.col("query_id").alias("new_id"), F.col("text").alias("cause"))
    known = bind.facts(spark, d).filter("type = 'mistake'").select(F.col("slug").alias("id"), F.col("name").alias("cause"), F.col("doc_id").alias("ord"))
    n, k = J.prepared(new, known, 50.0)
    near = J._score(J.token_pairs(n, k), 50.0)
    raised = n.join(near, "digest", "left").withColumn("need", F.greatest(F.lit(50.0), F.coalesce(-F.col("best.negative"), F.lit(0.0))))
    pairs = J.token_pairs(n, k).select("tokens", "k_tokens").unionByName(J.length_pairs(raised, k).select("tokens", "k_tokens"))
    s = F.char_length(F.array_join(F.array_intersect("tokens", "k_tokens"), " "))
    x, y = (F.char_length(F.array_join(F.array_except(a, b), " ")) for a, b in (("tokens", "k_tokens"), ("k_tokens", "tokens")))
    verified = pairs.filter((x > 0) & (y > 0) & (200 * (s + F.least(x, y) + 1) >= 50 * (2 * s + x + y))).count()
    assert verified < 0.01 * new.count() * known.count()


# --- merges ------------------------------------------------------------------------------

FACTS = "project string, slug string, type string, cause string, recurrence bigint, ord bigint"


def test_written_facts_merge_once(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    rows = [
        ("p", "old.md", "mistake", "forgot to close the cursor after reading", 2, 1),
        ("p", "bare.md", "mistake", "mixes up metres and feet in altitude", None, 2),
        ("q", "far.md", "mistake", "entirely different topic of gardening", 5, 3),
        ("p", "note.md", "note", "forgot to close the cursor after reading", 1, 4),
        ("p", "w1.md", "mistake", "Forgot to close the cursor, after reading!", 0, 5),
        ("q", "w1.md", "mistake", "forgot to close a cursor after reading it", 0, 6),
        ("p", "w2.md", "mistake", "mixes up metres and feet in altitudes", 0, 7),
        ("p", "w3.md", "mistake", "closes the cursor before the reading loop", 0, 8),
        ("p", "w4.md", "mistake", "short", 0, 9),
        ("p", "w5.md", "mistake", None, 0, 10),
    ]
    facts = spark.createDataFrame(rows, FACTS)
    written = spark.createDataFrame([("p", f"w{i}.md") for i in range(1, 6)] + [("q", "w1.md"), ("q", "nowhere.md")], "project string, slug string")
    versions.replace(facts, path, ["project", "slug"])
    events = {tuple(r) for r in G.merge_written(spark, path, written, "b1", "2024-05-01", "s9").collect()}
    merged = {"w1>old", "w2>bare"}
    assert {e[2] for e in events if e[1] == "dedup-merged"} == merged and all(e[0] == "2024-05-01" and e[3] == "s9" for e in events)
    assert {e[2].split("~")[0] for e in events if e[1] == "dedup-candidate"} == {"w3"}
    want = {("p", "old.md"): 4, ("p", "bare.md"): None, ("q", "far.md"): 5, ("p", "note.md"): 1, ("p", "w3.md"): 0, ("p", "w4.md"): 0, ("p", "w5.md"): 0}
    state = lambda: {(r["project"], r["slug"]): r["recurrence"] for r in versions.read(spark, path).collect()}
    assert state() == want == {(r["project"], r["slug"]): r["recurrence"] for r in G.after_merge(facts, written).collect()}
    assert {tuple(r) for r in G.merge_written(spark, path, written, "b1", "2024-05-01", "s9").collect()} == events and state() == want
    assert versions.latest(spark, path) == 1


def test_a_merge_that_fails_midway_is_repeated(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/facts"
    facts = spark.createDataFrame([("p", "a.md", "mistake", "same cause in the very same words", 1, 1), ("p", "b.md", "mistake", "same cause in the very same words", 1, 2)], FACTS)
    written = spark.createDataFrame([("p", "b.md")], "project string, slug string")
    versions.replace(facts, path, ["project", "slug"])

    def broken(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", broken)
        with pytest.raises(OSError):
            G.merge_written(spark, path, written, "b", "2024-05-01")
    assert versions.read(spark, path).count() == 2
    assert [r["target"] for r in G.merge_written(spark, path, written, "b", "2024-05-01").collect()] == ["b>a"]
    assert [(r["slug"], r["recurrence"]) for r in versions.read(spark, path).collect()] == [("a.md", 2)]
