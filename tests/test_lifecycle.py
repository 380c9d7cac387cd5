"""Retiring, reviving and ablating facts, and the random choice of replays."""

import random

from pyspark.sql import functions as F

from ledgerlight.operators import analytics as A
from ledgerlight.operators import lifecycle as LC
from ledgerlight.sources import versions

STORE = "project string, slug string, archived string, content string"


def store(spark, *rows):
    return spark.createDataFrame(list(rows), STORE)


def orders(spark, *rows):
    return spark.createDataFrame([(*r, None, None)[:4] for r in rows], "own string, slug string, reason string, successor string")


def test_archive_names_fill_the_first_gap(spark):
    taken = {"a.md": ["a.md", "a-2.md", "a-4.md"], "b.md": ["b-2.md"], "c-2.md": ["c-2.md", "c-2-3.md"], "c.md": ["c-2.md"], "d.md": ["d.md", "d-02.md", "d-x.md", "d-1.md"], "e.md": []}
    want = {"a.md": "a-3.md", "b.md": "b.md", "c-2.md": "c-2-2.md", "c.md": "c.md", "d.md": "d-2.md", "e.md": "e.md"}
    rows = [("p", s, None, "x") for s in taken] + [("p", "gone.md", n, "old") for names in taken.values() for n in dict.fromkeys(names) if n != "c-2.md"] + [("p", "gone.md", "c-2.md", "old"), ("q", "a.md", "a-3.md", "old")]
    done = LC.retire(store(spark, *rows), orders(spark, *[("p", s.removesuffix(".md")) for s in taken]), "2024-01-01").collect()
    assert {r["slug"]: r["archived"] for r in done} == want and {r["outcome"] for r in done} == {"retired"}


def test_outcomes_and_targets(spark):
    s = store(spark, ("p", "one.md", None, "---\nname: n\n---\nbody"), ("p", "both.md", None, "x"), ("global", "both.md", None, "x"), ("global", "shared.md", None, "plain"), ("q", "far.md", None, "x"))
    asked = orders(spark, ("p", "one", "too  old|gone", "new one"), ("p", "both.md"), ("p", "shared.md"), ("p", "far.md"), ("p", "one.md"), ("q", "shared", "r"))
    done = {(r["own"], r["slug"]): r for r in LC.retire(s, asked, "2024-02-03").collect()}
    assert {k: r["outcome"] for k, r in done.items()} == {("p", "one.md"): "retired", ("p", "both.md"): "ambiguous", ("p", "shared.md"): "retired", ("p", "far.md"): "missing", ("q", "shared.md"): "missing"}
    assert done["p", "one.md"]["target"] == "p\x1fone>new_one:too_old_gone"
    assert done["p", "one.md"]["content"] == "---\nname: n\nretired: 2024-02-03\nretire-reason: too  old|gone\nsuperseded-by: new one\n---\nbody"
    assert done["p", "shared.md"]["content"] == "---\nretired: 2024-02-03\n---\nplain" and done["p", "shared.md"]["project"] == "global"
    events = [tuple(r) for r in LC.ablation_events(spark.createDataFrame([("p", "a.md", 3), ("p", "b", None), ("p", "c", 0)], "project string, slug string, n int"), "2024-01-01").collect()]
    assert [e[2] for e in events] == ["p\x1fa:3", "p\x1fb:5", "p\x1fc:5"] and events[0] == ("2024-01-01", "ablate-start", "p\x1fa:3", "cli")


def test_tombstones_come_and_go(spark):
    cases = ["---\nname: a\n---\nbody\n---\nretired: stays", "---\n---\n", "---  \r\nx: y\n--- \nz", "no block\nretired: 2020", "---\nopen: block\n", ""]
    df = spark.createDataFrame([(c,) for c in cases], "content string").withColumn("there", LC.stamped(F.col("content"), "2024-01-01", F.lit("why"), F.lit(None).cast("string")))
    rows = df.withColumn("back", LC.unstamped(F.col("there"))).collect()
    keys = "retired: 2024-01-01\nretire-reason: why\n"
    assert [r["there"] for r in rows][:3] == [f"---\nname: a\n{keys}---\nbody\n---\nretired: stays", f"---\n{keys}---\n", f"---  \r\nx: y\n{keys}--- \nz"]
    assert all(r["there"] == f"---\n{keys}---\n" + r["content"] for r in rows[3:])
    assert [r["back"] for r in rows] == cases[:3] + ["---\n---\n" + c for c in cases[3:]]
    kept = "---\nroot-cause: |\n  superseded-by: text\nsuperseded-by : k\nretired\n---\n"
    one = spark.createDataFrame([(kept,)], "c string").select(LC.unstamped(F.col("c")).alias("x")).first()["x"]
    assert one == "---\nroot-cause: |\n  superseded-by: text\n---\n"


def test_facts_move_in_the_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    start = [("p", "a.md", None, "---\nname: a\n---\nA"), ("p", "old.md", "a.md", "earlier"), ("global", "g.md", None, "G")]
    versions.replace(store(spark, *start), path, ["project", "slug", "archived"])
    rows = lambda: sorted((r["project"], r["slug"], r["archived"] or "", r["content"]) for r in versions.read(spark, path).collect())
    first = [r["target"] for r in LC.carry_out(spark, path, "retire", orders(spark, ("p", "a"), ("p", "g.md", "r")), "b1", "2024-01-01").collect()]
    assert sorted(first) == ["global\x1fg:r", "p\x1fa"]
    moved = rows()
    assert moved == sorted([("p", "old.md", "a.md", "earlier"), ("p", "a.md", "a-2.md", "---\nname: a\nretired: 2024-01-01\n---\nA"), ("global", "g.md", "g.md", "---\nretired: 2024-01-01\nretire-reason: r\n---\nG")])
    again = LC.carry_out(spark, path, "retire", orders(spark, ("p", "a")), "b1", "2024-01-01").collect()
    assert sorted(r["target"] for r in again) == sorted(first) and rows() == moved
    back = LC.carry_out(spark, path, "revive", orders(spark, ("p", "a-2"), ("p", "g"), ("p", "none")), "b2", "2024-01-02").collect()
    assert sorted((r["event"], r["target"]) for r in back) == [("revive", "global\x1fg"), ("revive", "p\x1fa-2")]
    assert ("p", "a-2.md", "", "---\nname: a\n---\nA") in rows() and ("global", "g.md", "", "---\n---\nG") in rows()
    taken = LC.revive(versions.read(spark, path).unionByName(store(spark, ("p", "x", "a-2.md", "y"))), orders(spark, ("p", "a-2"))).first()
    assert (taken["outcome"], taken["target"]) == ("taken", None)


def test_exactly_k_of_the_pool_are_chosen(spark):
    r = random.Random(3)
    names = [f"t{i}" for i in range(37)]
    rows = [(i, "2024-01-01", "inject", t, "x") for i, t in enumerate(names)]
    # In these sessions every target is useful, so recall times the pool is the number chosen.
    rows += [(100 + i, "2024-01-02", "trigger-useful", t, f"s{k}") for k in range(8) for i, t in enumerate(names)]
    log = "line_no bigint, date string, event string, target string, session string"
    got = {x["k"]: x for x in A.ab_random(spark.createDataFrame(rows, log), ks=(1, 5, 36, 37, 99)).collect()}
    assert {k: round(x["recall"] * 37, 6) for k, x in got.items()} == {1: 1, 5: 5, 36: 36, 37: 37, 99: 37} and got[5]["sessions"] == 8
    # Over many sessions with one useful target each, about k of the pool's share is hit.
    many = [(i, "2024-01-01", "inject", t, "x") for i, t in enumerate(names)] + [(i, "2024-01-02", "trigger-useful", r.choice(names), f"s{i}") for i in range(3000)]
    share = A.ab_random(spark.createDataFrame(many, log), ks=(9,)).first()["recall"]
    assert abs(share - 9 / 37) < 0.03
    other = A.ab_random(spark.createDataFrame(many, log), ks=(9,), seed=2).first()["recall"]
    assert other != share
    places = sorted(x["place"] for x in A.numbered_pool(spark.createDataFrame(rows, log)).collect())
    assert places == list(range(37))
