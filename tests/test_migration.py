"""A move of the old store: backups, what is kept, and what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import migrate as M
from ledgerlight.sources import versions


def convert(old):
    keep = F.when(F.col("slug").startswith("drop"), "prune").otherwise("keep")
    return old.select("project", "slug", keep.alias("action"), F.concat(F.lit("projects/"), "project").alias("target_dir"), F.col("slug").alias("new_slug"), F.upper("content").alias("content"))


@pytest.fixture
def places(spark, tmp_path):
    old, new, backups = (f"file://{tmp_path}/{n}" for n in ("old", "new", "backups"))
    rows = [("p", "a.md", "x"), ("q", "a.md", "y"), ("p", "drop.md", "z")]
    versions.replace(spark.createDataFrame(rows, "project string, slug string, content string"), old, ["project", "slug"])
    return old, new, backups


def rows(spark, path):
    return sorted(tuple(r) for r in versions.read(spark, path).collect())


MOVED = [("projects/p", "a.md", "X"), ("projects/q", "a.md", "Y")]
WHOLE = [("p", "a.md", "x"), ("p", "drop.md", "z"), ("q", "a.md", "y")]


def test_what_is_kept_moves_once_and_comes_back(spark, places):
    old, new, backups = places
    assert M.backups(spark, backups) == []
    with pytest.raises(FileNotFoundError):
        M.rollback(spark, old, backups)
    assert M.execute(spark, old, new, backups, convert, "m1") == 0 == M.execute(spark, old, new, backups, convert, "m1")
    assert rows(spark, new) == MOVED and rows(spark, old) == [("p", "drop.md", "z")]
    assert M.backups(spark, backups) == [(1, "m1")]
    M.rollback(spark, old, backups)
    assert rows(spark, old) == WHOLE
    assert M.execute(spark, old, new, backups, convert, "m1") == 0 and rows(spark, old) == [("p", "drop.md", "z")]
    M.rollback(spark, old, backups)
    more = spark.createDataFrame([("r", "b.md", "w", False)], "project string, slug string, content string, deleted boolean")
    versions.upsert(spark, old, more, "add")
    M.execute(spark, old, new, backups, convert, "m2")
    assert rows(spark, new) == sorted([*MOVED, ("projects/r", "b.md", "W")]) and M.backups(spark, backups) == [(1, "m1"), (2, "m2")]
    M.rollback(spark, old, backups)
    assert rows(spark, old) == sorted([*WHOLE, ("r", "b.md", "w")])


@pytest.mark.parametrize("step", [1, 2, 3])
def test_a_failed_move_puts_both_tables_back(spark, places, monkeypatch, step):
    old, new, backups = places
    versions.replace(spark.createDataFrame([("projects/z", "k.md", "before")], "target_dir string, slug string, content string"), new, ["target_dir", "slug"])
    real, calls = versions.upsert, []

    def failing(session, path, changes, batch, base=None):
        calls.append(path)
        if step == 1 or (step == 2 and path == old):
            raise OSError("disk")
        number = real(session, path, changes, batch, base)
        if step == 3 and path == old:
            raise OSError("lost after it was published")
        return number

    with monkeypatch.context() as m:
        m.setattr(versions, "upsert", failing)
        with pytest.raises(OSError):
            M.execute(spark, old, new, backups, convert, "m1")
    assert rows(spark, old) == WHOLE and rows(spark, new) == [("projects/z", "k.md", "before")]
    assert len(calls) == (1 if step == 1 else 2)
    M.execute(spark, old, new, backups, convert, "m1")
    assert rows(spark, new) == [*MOVED, ("projects/z", "k.md", "before")] and rows(spark, old) == [("p", "drop.md", "z")]
