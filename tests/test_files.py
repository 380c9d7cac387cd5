"""Logs as files: split reading, tails, appends by several writers; stored projections."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import log as L
from ledgerlight.operators import projection as P
from ledgerlight.sources import bind, files, versions

from .conftest import DATA


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "65536")
    yield
    spark.conf.set(name, before)


def numbered(text):
    lines = text.split("\n")
    return list(enumerate(lines[:-1] if lines[-1] == "" else lines, 1))


def test_logs_are_read_in_splits(spark, tmp_path, small_splits):
    r = random.Random(2)
    texts = {
        "a.log": "\n".join(f"2026-01-01|inject|k{i}|{'s' * r.randrange(1, 90)}" for i in range(20_000)) + "\n",
        "b.log": "one\r\n\nthree\rstill three\nlast without end",
        "c.log": "x" * 200_000 + "\ny\n" + "z" * 70_000,
        "d.log": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
        got = files.read_log(spark, str(tmp_path / name))
        assert sorted(map(tuple, got.collect())) == numbered(text)
    assert spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 8
    together = [line for name in sorted(texts) for _, line in numbered(texts[name]) if texts[name]]
    assert [r["value"] for r in files.read_log(spark, str(tmp_path), one_log=True).orderBy("line_no").collect()] == together
    each = files.read_log(spark, str(tmp_path)).groupBy("line_no").count().orderBy("line_no").first()
    assert tuple(each) == (1, 3)


def plain_tail(text, size):
    raw = text.encode()
    part = raw[max(0, len(raw) - size) :].decode("utf-8", "replace").split("\n")
    return [x for x in (part[1:] if len(raw) > size else part) if x]


@pytest.mark.parametrize("size", [1, 20, 21, 22, 40, 1000])
def test_tails(spark, tmp_path, size):
    text = "".join(f"2026-01-0{i}|e|k{i}|s\n" for i in range(1, 8))
    (tmp_path / "log").write_text(text)
    assert files.log_tail(spark, str(tmp_path / "log"), size) == plain_tail(text, size)
    lines = spark.createDataFrame(numbered(text), "line_no bigint, value string")
    assert [r["value"] for r in L.tail(lines, size).orderBy("line_no").collect()] == plain_tail(text, size)
    keys = spark.createDataFrame([(k,) for k in ("k7|s", "k1|s", "e|k", "nowhere", None)], "key string")
    want = {k: k is None or not any(k in x for x in plain_tail(text, size)) for k in ("k7|s", "k1|s", "e|k", "nowhere", None)}
    assert {r["key"]: r["fresh"] for r in L.append_probe(keys, lines, size).collect()} == want
    assert L.append_probe(keys, lines.limit(0), size).filter("fresh").count() == 5


def test_two_writers_add_one_line(spark, tmp_path):
    path = f"file://{tmp_path}/wal"
    assert files.log_tail(spark, path) == []
    added = []

    def write(k):
        added.append(files.append_line(spark, path, f"2026-01-01|dedup-merged|a>b|s{k % 2}", f"dedup-merged|a>b|s{k % 2}", wait=30.0))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(added) == [False] * 4 + [True] * 2
    assert files.append_line(spark, path, "2026-01-02|x|y|z\nw") and files.append_line(spark, path, "2026-01-02|x|y|z\nw")
    lines = [r["value"] for r in files.read_log(spark, path, one_log=True).orderBy("line_no").collect()]
    assert sorted(lines[:2]) == ["2026-01-01|dedup-merged|a>b|s0", "2026-01-01|dedup-merged|a>b|s1"] and lines[2:] == ["2026-01-02|x|y|z w"] * 2
    assert files.log_tail(spark, path, 30) == ["2026-01-02|x|y|z w"]
    rows = spark.createDataFrame([("2026-01-03", "inject", "k", "s")], "date string, event string, target string, session string")
    files.append_log(rows, path)
    assert files.read_log(spark, path).count() == 5


def test_projections_are_stored_whole(spark, tmp_path):
    path = f"file://{tmp_path}/projection"
    facts, wal = bind.facts(spark, DATA), bind.wal(spark, DATA)
    first = P.reproject(facts, wal)
    assert files.store_projection(first, path, "run-1") == 0 == files.store_projection(first, path, "run-1")
    reader = files.load_projection(spark, path)
    files.store_projection(first.withColumn("ref_count", F.lit(7).cast("bigint")), path, "run-2")
    show = lambda df: sorted(map(str, df.select(*first.columns).collect()))
    assert show(reader) == show(first) == show(files.load_projection(spark, path, 0))
    assert {r[0] for r in files.load_projection(spark, path).select("ref_count").distinct().collect()} == {7}
    assert versions.latest(spark, path) == 1


def test_projection_check(spark, tmp_path):
    path, log = f"file://{tmp_path}/projection", f"file://{tmp_path}/wal"
    assert files.projection_check(spark, path, log)[0] == "OK"
    files.append_line(spark, log, "2026-01-01|inject|k|s")
    assert files.projection_check(spark, path, log) == ("WARN", "projection missing, log exists")
    rows = spark.createDataFrame([("p", "k.md")], "project string, slug string")
    files.store_projection(rows, path)
    assert files.projection_check(spark, path, log) == ("OK", "projection version 0")
    written = next(p for p in tmp_path.glob("wal/*.log"))
    later = (tmp_path / "projection/_versions/0000000000.json").stat().st_mtime + 5
    os.utime(written, (later, later))
    assert files.projection_check(spark, path, log)[0] == "WARN"
