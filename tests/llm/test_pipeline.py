"""The pipeline's stages on planted documents, and the registered queries on the smallest tables."""

import re

import __spark_entry__
import corpus_pipeline
from ledgerlight.llm import decontam, linededup

from ..conftest import DATA
from . import helpers as H


def test_stages(spark, tmp_path):
    item = " ".join(H.prose(500, 30, 10**5))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, "shared footer line\n" + " ".join(H.prose(i, 80, 10**5)), "en", f"s{i % 10}") for i in range(30)]
    rows += [(50, rows[3][1], "en", "s1"), (51, rows[4][1].replace(rows[4][1].split()[40], "zz"), "en", "s2"), (52, " ".join(H.prose(7, 30)) + " " + item, "en", "s3"), (53, "12 34", "en", "s4"), (54, None, "en", "s5")]
    docs, columns = H.documents(spark, rows), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            columns = columns or docs.columns
            assert docs.columns == columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "line_dedup":
            assert all("shared footer line" not in r["text"] for r in docs.collect())
    everything = {r[0] for r in rows}
    assert seen["language_id"] == everything - {53, 54} == seen["line_dedup"]
    assert seen["near_copies"] == seen["line_dedup"] - {50, 51}
    assert seen["decontamination"] == seen["near_copies"] - {52} == seen["packing"]


def test_pipeline_equals_plain_stages(spark):
    """Brute force over the smallest tables: components and leaks of what the first two stages keep."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, DATA)
    second = corpus_pipeline.line_dedup(spark, first, DATA).collect()
    assert {r["doc_id"] for r in second} == {r["doc_id"] for r in first.collect()}
    order = sorted(second, key=lambda r: r["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in order]
    alone = [rows[i] for i, (_, c) in enumerate(H.components(rows, 5, 80, 100)) if c == i]
    items = [(r["item_id"], decontam.words(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaks(text):
        passage = decontam.words(text)
        there = set(passage)
        # A score needs that many matching words at least.
        near = (w for _, w in items if len(w) >= decontam.MIN_WORDS and sum(x in there for x in w) >= decontam.THRESHOLD * len(w))
        return any(decontam.align(w, passage)[0] >= decontam.THRESHOLD * 2 * len(w) for w in near)

    kept = {i for i, t in alone if not leaks(t)}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
    assert got == kept


def test_registered_queries(spark):
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    n_docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for n in ("op3_sharding", "op4_quality_rules", "op6_language_id", "op9_jaccard_join"):
        assert __spark_entry__.queries()[n](spark, DATA).count() == n_docs
    assert __spark_entry__.entry(spark).count() > 0
    assert linededup.oracle().strip().startswith("WITH")
