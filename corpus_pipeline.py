"""The corpus pipeline: language, boilerplate lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import decontam, jaccard, langid, linededup, packing
from ledgerlight.llm.runtime import materialize, quoted, sweep, table, written

#: Least share of the evidence for the predicted language; texts without letters have none.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; ``lang`` keeps its value, and takes the prediction where it is null."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*quoted(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines; ``n_chars`` follows the text."""
    found = linededup.remove_boilerplate(docs)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*quoted(docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near copies (five-word shingles, 0.8)."""
    return jaccard.keep_one_per_group(docs, gram=5, threshold=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    return decontam.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, with_ids=False).drop("input_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Alignment, components and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents that all stages keep; a stage's tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = written(spark)
    for name, stage in STAGES[:-1]:
        docs = sweep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"), before)
    return STAGES[-1][1](spark, docs, sf_dir)
