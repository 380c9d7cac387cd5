"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, extraction, jaccard, langid, lexsearch, linededup, lmscore, packing, quality, sharding, suffixdedup, tokenfile
from .runtime import doc_id, new_path, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("input_ids")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.apply_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_flagged", "n_removed", "text")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("first", "_key")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as of good quality and not toxic.

    The labels grow with the documents, so the join sorts at every size.
    """
    docs = table(spark, sf_dir, "documents").select(doc_id(), "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select(doc_id(), F.lit(True).alias("target")).distinct().hint("merge")
    return lmscore.score_corpus(docs.join(good, "doc_id", "left"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents").select(doc_id(), "text"), path)
    return tokenfile.token_digests(tokenfile.read_tokens(spark, path))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexsearch.build_index(table(spark, sf_dir, "documents").select(doc_id(), "text"))
    return lexsearch.search(index, table(spark, sf_dir, "benchmark"))


_QUERIES = (
    op1_packing,
    op2_decontamination,
    op3_sharding,
    op4_quality_rules,
    op5_line_dedup,
    op6_language_id,
    op7_html_extraction,
    op8_suffix_array_dedup,
    op9_jaccard_join,
    op10_lm_scoring,
    op11_filter_audit,
    op12_token_files,
    op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.oracle(), "op5_line_dedup": linededup.oracle(), "op11_filter_audit": audit.oracle(), "op13_lexical_search": lexsearch.oracle()}
