"""How filters interact: what each removes, repeats or alone catches at every place of every order.

A document's failures are one bit mask; documents are counted by part and mask
before anything else, so that all later work is on cells, of which a part has at
most 2 ** filters.  Cells are put against every order of the filters and
unpivoted into one row per step.  A running bit-or over the earlier steps tells
whether a cell's documents are gone already, conditional sums give the counts of
a step, and a window over all rows of a filter gives its total over the orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, spread_join

WORDS_LEAST, CAPITALS_MOST, DISTINCT_LEAST = 200, 2, 50
FILTERS = "ABCDE"
#: Orders of more filters than this would be over 5,040 a cell.
FILTERS_MOST = 7


def text_mask(text: Column) -> Column:
    """Failures that the text alone decides: 1 (A) few words, 2 (B) few distinct words, 4 (C) capitals, 8 (D) symbols; null is an empty text."""
    t = F.coalesce(text, F.lit(""))
    # One pass over the words: they are bound once, as an array of one element.
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    bits = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < WORDS_LEAST, 1).otherwise(0) + F.when(F.size(F.array_distinct(w)) * 100 < F.size(w) * DISTINCT_LEAST, 2).otherwise(0),
    )[0]
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    return bits + F.when(capitals.cast("long") * 100 > F.length(t).cast("long") * CAPITALS_MOST, 4).otherwise(0) + F.when(t.rlike("[#$%&*|]"), 8).otherwise(0)


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source (null: empty string) and the filters A to E that they fail.

    Bit 16 (E) is set for a text that a smaller doc_id has too; texts are
    compared by 128-bit digests.  A null doc_id has no labels, is smaller than none and has no
    smaller one.  A document is good or toxic if any of its label rows says so;
    documents without labels are neither.  Repeated rows count each; equal ids
    with equal texts are no copies of each other.  Texts leave the scan as a
    digest and a mask.
    """
    slim = docs.select(
        "doc_id",
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest"),
        text_mask(F.col("text")).alias("mask"),
    )
    # Used three times below: written once, so that texts are read once.
    rows = materialize(slim.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    # Joined on both columns, so that the copies of one text are dealt out by their ids.
    rows = rows.join(first.hint("merge"), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    marked = (
        labels.select(
            F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        )
        .groupBy("doc_id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    rows = spread_join(rows.select("doc_id", "digest", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "n"), marked, "doc_id", F.col("digest"))
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from cells (part, mask, n, good, toxic).

    ``filters`` are one letter each, at most ``FILTERS_MOST``; bit k of a mask is
    letter k.  Returns part, filter_order, step (from 1), and the counts kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and shapley (what the
    step's filter removes, summed over all orders).  Cells may repeat; every part
    that has a cell gets all rows, zeros included, and an empty table gives none.
    """
    if not 0 < len(filters) <= FILTERS_MOST or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {FILTERS_MOST} different letters")
    orders = F.split(F.lit(" ".join(map("".join, permutations(filters)))), " ")
    steps = range(1, len(filters) + 1)
    placed = (
        cells.groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        .withColumn("filter_order", F.explode(orders))
        .withColumns({str(k): F.substring("filter_order", k, 1) for k in steps})
        .unpivot(["part", "mask", "n", "good", "toxic", "filter_order"], [str(k) for k in steps], "step", "filter")
        .withColumn("step", F.col("step").cast("int"))
        .withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
        .withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    )
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    there, fails = F.col("earlier") == 0, F.col("failed") != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long")

    found = placed.groupBy("part", "filter_order", "step", "filter").agg(
        total(there & ~fails).alias("kept"),
        total(there & fails).alias("removed"),
        total(~there & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(there & fails, "good").alias("good_lost"),
        total(there & fails, "toxic").alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over all ``docs`` (doc_id, source, text) with ``labels`` (doc_id, quality, toxic).

    Edge cases as in ``failure_cells`` and ``interactions``; other columns are not read.
    """
    return interactions(failure_cells(docs, labels))


def oracle() -> str:
    """The same rows by DuckDB, from the place of a document's first failing filter in each order."""
    return rf"""
    WITH base AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
    ), firsts AS (
        SELECT t, min(doc_id) AS least FROM base GROUP BY t
    ), marks AS (
        SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
    ), split AS (
        SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM base
    ), failing AS (
        SELECT part,
            CASE WHEN len(words) < {WORDS_LEAST} THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < {DISTINCT_LEAST} * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITALS_MOST} * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails,
            coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM split JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
    ), cells AS (
        SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL
    ), letters AS (
        SELECT unnest(string_split('{"".join(FILTERS)}', '')) AS l
    ), orders AS (
        SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
    ), reached AS (
        SELECT *, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda x: x <> ''), lambda x: instr(filter_order, x))), 6) AS gone FROM cells, orders
    ), stepped AS (
        SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS f,
            sum(CASE WHEN gone > step THEN n ELSE 0 END)::BIGINT AS kept,
            sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
            sum(CASE WHEN gone < step AND contains(fails, substr(filter_order, step::INTEGER, 1)) THEN n ELSE 0 END)::BIGINT AS redundant,
            sum(CASE WHEN fails = substr(filter_order, step::INTEGER, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
            sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost,
            sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM reached, range(1, 6) AS s(step) GROUP BY ALL
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
    FROM stepped
    """
