"""Cross-site boilerplate lines, by HyperLogLog sketches and exact counts near the threshold.

Every non-blank line is hashed.  Per line hash, sketches of the sites that hold
it are built map-side and merge in the aggregation.  A spread well beyond the
threshold, or well below it, is decided by the sketch; lines in the band of the
sketch's error get an exact distinct count.  Flagged lines leave the documents.

Copies of one text make its lines look like boilerplate.  A document that
consists mostly of flagged lines is left whole, for the near-duplicate stage to
decide, if it is shown to be a copy: its text, or two neighbouring flagged lines
of it, stand in another document that consists mostly of flagged lines.  From
any other document flagged lines go, whatever their share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, quoted, spread_join, unused

#: Distinct sites from which on a line is boilerplate; share of a document's characters beyond which it may be a copy.
MIN_SITES, MAX_SHARE = 8, 0.5
#: log2 of a sketch's registers (standard error 1.04 / 32 at 10), and half width of the band that is counted exactly, as a share of the threshold.
LOG2_REGISTERS, BAND = 10, 0.25
#: Flagged lines (16 bytes each) that a broadcast may hold; beyond it they are joined by parts of their rows.
BROADCAST_LINES = 1 << 20
BLANKS = " \t\x0b\x0c\r"


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")))


def flagged_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes ``h`` of the lines found on at least ``min_sites`` distinct sites; ``lines`` has h and site (null: no site)."""
    spread = lines.groupBy("h").agg(F.hll_sketch_agg("site", LOG2_REGISTERS).alias("_s"), F.count("site").alias("_n")).filter(F.col("_n") >= min_sites)
    spread = materialize(spread.select("h", F.hll_sketch_estimate("_s").alias("sites")), "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + BAND)).select("h")
    near = spread.filter(F.col("sites").between(min_sites * (1 - BAND), min_sites * (1 + BAND))).select("h")
    exact = lines.select("h", "site").distinct().join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("_n")).filter(F.col("_n") >= min_sites).select("h")
    return sure.union(exact)


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE, site: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines taken out of ``text``.

    Adds n_lines, n_flagged, n_removed (long).  Lines are split at \\n and
    compared without outer blanks; blank lines are never flagged.  A document
    of which more than ``max_share`` of the non-blank lines' characters is
    flagged keeps its text if it is a copy as said above.  A null text stays
    null with zero counts; a null site counts for no line; equal rows are
    treated alike, each on its own, and are copies of each other; input columns
    named n_lines, n_flagged or n_removed are replaced; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_flagged", "n_removed")]
    key, flags, found = (unused(kept, x) for x in ("_key", "_flags", "_found"))
    keyed = docs.select(*quoted(kept), F.xxhash64("text", F.lit("line-dedup")).alias(key))
    exploded = (
        keyed.filter(F.col("text").isNotNull())
        .select(F.col(key).alias("key"), quoted([site])[0].cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .filter(F.length(F.translate("line", BLANKS, "")) > 0)
        .select("key", "site", _line_key(F.col("line")).alias("h"))
    )
    # One row per text, line and site: copies of a text on one site, and repeats in it, add nothing.
    lines = materialize(exploded.distinct(), "lines")
    flagged = materialize(flagged_lines(lines.select("h", "site"), min_sites), "line-flags")
    held = lines.select("key", "h").distinct()
    held = held.join(F.broadcast(flagged), "h") if flagged.count() <= BROADCAST_LINES else spread_join(held, flagged, "h", F.col("key"), "inner")
    per_text = held.groupBy("key").agg(F.collect_set("h").alias(flags)).withColumnRenamed("key", key)
    joined = spread_join(keyed, per_text, key, F.xxhash64(*quoted(kept)))

    def blank(x: Column) -> Column:
        return F.length(F.translate(x, BLANKS, "")) == 0

    known = F.coalesce(F.col(flags), F.array().cast("array<bigint>"))
    marked = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("x"), (~blank(x) & F.array_contains(known, _line_key(x))).alias("f"), blank(x).alias("b")))

    def counted(m: Column) -> Column:
        solid = F.filter(m, lambda e: ~e["b"])
        gone = F.filter(m, lambda e: e["f"])

        def chars(a: Column) -> Column:
            return F.aggregate(a, F.lit(0).cast("long"), lambda s, e: s + F.length(e["x"]))

        def neighbours(s: Column) -> Column:
            pairs = F.transform(s, lambda e, i: F.when(e["f"] & F.get(s, i + 1)["f"], F.xxhash64(_line_key(e["x"]), _line_key(F.get(s, i + 1)["x"]))))
            return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))

        most = chars(gone) > max_share * chars(solid)
        return F.struct(
            F.size(solid).cast("long").alias("n"),
            F.size(gone).cast("long").alias("f"),
            most.alias("most"),
            F.when(most, F.get(F.transform(F.array(solid), neighbours), F.lit(0))).alias("pairs"),
            F.array_join(F.transform(F.filter(m, lambda e: ~e["f"]), lambda e: e["x"]), "\n").alias("rest"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("f"), F.lit(False).alias("most"), F.lit(None).cast("array<bigint>").alias("pairs"), F.lit(None).cast("string").alias("rest"))
    work = joined.withColumn(found, F.when(F.col(flags).isNotNull(), F.get(F.transform(F.array(marked), counted), F.lit(0))).otherwise(none)).drop(flags)
    # Texts without a flagged line need no marks, only the number of their lines.
    size = F.size(F.filter(F.split("text", "\n"), lambda x: ~blank(x))).cast("long")
    work = materialize(work.withColumn(found, F.when((F.col(f"{found}.f") == 0) & F.col("text").isNotNull(), F.col(found).withField("n", size)).otherwise(F.col(found))), "line-marked")

    mostly = work.filter(F.col(f"{found}.most")).select(F.col(key).alias("key"), F.col(f"{found}.pairs").alias("pairs"))
    texts = mostly.groupBy("key").agg(F.count("*").alias("n"), F.first("pairs").alias("pairs"))
    pairs = texts.select("key", F.explode("pairs").alias("pair"))
    shared = pairs.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1").select("pair", F.lit(True).alias("shared"))
    copies = texts.filter("n > 1").select("key").union(spread_join(pairs, shared, "pair", F.col("key"), "inner").select("key")).distinct()
    copies = copies.select(F.col("key").alias(key), F.lit(True).alias(flags))

    def result(rows: DataFrame, go: Column) -> DataFrame:
        columns = [F.when(go, F.col(f"{found}.rest")).otherwise(F.col("text")).alias("text") if c == "text" else quoted([c])[0] for c in kept]
        removed = F.when(go, F.col(f"{found}.f")).otherwise(F.lit(0).cast("long"))
        return rows.select(*columns, F.col(f"{found}.n").alias("n_lines"), F.col(f"{found}.f").alias("n_flagged"), removed.alias("n_removed"))

    plain = result(work.filter(~F.col(f"{found}.most")), F.col(f"{found}.f") > 0)
    judged = spread_join(work.filter(F.col(f"{found}.most")), copies, key, F.xxhash64(*quoted(kept)))
    return plain.union(result(judged, F.col(flags).isNull()))


def oracle(min_sites: int = MIN_SITES, max_share: float = MAX_SHARE) -> str:
    """DuckDB SQL of the query's rows, with exact counts for every line."""
    strip = "trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ')"
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
parts AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM base WHERE text IS NOT NULL),
solid AS (SELECT rid, source, i, x, {strip} AS k FROM parts),
flags AS (SELECT k FROM solid WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites}),
marked AS (SELECT s.rid, s.i, s.x, s.k, s.k <> '' AS b, f.k IS NOT NULL AS f FROM solid s LEFT JOIN flags f ON s.k = f.k AND s.k <> ''),
per AS (
  SELECT rid, count(*) FILTER (WHERE b) AS n, count(*) FILTER (WHERE f) AS f,
    coalesce(sum(length(x)) FILTER (WHERE f), 0) > {max_share} * coalesce(sum(length(x)) FILTER (WHERE b), 0) AS most,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT f), '') AS rest
  FROM marked GROUP BY rid),
mostly AS (SELECT rid, text FROM base JOIN per USING (rid) WHERE most),
pairs AS (
  SELECT DISTINCT text, k, k2 FROM (
    SELECT rid, k, f, lead(k) OVER w AS k2, lead(f) OVER w AS f2 FROM marked WHERE b WINDOW w AS (PARTITION BY rid ORDER BY i))
  JOIN mostly USING (rid) WHERE f AND f2),
copies AS (
  SELECT text FROM mostly GROUP BY text HAVING count(*) > 1
  UNION SELECT text FROM pairs SEMI JOIN (SELECT k, k2 FROM pairs GROUP BY k, k2 HAVING count(*) > 1) USING (k, k2)),
judged AS (SELECT base.*, n, f, rest, f > 0 AND NOT (most AND text IN (SELECT text FROM copies)) AS go FROM base LEFT JOIN per USING (rid))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(f, 0)::BIGINT AS n_flagged,
  CASE WHEN go THEN f ELSE 0 END::BIGINT AS n_removed, CASE WHEN go THEN rest ELSE text END AS text
FROM judged
"""
