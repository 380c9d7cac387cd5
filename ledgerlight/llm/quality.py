"""Quality rules with adaptive thresholds (DataFrame functions only).

Every document gets counts from its whole text, computed inside its own row.
No threshold is fixed.  Quantile summaries of the nonzero part of each rate are
built per language and source, per language and over all, with map-side partial
sketches that merge.  A group's limit is the natural break of its summary: the
place that parts the least rate and the quantiles into two classes with the most
variance between them.  Where the upper class isn't at least ``APART`` times as
high as the lower one on average there is no break, and the limit lies as far
above the upper quantile as that is above the median.  Limits of few rows are
drawn towards those of the language, and these towards those of all, by
``PRIOR_ROWS`` rows' worth, but not into the group's own lower class (a group
without a break is one class, up to its limit): from ``STEPS`` rows on, when a
summary has a row for each quantile, not at all, and with fewer rows the less the
more rows there are.  A join brings the limits back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import doc_id, materialize, spread_join

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
GRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Rates judged by group; quantiles of a summary (multiples of 1 / STEPS), and how far apart the means of two classes are at least.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate")
STEPS, APART = 16, 2
#: Accuracy of a quantile summary (rank error 1 / accuracy), and rows that the wider group's limit counts for.
ACCURACY, PRIOR_ROWS = 2000, 50
#: Groups (a key and three limits each) that a broadcast may hold; beyond it they are joined by parts of their rows.
BROADCAST_GROUPS = 1 << 17


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once: inside a lambda an outer expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column) -> Column:
    """Hash of every window of ``GRAM`` words."""
    return F.when(
        F.size(words) >= GRAM,
        F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """Words covered by windows at the given rising starts."""
    return F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.coalesce(F.get(starts, k + 1) - p, F.lit(GRAM)), F.lit(GRAM))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: equal windows are neighbours once sorted."""

    def starts(ordered: Column) -> Column:
        def twin(w: Column, k: Column) -> Column:
            above = F.get(ordered, k + 1)["h"] == w["h"]
            below = F.when(k > 0, F.get(ordered, k - 1)["h"] == w["h"])
            return F.coalesce(above, F.lit(False)) | F.coalesce(below, F.lit(False))

        return F.sort_array(F.transform(F.filter(ordered, twin), lambda w: w["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(pairs, starts), _covered))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every document.

    A null text has no words.  A text without words has zero counts; very long
    texts are handled in their own row in O(n log n); repeated rows are
    measured each; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("u")))
    words = F.transform(F.filter(F.split(text, SEPARATORS), lambda w: w != ""), lambda w: F.xxhash64(w))
    word_counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _let(_hashes(w), _repeated).alias("r")))
    char_counts = _let(bare, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.length(F.translate(x, SYMBOLS, "")).cast("long").alias("rest")))
    counted = docs.select(doc_id(), "lang", "source", line_counts.alias("_l"), word_counts.alias("_w"), char_counts.alias("_c"))
    return counted.select(
        "doc_id",
        "lang",
        "source",
        F.col("_w.n").alias("n_words"),
        F.col("_c.n").alias("word_chars"),
        (F.col("_c.n") - F.col("_c.rest")).alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.u")).alias("n_dup_lines"),
        F.col("_l.n").alias("n_lines"),
        F.col("_w.r").alias("n_repeat_words"),
    )


def _rates(measured: DataFrame) -> DataFrame:
    one = F.lit(1)
    return measured.withColumns(
        {
            "symbol_rate": F.col("n_symbols") / F.greatest("word_chars", one),
            "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", one),
            "repeat_rate": F.col("n_repeat_words") / F.greatest("n_words", one),
        }
    )


def _limit(points: Column) -> Column:
    """The limit from a group's least rate and its ``STEPS`` quantiles, in order, and the top of its lower class; null without them."""

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, x: total + x) / F.size(values)

    def parted(k: Column) -> Column:
        low, high = mean(F.slice(points, F.lit(1), k)), mean(F.slice(points, k + 1, STEPS + 1 - k))
        score = (k * (STEPS + 1 - k)).cast("double") * (high - low) * (high - low)
        return F.struct(score.alias("score"), (-k).alias("k"), F.get(points, k - 1).alias("top"), ((F.get(points, k - 1) + F.get(points, k)) / F.lit(2.0)).alias("at"), (high >= F.lit(float(APART)) * low).alias("apart"))

    upper, median = F.get(points, F.lit(STEPS - 1)), F.get(points, F.lit(STEPS // 2))
    whole = upper + (upper - median)
    breaks = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), parted)

    def chosen(b: Column) -> Column:
        parts = b["apart"] & (b["score"] > 0)
        return F.struct(F.when(parts, b["at"]).otherwise(whole).alias("at"), F.when(parts, b["top"]).otherwise(whole).alias("top"))

    return F.when(F.size(points) == STEPS + 1, _let(F.array_max(breaks), chosen))


def thresholds(rated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of ``keys`` (nulls are a group): its rows and, per rate, its limit and the top of its lower class, null where every rate is 0."""
    steps = [k / STEPS for k in range(1, STEPS + 1)]
    summaries = []
    for r in RATES:
        some = F.when(F.col(r) > 0, F.col(r))
        summaries += [F.min(r).alias(f"least_{r}"), F.percentile_approx(some, steps, ACCURACY).alias(f"steps_{r}")]
    found = rated.groupBy(*keys).agg(F.count("*").alias("group_rows"), *summaries)
    points = [F.when(F.col(f"steps_{r}").isNotNull(), F.concat(F.array(f"least_{r}"), f"steps_{r}")) for r in RATES]
    found = found.select(*keys, "group_rows", *[x.alias(f"points_{r}") for x, r in zip(points, RATES)])
    found = found.select(*keys, "group_rows", *[_let(F.col(f"points_{r}"), _limit).alias(f"limit_{r}") for r in RATES])
    return found.select(*keys, "group_rows", *[F.col(f"limit_{r}")[part].alias(f"{name}_{r}") for r in RATES for part, name in (("at", "max"), ("top", "top"))])


def _drawn(rate: str, wide: str) -> Column:
    """A group's limit drawn towards that of the wider group, but not into its lower class; either one where the other is null."""
    n, own, top, wider = F.col("group_rows").cast("double"), F.col(f"max_{rate}"), F.col(f"top_{rate}"), F.col(wide)
    least = F.when(n >= STEPS, top).otherwise(wider + (top - wider) * (n - F.lit(1.0)) / F.lit(float(STEPS - 1)))
    return F.coalesce(F.greatest(wider + (own - wider) * n / (n + F.lit(float(PRIOR_ROWS))), least), own, wider)


def limits(sound: DataFrame) -> DataFrame:
    """One row per language and source of ``sound`` (rated rows): group and, per rate, the limit that holds; null where every rate of the corpus is 0."""
    whole = thresholds(sound, [])
    langs = thresholds(sound, ["lang"]).join(F.broadcast(whole.select(*[F.col(f"max_{r}").alias(f"all_{r}") for r in RATES])))
    langs = langs.select(F.col("lang").alias("of"), *[_drawn(r, f"all_{r}").alias(f"lang_{r}") for r in RATES])
    groups = thresholds(sound, ["lang", "source"]).join(langs, F.col("lang").eqNullSafe(F.col("of")))
    return groups.select("lang", "source", _group().alias("group"), *[_drawn(r, f"lang_{r}").alias(f"max_{r}") for r in RATES])


def _group() -> Column:
    return F.xxhash64("lang", F.col("lang").isNull(), "source", F.col("source").isNull())


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document.

    ``base_failed``: fewer than 10 words, or more than 20 % of the words inside
    repeated five-word windows.  ``kept``: not base_failed, and no rate above
    the limit of the document's language and source; a rate at the limit is
    kept.  Documents that base_failed stay out of the summaries; a null language
    or source is a value of its own.  An empty table gives no rows.
    """
    rated = _rates(materialize(measure(docs), "quality-counts"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = rated.withColumn("base_failed", failed).withColumn("group", _group())
    found = materialize(limits(rated.filter(~F.col("base_failed"))).drop("lang", "source"), "quality-limits")
    if found.count() <= BROADCAST_GROUPS:
        joined = rated.join(F.broadcast(found), "group", "left")
    else:
        joined = spread_join(rated, found, "group", F.col("doc_id"))
    within = F.lit(True)
    for r in RATES:
        within = within & (F.col(f"max_{r}").isNull() | (F.col(r) <= F.col(f"max_{r}")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(*columns, (~F.col("base_failed") & within).alias("kept"), *[f"max_{r}" for r in RATES])


def oracle() -> str:
    """DuckDB SQL of the query's rows; quantiles are exact, as summaries of groups under some ten thousand rows are."""

    def break_at(p: str) -> str:
        """The limit from the points in column ``p``, and the top of the lower class."""
        x = [f"{p}[{i + 1}]" for i in range(STEPS + 1)]
        mean = lambda v: f"(({' + '.join(v)}) / {len(v)}.0::DOUBLE)"
        breaks = []
        for k in range(1, STEPS + 1):
            low, high = mean(x[:k]), mean(x[k:])
            breaks.append(f"{{'score': {k * (STEPS + 1 - k)}::DOUBLE * ({high} - {low}) * ({high} - {low}), 'k': {-k}, 'top': {x[k - 1]}, 'at': ({x[k - 1]} + {x[k]}) / 2.0::DOUBLE, 'apart': {high} >= {APART}::DOUBLE * {low}}}")
        upper, median = x[STEPS - 1], x[STEPS // 2]
        best = f"list_reverse_sort([{', '.join(breaks)}])[1]"
        one = lambda part: f"CASE WHEN brk.apart AND brk.score > 0 THEN brk.{part} ELSE {upper} + ({upper} - {median}) END"
        return f"list_transform([{best}], lambda brk: {{'at': {one('at')}, 'top': {one('top')}}})[1]"

    steps = f"[{', '.join(str(k / STEPS) for k in range(1, STEPS + 1))}]"
    rates = ("a", "b", "c")

    def group(name: str, keys: str) -> str:
        found = ", ".join(f"CASE WHEN count(*) FILTER ({r} > 0) > 0 THEN list_prepend(min({r}), quantile_disc({r}, {steps}) FILTER ({r} > 0)) END AS {r}" for r in rates)
        by = f"GROUP BY {keys}" if keys else ""
        limit = ", ".join(f"CASE WHEN {r} IS NOT NULL THEN {break_at(r)} END AS {r}" for r in rates)
        return f"{name} AS (SELECT {keys + ', ' if keys else ''}n, {limit} FROM (SELECT {keys + ', ' if keys else ''}count(*)::DOUBLE AS n, {found} FROM rated WHERE NOT base_failed {by}))"

    def drawn(own: str, wide: str, r: str) -> str:
        n, at, top = f"{own}.n", f"({own}.{r})['at']", f"({own}.{r})['top']"
        least = f"CASE WHEN {n} >= {STEPS} THEN {top} ELSE {wide} + ({top} - {wide}) * ({n} - 1.0::DOUBLE) / {STEPS - 1}.0::DOUBLE END"
        return f"coalesce(greatest({wide} + ({at} - {wide}) * {n} / ({n} + {PRIOR_ROWS}.0::DOUBLE), {least}), {at}, {wide}) AS {r}"

    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM base),
grams AS (SELECT rid, i, array_to_string(w[i:i + 4], chr(1)) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM base) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines l ON l.rid = w.rid LEFT JOIN covered c ON c.rid = w.rid),
rated AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b, n_repeat_words / greatest(n_words, 1) AS c FROM counted),
{group("t", "")},
{group("l0", "lang")},
l AS (SELECT l0.lang, {", ".join(drawn("l0", f"(t.{r})['at']", r) for r in rates)} FROM l0, t),
{group("s", "lang, source")},
lim AS (SELECT s.lang, s.source, {", ".join(drawn("s", f"l.{r}", r) for r in rates)} FROM s JOIN l ON l.lang IS NOT DISTINCT FROM s.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"(lim.{r} IS NULL OR r.{r} <= lim.{r})" for r in rates)} AS kept
FROM rated r LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM r.lang AND lim.source IS NOT DISTINCT FROM r.source
"""
