"""SQL names for the engine's functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RECENCY_DAYS, STOPWORDS, W_EFFECT, W_OVERLAP, W_PROJECT, W_RECENCY, W_USE
from .similarity import indel, set_ratio
from .text import WORD_CLASS


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity (0 to 100) of two texts' token sets; null if either is null."""
    return pd.Series([None if x is None or y is None else set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Make the engine's functions callable from SQL in this session.

    indel_distance(a, b) and token_set_ratio(a, b) run in Arrow batches; the
    others are SQL expressions, which the optimizer sees through:
    tokenize(text), effect_gate(effectiveness), recency(last_injected, created,
    today) and score(overlap, ref_count, effectiveness, last_injected, created,
    today, same_project).
    """
    spark.udf.register("indel_distance", indel)
    spark.udf.register("token_set_ratio", token_set_ratio)
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))
    pattern = WORD_CLASS.replace("\\", "\\\\")
    day = "try_to_date(coalesce(nullif(last_injected, ''), created), 'yyyy-MM-dd')"
    functions = {
        "tokenize(text STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(lower(coalesce(text, '')), '({pattern}{{3,}})', 1), w -> w NOT IN ({words}))",
        "effect_gate(x DOUBLE) RETURNS DOUBLE": "least(greatest(2 * x, 0), 1)",
        "recency(last_injected STRING, created STRING, today DATE) RETURNS DOUBLE": (
            f"CASE WHEN {day} IS NULL THEN 0D ELSE 1 / (1 + greatest(date_diff(today, {day}), 0) / {RECENCY_DAYS}D) END"
        ),
        "score(overlap BIGINT, ref_count BIGINT, effectiveness DOUBLE, last_injected STRING, created STRING, today DATE, same_project BOOLEAN) RETURNS DOUBLE": (
            f"{W_OVERLAP}D * overlap + {W_USE}D * log10(1 + ref_count) * effect_gate(effectiveness) + {W_RECENCY}D * recency(last_injected, created, today)"
            f" + {W_EFFECT}D * effectiveness + CASE WHEN same_project THEN {W_PROJECT}D ELSE 0D END"
        ),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
