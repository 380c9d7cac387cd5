"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b: long, not null); label is the smallest vertex of its component.

    Each round gives a vertex the least label among its own and its
    neighbours', then the label of its label, so that chains halve; rounds end
    when nothing changes.  All state is written to the shared folder each
    round.  Loops and repeated edges are allowed; an empty table gives no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "v"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = materialize(step, "cc-step")
        jump = step.select(F.col("v").alias("u"), F.col("label").alias("far"))
        new = materialize(step.join(jump, step.label == jump.u).select("v", "old", F.least("label", "far").alias("label")), "cc-labels")
        discard(step)
        discard(labels)
        labels = new
        if new.filter("old <> label").isEmpty():
            discard(both)
            return labels.select("v", "label")
