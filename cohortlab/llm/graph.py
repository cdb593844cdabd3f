"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the least node of the component.

    Every round links a node's larger neighbours to its least one, then its smaller
    neighbours; rounds end when no edge changes, after a number that grows with the
    logarithm of the longest path. Each round's edges are written to the shared folder.
    """
    e = materialize(_tidy(edges.select("a", "b")))
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _tidy(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        # now a > b in every row: the small star of a
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        e = materialize(_tidy(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))))
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    return materialize(e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b"), F.col("b")).distinct()))


def _tidy(edges: DataFrame) -> DataFrame:
    """The larger node first, no loops, no repeats."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
