"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.work import staged


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that edges (a, b) reach; only nodes with an edge to another one are returned.

    Alternating large-star and small-star steps: every node hands its larger, then its smaller neighbours to the
    smallest one, until all hang on their root.  Nodes are any ordered type; each step is grouping by node with
    partial minima and one join.
    """
    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = staged(small.unionByName(down.withColumnRenamed("least", "b")).distinct(), "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
