"""Connected components of an edge table, by alternating star contractions.

A large-star step hangs every larger neighbour of a node on the smallest node it knows, a small-star step does so for
the smaller neighbours. Both only need a minimum for each node (partial aggregates) and a join back, so no group is
gathered in a task; a hot node's rows can be split by skew-join handling. Every round is written to the shared folder,
which cuts the lineage; the rounds end when the edge set no longer changes (a logarithmic number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, work: shared.Work) -> DataFrame:
    """``edges(a, b)`` to ``node, component``: the smallest node reachable. Nodes without edges are absent."""
    now = work.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(now)
    while before[0]:
        now = work.written(_small(_large(now)), "edges")
        after = _print(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
