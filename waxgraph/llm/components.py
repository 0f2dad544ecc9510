"""Connected components by alternating large-star and small-star rounds.

Every round is a few joins and partial aggregates; no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``node, root`` for every node in the undirected ``links`` (columns a, b).

    ``root`` is the smallest node reachable. Self links and repeats change nothing; a
    node that only links to itself is left out.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while state[0]:
        wide = scratch.keep(_large_star(edges))
        narrow = scratch.keep(_small_star(wide))
        before, state = state, _state(narrow)
        scratch.drop(edges, wide)
        edges = narrow
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
