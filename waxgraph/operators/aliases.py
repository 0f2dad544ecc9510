"""Alias pairs: canonical form, resolution to nodes, merge into a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph.functions import text as X
from waxgraph.operators.flatten import edge_row
from waxgraph.session import settle


def ordered(first: Column, second: Column) -> tuple[Column, Column]:
    """The two ids, the numerically smaller one first."""
    straight = X.numeric_id(first) < X.numeric_id(second)
    return F.when(straight, first).otherwise(second), F.when(straight, second).otherwise(first)


def pairs(entries: DataFrame, seq: Column) -> DataFrame:
    """One row per unordered pair (a, b) with the entry that declared it first."""
    a, b = ordered(F.col("self"), F.col("alias"))
    keyed = entries.select(a.alias("a"), b.alias("b"), "self", "alias", seq.alias("seq"))
    first = F.min_by(F.struct("self", "alias"), "seq")
    return keyed.groupBy("a", "b").agg(first.alias("first")).select(
        "a", "b", F.col("first.self").alias("first_self"), F.col("first.alias").alias("first_alias")
    )


def alias_edges(found: DataFrame) -> DataFrame:
    return found.select(*edge_row("ALIAS_OF", F.col("a"), F.col("b")))


def resolve(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``matched``: whether both ids of the pair have a node.

    The rest is found by the pair as a whole, which no id can make hot.
    """
    found = settle(found)
    known = nodes.where(F.col("space") == "entity").select("id")
    both = found.join(known.withColumnRenamed("id", "a"), "a", "left_semi")
    both = settle(both.join(known.withColumnRenamed("id", "b"), "b", "left_semi").select(*found.columns))
    rest = found.join(both, ["a", "b"], "left_anti").select(*found.columns)
    return both.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False)))


def missing_from(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs the graph has no alias edge for yet, in either direction."""
    a, b = ordered(F.col("src"), F.col("dst"))
    present = edges.where(F.col("type") == "ALIAS_OF").select(a.alias("a"), b.alias("b"))
    return found.join(present.distinct(), ["a", "b"], "left_anti")


def statistics(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    """Entries declared, distinct pairs, pairs matched and not, and their share."""
    declared = entries.agg(F.count(F.lit(1)).alias("declared"))
    row = resolved.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("unmatched"),
    )
    share = F.coalesce(F.try_divide(F.col("unmatched") * 100.0, F.col("pairs")), F.lit(0.0))
    return row.select(
        declared.scalar().alias("declared"),
        "pairs",
        "matched",
        "unmatched",
        F.round(share, 6).alias("unmatched_pct"),
    )
