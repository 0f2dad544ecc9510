"""Counts and shares of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators.adjacency import unconnected, with_degree
from waxgraph.operators.latest import top_per
from waxgraph.session import settle


def count_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(column, n) for each of ``values``, those that do not occur included.

    One global aggregate of conditional counts: nothing is shuffled but one row
    per task.
    """
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    rows = [F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values]
    return counts.select(F.inline(F.array(*rows)))


def node_counts(nodes: DataFrame, kinds: Sequence[str] = fixed.KINDS) -> DataFrame:
    return count_values(nodes, "kind", kinds)


def edge_counts(edges: DataFrame, types: Sequence[str] = fixed.EDGE_TYPES) -> DataFrame:
    return count_values(edges, "type", types)


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def graph_shares(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, value, share, position): counts with their share in per cent,
    numbered from the largest down, totals, and the ratios of edges to nodes. A ratio
    without a divisor is null."""
    unplaced = F.lit(None).cast("int").alias("position")

    def section(name: str, counts: DataFrame, key: str) -> DataFrame:
        total = counts.agg(F.sum("n")).scalar()
        listed = counts.select(
            F.lit(name).alias("section"),
            F.col(key).alias("key"),
            F.col("n").cast("double").alias("value"),
            F.round(_share(F.col("n"), total), 6).alias("share"),
            # One row per kind or type.
            F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.col("n").desc(), F.col(key))).alias("position"),
        )
        summed = counts.agg(F.sum("n").cast("double").alias("value")).select(
            F.lit(name).alias("section"),
            F.lit("total").alias("key"),
            "value",
            F.lit(None).cast("double").alias("share"),
            unplaced,
        )
        return listed.unionByName(summed)

    # Nine rows, from one pass over each table; the rest is arithmetic on them.
    kinds, types = settle(node_counts(nodes)), settle(edge_counts(edges))

    def count_of(counts: DataFrame, column: str, value: str) -> Column:
        return counts.agg(F.sum(F.when(F.col(column) == value, F.col("n")))).scalar()

    ratios = kinds.agg(F.sum("n").alias("nodes")).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit("ratios").alias("section"),
                        F.lit(name).alias("key"),
                        F.round(F.try_divide(over.cast("double"), under), 6).alias("value"),
                        F.lit(None).cast("double").alias("share"),
                        unplaced,
                    )
                    for name, over, under in (
                        ("edges per node", types.agg(F.sum("n")).scalar(), F.col("nodes")),
                        (
                            "credits per release",
                            count_of(types, "type", "CREDITED"),
                            count_of(kinds, "kind", "Release"),
                        ),
                        (
                            "members per group",
                            count_of(types, "type", "MEMBER_OF"),
                            count_of(kinds, "kind", "Group"),
                        ),
                    )
                ]
            )
        )
    )
    return section("nodes", kinds, "kind").unionByName(section("edges", types, "type")).unionByName(ratios)


def hubs(nodes: DataFrame, edges: DataFrame, top: int = fixed.HUBS_TOP) -> DataFrame:
    """The ``top`` best connected nodes of every kind."""
    ranked = with_degree(
        nodes.select("space", "kind", "id", "id_num", X.display_title().alias("title")), edges
    )
    order = [F.col("degree").desc(), F.col("id_num").asc(), F.col("id").asc()]
    return top_per(ranked, ["kind"], order, top).select(
        "kind", F.col("rk").alias("position"), "id", "title", "degree"
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, orphans, nodes, share): nodes without an edge and their share."""
    alone = node_counts(unconnected(nodes.select("space", "kind", "id"), edges))
    total = node_counts(nodes)
    joined = total.withColumnRenamed("n", "nodes").join(
        alone.withColumnRenamed("n", "orphans"), "kind"
    )
    share = F.round(_share(F.col("orphans"), F.col("nodes")), 6)
    return joined.select("kind", "orphans", "nodes", share.alias("share"))


def decades(releases: DataFrame, year: str = "year") -> DataFrame:
    """(decade, n) of releases whose year has four characters or more."""
    dated = releases.where(F.length(year) >= 4)
    decade = F.concat(F.substring(year, 1, 3), F.lit("0s"))
    return dated.groupBy(decade.alias("decade")).agg(F.count(F.lit(1)).alias("n"))


def with_bars(counts: DataFrame, width: int = fixed.BAR_WIDTH) -> DataFrame:
    """Counts with the length of their bar, the highest being ``width`` long."""
    peak = counts.agg(F.greatest(F.max("n"), F.lit(1))).scalar()
    return counts.withColumn("bar", F.floor(F.col("n") / peak * width).cast("int"))


def flat_report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, row): any result tables as one, each row as JSON text."""
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        for name, df in sections.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
