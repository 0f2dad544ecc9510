"""Both directions of every edge, degrees, and neighbour lists of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators.latest import top_per

# The id comes first: sorts compare their first key before all others, and only a
# handful of spaces exist.
NODE = ["id", "space"]
EDGE = ["type", "src", "dst", "ordinal"]


def is_loop() -> Column:
    return (F.col("src_space") == F.col("dst_space")) & (F.col("src") == F.col("dst"))


def endpoints(edges: DataFrame, *keep: str, loops_twice: bool = False) -> DataFrame:
    """(*keep, space, id, other_space, other): one row for each end of an edge.

    A loop has one end unless ``loops_twice``. Edges are read once.
    """

    def end(space: str, id_: str, other_space: str, other: str) -> Column:
        return F.struct(
            F.col(space).alias("space"),
            F.col(id_).alias("id"),
            F.col(other_space).alias("other_space"),
            F.col(other).alias("other"),
        )

    start = end("src_space", "src", "dst_space", "dst")
    finish = end("dst_space", "dst", "src_space", "src")
    both = F.array(start, finish)
    ends = both if loops_twice else F.when(is_loop(), F.array(start)).otherwise(both)
    return edges.select(*keep, F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    """(space, id, degree) of every node with an edge; parallel edges all count."""
    return endpoints(edges).groupBy(*NODE).agg(F.count(F.lit(1)).alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their degree, 0 where there is no edge."""
    joined = nodes.join(degrees(edges), NODE, "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def unconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches."""
    return nodes.join(endpoints(edges).select(*NODE).distinct(), NODE, "left_anti")


def _near(edges: DataFrame) -> DataFrame:
    """Both ends of every edge of a known type, as narrow as they can be.

    An edge is told by the rank of its type, its other end and its direction;
    names and both ids come back in ``unfold``, after the shuffles.
    """

    def end(space: str, id_: str, other: str, forward: bool) -> Column:
        return F.struct(
            F.col(id_).alias("id"),
            F.col(space).alias("space"),
            F.col(other).alias("other"),
            F.lit(forward).alias("forward"),
        )

    start, finish = end("src_space", "src", "dst", True), end("dst_space", "dst", "src", False)
    ends = F.when(is_loop(), F.array(start)).otherwise(F.array(start, finish))
    return edges.where(F.col("type").isin(*fixed.EDGE_TYPES)).select(
        X.type_rank(F.col("type")).alias("rank"),
        X.numeric_id(F.col("src")).alias("src_num"),
        X.numeric_id(F.col("dst")).alias("dst_num"),
        "ordinal",
        F.inline(ends),
    )


def _first_edges(near: DataFrame, cap: int) -> DataFrame:
    """Rarest type first, then by number of the ends, then by position."""
    order = [F.col(name).asc() for name in ("rank", "src_num", "dst_num", "other", "ordinal", "forward")]
    first = top_per(near, NODE, order, cap).withColumn("cap", F.lit(cap))
    return first.select(*NODE, "rk", "rank", "forward", "ordinal", "other", "cap")


def adjacency(edges: DataFrame, cap: int = fixed.LIMIT_MAX) -> DataFrame:
    """Every node's first ``cap`` edges, numbered by ``rk`` in budget order.

    Written once this answers all requests up to ``cap`` by ``rk <= limit``; the cap
    stays with the rows, so that a larger request is refused instead of cut. Spending one budget type by type, each type taking
    what the ones before it left, is the same as cutting the ordered list.
    """
    return _first_edges(_near(edges), cap)


def merge_adjacency(old: DataFrame, edges: DataFrame, cap: int = fixed.LIMIT_MAX) -> DataFrame:
    """``adjacency`` of a graph that has got ``edges``, from the one it had.

    A node's first ``cap`` edges are among those that were first before and the new ones;
    a new edge of a rare type pushes out the last one.
    """
    columns = ["rank", "src_num", "dst_num", "ordinal", *NODE, "other", "forward"]
    number, other = X.numeric_id(F.col("id")), X.numeric_id(F.col("other"))
    kept = old.withColumns(
        {"src_num": F.when(F.col("forward"), number).otherwise(other), "dst_num": F.when(F.col("forward"), other).otherwise(number)}
    )
    return _first_edges(kept.select(*columns).unionByName(_near(edges).select(*columns)), cap)


def adjacency_of(
    edges: DataFrame, wanted: DataFrame, cap: int = fixed.LIMIT_MAX
) -> DataFrame:
    """The same for the nodes in ``wanted`` only, without a stored table."""
    return _first_edges(_near(edges).join(wanted.select(*NODE), NODE, "left_semi"), cap)


def unfold(near: DataFrame) -> DataFrame:
    """Replace rank and direction by type, src, dst and other_space; rows of nodes
    without an edge stay null in all of them."""
    rank, forward = F.col("rank"), F.col("forward")

    def by_rank(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(value) for value in values]), rank)

    starts = by_rank([fixed.EDGE_SPACES[name][0] for name in fixed.EDGE_TYPES])
    finishes = by_rank([fixed.EDGE_SPACES[name][1] for name in fixed.EDGE_TYPES])
    return near.withColumns(
        {
            "type": by_rank(list(fixed.EDGE_TYPES)),
            "src": F.when(forward, F.col("id")).when(~forward, F.col("other")),
            "dst": F.when(forward, F.col("other")).when(~forward, F.col("id")),
            "other_space": F.when(forward, finishes).when(~forward, starts),
        }
    ).drop("rank", "forward")
