"""A catalogue-shaped graph derived from the star-schema test tables.

Suppliers play the artists, customers the groups, parts the releases, nations
and regions the labels; lineitem gives the credits. Every edge comes from an
equal join or from one row, so the graph grows linearly with the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waxgraph.operators.flatten import all_nodes, edge_row, node_row

GROUP_OFFSET = 1_000_000_000
NATION_OFFSET = 100
ALIAS_STEPS = (1, 10)


@lru_cache(maxsize=None)
def _schema(path: str) -> StructType:
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. The footer is read for the schema once, not at every use."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def group_id(custkey: str = "c_custkey") -> Column:
    return _text(F.col(custkey) + GROUP_OFFSET)


def nation_id(nationkey: str = "n_nationkey") -> Column:
    return _text(F.col(nationkey) + NATION_OFFSET)


def artist_nodes(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Profiles name the nation, the next supplier, and things that do not exist."""
    home = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    joined = supplier.join(home, "s_nationkey")
    profile = F.concat(
        F.lit("Based in [l="), "n_name", F.lit("], works with [a"), _text(F.col("s_suppkey") + 1),
        F.lit("] and [A="), F.lower("s_name"), F.lit("], heard on [r"), _text("s_suppkey"),
        F.lit("] and [m"), _text("s_suppkey"), F.lit("], [aged 79], [b]see[/b] [l="), "n_name",
        F.lit(" Records]"),
    )
    return joined.select(
        *node_row("Artist", _text("s_suppkey"), name=F.col("s_name"), profile=profile)
    )


def group_nodes(customer: DataFrame) -> DataFrame:
    profile = F.concat(
        F.lit("Group of the "), "c_mktsegment", F.lit(" scene in [l"), nation_id("c_nationkey"),
        F.lit("], see [a="), "c_name", F.lit("] or [r="), F.lower("c_mktsegment"), F.lit(" Widget]"),
    )
    return customer.select(*node_row("Group", group_id(), name=F.col("c_name"), profile=profile))


def release_years(lineitem: DataFrame) -> DataFrame:
    first = lineitem.groupBy("l_partkey").agg(F.min("l_shipdate").alias("first"))
    return first.select(F.col("l_partkey").alias("p_partkey"), F.date_format("first", "yyyy-MM-dd").alias("year"))


def release_nodes(part: DataFrame, lineitem: DataFrame | None = None) -> DataFrame:
    """Without ``lineitem`` the year stays null and the table is not read."""
    if lineitem is None:
        return part.select(*node_row("Release", _text("p_partkey"), title=F.col("p_name")))
    dated = part.join(release_years(lineitem), "p_partkey", "left")
    return dated.select(
        *node_row("Release", _text("p_partkey"), title=F.col("p_name"), year=F.col("year"))
    )


def label_nodes(region: DataFrame, nation: DataFrame) -> DataFrame:
    regions = region.select(*node_row("Label", _text("r_regionkey"), name=F.col("r_name")))
    nations = nation.select(*node_row("Label", nation_id(), name=F.col("n_name")))
    return regions.unionByName(nations)


def nodes(spark: SparkSession, sf_dir: str, years: bool = False) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem") if years else None
    return all_nodes(
        artist_nodes(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")),
        group_nodes(table(spark, sf_dir, "customer")),
        release_nodes(table(spark, sf_dir, "part"), lineitem),
        label_nodes(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")),
    )


def solvent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without the suppliers and customers in debt: a graph with holes."""
    return all_nodes(
        artist_nodes(
            table(spark, sf_dir, "supplier").where("s_acctbal >= 0"), table(spark, sf_dir, "nation")
        ),
        group_nodes(table(spark, sf_dir, "customer").where("c_acctbal >= 0")),
        release_nodes(table(spark, sf_dir, "part")),
        label_nodes(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")),
    )


def credited_edges(lineitem: DataFrame) -> DataFrame:
    """One per line, so a supplier and a part can have parallel edges."""
    ordinal = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return lineitem.select(*edge_row("CREDITED", _text("l_suppkey"), _text("l_partkey"), ordinal))


def released_on_edges(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    joined = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = joined.select("l_partkey", "s_nationkey").distinct()
    return pairs.select(*edge_row("RELEASED_ON", _text("l_partkey"), nation_id("s_nationkey")))


def member_edges(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame
) -> DataFrame:
    """Suppliers who served a customer of their own nation."""
    ordered = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Repeats go before the two lookups rather than after them.
    pairs = ordered.select("l_suppkey", "o_custkey").distinct()
    joined = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    local = joined.where("s_nationkey = c_nationkey")
    return local.select(*edge_row("MEMBER_OF", _text("s_suppkey"), group_id()))


def sublabel_edges(nation: DataFrame) -> DataFrame:
    return nation.select(*edge_row("SUBLABEL", nation_id(), _text("n_regionkey")))


def alias_entries(supplier: DataFrame) -> DataFrame:
    """(self, alias, record_no, item_no): each supplier declares the ones a step
    before and after it. The last steps point past the end of the table."""
    steps = [step for size in ALIAS_STEPS for step in (size, -size)]
    items = supplier.select(
        "s_suppkey", F.posexplode(F.array(*[F.lit(step) for step in steps])).alias("item_no", "step")
    )
    other = F.col("s_suppkey") + F.col("step")
    return items.where(other >= 0).select(
        _text("s_suppkey").alias("self"),
        _text(other).alias("alias"),
        F.col("s_suppkey").alias("record_no"),
        "item_no",
    )


def alias_edges(supplier: DataFrame) -> DataFrame:
    """The pairs above that have both ends, smaller id first."""
    entries = supplier.select(
        "s_suppkey", F.explode(F.array(*[F.lit(step) for step in ALIAS_STEPS])).alias("step")
    ).withColumn("other", F.col("s_suppkey") + F.col("step"))
    known = supplier.select(F.col("s_suppkey").alias("other"))
    return entries.join(known, "other").select(
        *edge_row("ALIAS_OF", _text("s_suppkey"), _text("other"))
    )


def edges(spark: SparkSession, sf_dir: str, joined: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """``joined`` is given each of the two parts that take joins of whole tables."""
    lineitem = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    parts = (
        joined(member_edges(lineitem, table(spark, sf_dir, "orders"), supplier, table(spark, sf_dir, "customer"))),
        credited_edges(lineitem),
        alias_edges(supplier),
        sublabel_edges(table(spark, sf_dir, "nation")),
        joined(released_on_edges(lineitem, supplier)),
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def search_queries(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """(query_id, q, limit): for each part name and first nation it is sold from,
    and for each nation its first supplier. As many as there are names, not rows."""
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    pairs = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(
        F.min("s_nationkey").alias("n_nationkey")
    )
    named = part.join(pairs, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_name").agg(
        F.min("n_nationkey").alias("n_nationkey")
    )
    titles = named.join(nation, "n_nationkey").select(
        F.concat("p_name", F.lit(" / "), "n_name").alias("q")
    )
    firsts = supplier.groupBy("s_nationkey").agg(F.min("s_name").alias("q")).select("q")
    return titles.unionByName(firsts).select(
        F.col("q").alias("query_id"), "q", F.lit(limit).alias("limit")
    )
