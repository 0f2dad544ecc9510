"""Nodes and edge ends in buckets of one hash, so that what joins them needs no exchange.

``nodes`` and ``ends`` (both ends of every edge) are bucketed and sorted by (id, space),
in as many buckets. Degrees, orphans and missing ends then come from tasks that each read
one bucket of either. A hub's ends lie in one bucket: they are counted as they stream by,
in a task as long as that bucket is large.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from waxgraph import schemas
from waxgraph.operators.adjacency import NODE, endpoints

BUCKETS = 200
# Edges whose ends share a bucket, on average.
BUCKET_EDGES = 500_000
ENDS = "id string, space string, type string, is_src boolean, other string, other_space string, ordinal long"


@dataclass(frozen=True)
class BucketedGraph:
    """Tables under ``path``; any session can open them, the layout is stated when they are."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _table(self, name: str, schema: str) -> DataFrame:
        table = f"waxgraph_{name}_{hashlib.md5(f'{self.path} {self.buckets}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} ({schema}) USING parquet LOCATION '{self.path}/{name}' "
                f"CLUSTERED BY ({', '.join(NODE)}) SORTED BY ({', '.join(NODE)}) INTO {self.buckets} BUCKETS"
            )
        return self.spark.table(table)

    def nodes(self) -> DataFrame:
        return self._table("nodes", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.NODES.fields))

    def ends(self) -> DataFrame:
        return self._table("ends", ENDS)

    def degrees(self) -> DataFrame:
        """(id, space, degree) of every node with an edge; a loop counts once."""
        return self.ends().groupBy(*NODE).agg(F.count(F.lit(1)).alias("degree"))

    def with_degree(self) -> DataFrame:
        """Nodes with their degree, 0 where there is no edge."""
        joined = self.nodes().join(self.degrees().hint("merge"), NODE, "left")
        return joined.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))

    def unconnected(self) -> DataFrame:
        """Nodes no edge touches."""
        return self.nodes().join(self.ends().select(*NODE).hint("merge"), NODE, "left_anti")

    def dangling_ends(self) -> DataFrame:
        """Ends (as ``ends`` has them) that name no node."""
        return self.ends().join(self.nodes().select(*NODE).hint("merge"), NODE, "left_anti")


def buckets_for(edges: int, least: int = 8) -> int:
    """Buckets, a power of two, for so many edges: they become more, not larger, as a graph grows."""
    return max(least, 1 << max(0, -(-edges // BUCKET_EDGES) - 1).bit_length())


def _write(rows: DataFrame, path: str, table: str, buckets: int) -> None:
    # A task for each bucket: one file each.
    dealt = rows.repartition(buckets, *NODE)
    writer = dealt.write.mode("errorifexists").format("parquet").bucketBy(buckets, *NODE).sortBy(*NODE)
    writer.option("path", path).saveAsTable(table)


def write(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = BUCKETS) -> BucketedGraph:
    """Store a graph in buckets; an existing one is refused."""
    spark = nodes.sparkSession
    graph = BucketedGraph(spark, path, buckets)
    ends = endpoints(edges.withColumn("here", F.struct("src_space", "src")), "type", "ordinal", "here").select(
        *NODE, "type", ((F.col("here.src") == F.col("id")) & (F.col("here.src_space") == F.col("space"))).alias("is_src"),
        F.col("other"), "other_space", "ordinal",
    )
    name = hashlib.md5(f"{path} {buckets}".encode()).hexdigest()
    _write(nodes.select(*schemas.NODES.names), f"{path}/nodes", f"waxgraph_nodes_{name}", buckets)
    _write(ends, f"{path}/ends", f"waxgraph_ends_{name}", buckets)
    return graph
