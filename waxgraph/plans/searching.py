"""Search as a whole: text in, neighbourhoods of the best matches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators import adjacency as adj, expand, search
from waxgraph.sources.search_store import SearchStore


def search_walk(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, adjacency: DataFrame, index: search.Index
) -> DataFrame:
    """Walked edges of every query (query_id, q, limit); ``request_id`` is its id.

    A query with nothing left after cleaning has no rows.
    """
    asked = search.prepare(queries)
    seeded = asked.withColumn("limit", X.seed_count(F.col("limit")))
    ranked = search.rank(seeded, index, nodes, edges)
    return expand.walk(search.seeds_of(ranked, asked), adjacency)


def stored_walk(queries: DataFrame, store: SearchStore) -> DataFrame:
    """The same from a stored index and adjacency."""
    asked = search.prepare(queries)
    ranked = store.rank(asked.withColumn("limit", X.seed_count(F.col("limit"))))
    return expand.walk(search.seeds_of(ranked, asked), store.read("adjacency").drop("bucket"))


def suggest(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, index: search.Index
) -> DataFrame:
    return search.suggestions(search.rank(search.prepare(queries), index, nodes, edges))


def write_search_tables(nodes: DataFrame, edges: DataFrame, out: str, cap: int = fixed.LIMIT_MAX) -> None:
    """Everything a batch of requests needs, written once next to the graph."""
    adj.adjacency(edges, cap).write.mode("errorifexists").parquet(f"{out}/adjacency")
    docs = search.documents(nodes)
    docs.write.mode("errorifexists").parquet(f"{out}/documents")
    search.build_index(docs).texts.write.mode("errorifexists").parquet(f"{out}/texts")


def read_search_tables(spark, out: str) -> tuple[DataFrame, search.Index]:
    index = search.Index(
        spark.read.parquet(f"{out}/documents"), spark.read.parquet(f"{out}/texts")
    )
    return spark.read.parquet(f"{out}/adjacency"), index
