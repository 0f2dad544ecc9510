"""Bring the alias edges of a newer dump into a graph that exists already."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waxgraph import schemas
from waxgraph.operators import aliases, flatten
from waxgraph.session import settle
from waxgraph.sources import search_store
from waxgraph.sources.search_store import SearchStore


def alias_update(
    artists: DataFrame, nodes: DataFrame, edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(new edges, statistics) from accepted artist records.

    New are the pairs with a node at both ends that the graph does not hold yet,
    so running it again on its own result adds nothing.
    """
    entries = flatten.alias_entries(artists)
    pairs = aliases.pairs(entries, F.struct("place", "item_no"))
    resolved = aliases.resolve(pairs, nodes)
    fresh = aliases.missing_from(resolved.where("matched"), edges)
    return aliases.alias_edges(fresh), aliases.statistics(entries, resolved)


def apply_alias_update(
    artists: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    edges_path: str,
    dry_run: bool = False,
    store: SearchStore | None = None,
) -> DataFrame:
    """Append the new edges to the edge table and return the statistics.

    Degrees, names and first edges in ``store`` are brought up to date as well. A dry run
    writes nothing.
    """
    fresh, statistics = alias_update(artists, nodes, edges)
    if not dry_run:
        # Stored first: once the edges are appended they are no longer new.
        rows = settle(fresh.select(*schemas.EDGES.names))
        statistics = settle(statistics)
        if store is not None:
            search_store.add(store, nodes, nodes.limit(0), rows)
        rows.write.mode("append").partitionBy("type").parquet(edges_path)
    return statistics
