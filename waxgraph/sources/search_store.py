"""What searches and expansions need, stored next to the graph, read in part and kept up to date.

Four tables in buckets (folders) of a hash: ``postings`` by token, ``documents`` by text,
``facts`` and ``adjacency`` by node id; ``totals`` holds the number of documents and words
as rows that add up. A batch of queries reads the buckets its tokens, texts and nodes
fall into. An update rewrites the buckets it touches and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waxgraph import fixed
from waxgraph.operators import adjacency as adj, search, text_blocks as tb
from waxgraph.operators.adjacency import NODE
from waxgraph.operators.latest import top_per
from waxgraph.session import settle

BUCKETS = 64
# What a store can hold: postings, documents and totals; facts of nodes; first edges of nodes.
PARTS = ("search", "facts", "adjacency")
_KEY = "struct<rank:int,num:bigint,id:string>"
_FIRST = "struct<kind:string,space:string,id:string,id_num:bigint>"
# A graph without nodes leaves no file to read a schema from.
SCHEMAS = {
    "postings": "token string, tf int, length int, df bigint, texts bigint, "
    f"entries array<struct<text:string,documents:bigint,doc_key:{_KEY},first:{_FIRST}>>, bucket int",
    "documents": f"text string, kind string, space string, id string, id_num bigint, doc_key {_KEY}, bucket int",
    "facts": "id string, space string, title string, year string, profile string, artists array<string>, "
    "labels array<string>, degree bigint, bucket int",
    "adjacency": "id string, space string, rk int, rank int, forward boolean, ordinal bigint, other string, cap int, bucket int",
    "totals": "documents bigint, words bigint",
}


@dataclass(frozen=True)
class SearchStore:
    """An index under ``path``."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    parts: tuple[str, ...] = PARTS

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def totals(self) -> tuple[int, float]:
        """Number of documents and their mean length in tokens."""
        row = self.read("totals").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
        documents = row["documents"] or 0
        return documents, (row["words"] / documents if documents else 1.0)

    def part(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows of the buckets that the keys fall into: no other folder is listed or read."""
        wanted = keys.select(tb.bucket_of(F.col(key), self.buckets).alias("bucket")).distinct().collect()
        return self.read(name).where(F.col("bucket").isin(*sorted(row["bucket"] for row in wanted)))

    def pool(self, queries: DataFrame, size: int = fixed.POOL) -> DataFrame:
        """(query_id, kind, space, id, id_num, score): the best ``size`` nodes per query.

        The same rows as ``search.pool``; only texts that several nodes share are looked
        up for their other nodes.
        """
        total, mean = self.totals()
        asked = settle(tb.asked_tokens(queries))
        found = self.part("postings", asked, "token")
        best = settle(tb.best_texts(asked, found, total, mean, size))
        alone = best.where("documents = 1").select("query_id", "first.*", "score", "doc_key")
        shared = settle(best.where("documents > 1").select("query_id", "text", "score"))
        members = self.part("documents", shared, "text").join(shared.select("text").distinct(), "text", "left_semi")
        members = top_per(members, ["text"], [F.col("doc_key").asc()], size).drop("rk", "bucket")
        every = alone.unionByName(shared.join(members, "text").drop("text"))
        order = [F.col("score").desc(), F.col("doc_key").asc()]
        return top_per(every, ["query_id"], order, size).select("query_id", "kind", *NODE, "id_num", "score")

    def rank(self, queries: DataFrame, pool_size: int = fixed.POOL, worth: float = fixed.NEIGHBOUR_BOOST) -> DataFrame:
        """The rows of ``search.rank``, without a look at nodes or edges."""
        candidates = settle(self.pool(queries, pool_size))
        known = self.part("facts", candidates, "id").drop("bucket")
        return search.rank_pool(queries, candidates, known, worth)


def _put(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One table in buckets; large buckets become several files, small ones share tasks."""
    dealt = rows.hint("rebalance", "bucket")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _with_bucket(rows: DataFrame, key: str | Column, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", tb.bucket_of(F.col(key) if isinstance(key, str) else key, buckets))


def _documents(nodes: DataFrame) -> DataFrame:
    return search.documents(nodes).select("text", *tb.FIRST, "doc_key")


def _totals(documents: DataFrame, sign: int = 1) -> DataFrame:
    words = F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))
    return documents.agg((F.count(F.lit(1)) * sign).alias("documents"), (words * sign).cast("bigint").alias("words"))


def write(
    nodes: DataFrame, edges: DataFrame, path: str, buckets: int = BUCKETS, cap: int | None = fixed.LIMIT_MAX,
    parts: tuple[str, ...] = PARTS,
) -> SearchStore:
    """Store the index of a graph, or the ``parts`` of it that will be asked; an existing one is refused.

    Without ``cap`` there is no adjacency.
    """
    parts = tuple(part for part in parts if part != "adjacency" or cap is not None)
    if "search" in parts:
        documents = settle(_documents(nodes))
        texts = settle(tb.texts_of(documents))
        _put(tb.blocks(tb.spread(texts), buckets), f"{path}/postings")
        _put(_with_bucket(documents, "text", buckets), f"{path}/documents")
        _totals(documents).write.mode("errorifexists").parquet(f"{path}/totals")
    if "facts" in parts:
        _put(_with_bucket(search.facts(nodes, edges), "id", buckets), f"{path}/facts")
    if "adjacency" in parts:
        _put(_with_bucket(adj.adjacency(edges, cap), "id", buckets), f"{path}/adjacency")
    return SearchStore(nodes.sparkSession, path, buckets, parts)


# ---------------------------------------------------------------- updates


def _replace(store: SearchStore, name: str, rows: DataFrame) -> None:
    """New contents of the buckets that ``rows`` has; the others stay as they are."""
    # Spark does not write a table it reads from, so the rows are put down first.
    _put(settle(rows.select(*store.read(name).columns)), f"{store.path}/{name}", "overwrite")


def _merged_postings(store: SearchStore, old: DataFrame, added: DataFrame) -> DataFrame:
    """Touched buckets: entries of the added texts are replaced, and tokens that have one get new blocks."""
    touched = old.join(added.select("token").distinct(), "token", "left_semi")
    kept = old.join(added.select("token").distinct(), "token", "left_anti")
    fresh = added.select("token", F.col("entry.text").alias("text"))
    stay = tb.entries_of(touched).withColumn("text", F.col("entry.text")).join(fresh, ["token", "text"], "left_anti")
    again = settle(stay.select(*added.columns).unionByName(added))
    return kept.unionByName(tb.blocks(again, store.buckets))


def _add_documents(store: SearchStore, nodes: DataFrame) -> None:
    documents = _documents(nodes)
    known = store.part("documents", documents, "text").select(*documents.columns)
    fresh = settle(documents.join(known.select("text", *NODE), ["text", *NODE], "left_anti").select(*documents.columns))
    if fresh.isEmpty():
        return
    # A text may have been there: it is counted anew with all its nodes.
    texts = fresh.select("text").distinct()
    changed = settle(tb.texts_of(known.join(texts, "text", "left_semi").unionByName(fresh)))
    added = settle(tb.spread(changed))
    _replace(store, "postings", _merged_postings(store, store.part("postings", added, "token"), added))
    _totals(fresh).write.mode("append").parquet(f"{store.path}/totals")
    _put(_with_bucket(fresh, "text", store.buckets), f"{store.path}/documents", "append")


def _first_names(old: str, new: str, most: int) -> Column:
    """The first names in order, of those that were first before and those that are new."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))), 1, most)


def _changed_facts(store: SearchStore, nodes: DataFrame, edges: DataFrame, added_nodes: DataFrame) -> DataFrame:
    """Facts of the buckets touched: degrees go up, new names join the first few."""
    news = search.facts(nodes, edges, adj.endpoints(edges).select(*NODE).unionByName(added_nodes.select(*NODE)).distinct())
    news = settle(news)
    old = store.part("facts", news, "id")
    names = [c for c in old.columns if c not in (*NODE, "bucket")]
    both = old.drop("bucket").join(news.select(*NODE, *(F.col(c).alias(f"new_{c}") for c in names)), NODE, "full")
    merged = both.select(
        *NODE,
        *(F.coalesce(c, f"new_{c}").alias(c) for c in ("title", "year", "profile")),
        _first_names("artists", "new_artists", fixed.NAMES_ARTISTS).alias("artists"),
        _first_names("labels", "new_labels", fixed.NAMES_LABELS).alias("labels"),
        (F.coalesce("degree", F.lit(0)) + F.coalesce("new_degree", F.lit(0))).cast("bigint").alias("degree"),
    )
    return _with_bucket(merged, "id", store.buckets)


def _changed_adjacency(store: SearchStore, edges: DataFrame) -> DataFrame:
    """Lists of the buckets touched: the first edges of what was first before and what is new."""
    ends = settle(adj.endpoints(edges).select(*NODE).distinct())
    old = store.part("adjacency", ends, "id")
    cap = store.read("adjacency").agg(F.max("cap")).first()[0] or fixed.LIMIT_MAX
    return _with_bucket(adj.merge_adjacency(old.drop("bucket"), edges, cap), "id", store.buckets)


def add(store: SearchStore, nodes: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> None:
    """Bring nodes and edges that the graph has got into the store.

    ``nodes`` are all nodes, the new ones among them: names at the other ends of new
    edges are looked up there. The result is the store of the whole graph written anew:
    the first few of a node's names or edges are among those that were first before and
    the new ones, degrees and counts add up. Parts that the store was made without stay
    out. Nodes and edges that are in the store must
    not be given again. Where it fails half way, the store has to be written anew.
    """
    new_edges, new_nodes = settle(new_edges), settle(new_nodes)
    if "facts" in store.parts:
        _replace(store, "facts", _changed_facts(store, nodes, new_edges, new_nodes))
    if "adjacency" in store.parts:
        _replace(store, "adjacency", _changed_adjacency(store, new_edges))
    if "search" in store.parts:
        _add_documents(store, new_nodes)
