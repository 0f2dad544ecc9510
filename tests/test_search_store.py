"""The stored index: the same rows as without, little of it read, updates equal to a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tests.conftest import rows_of
from waxgraph.operators import adjacency as adj, search, text_blocks as tb
from waxgraph.plans import searching
from waxgraph.sources import search_store
from waxgraph.session import new_folder

QUERIES = "query_id string, q string, limit int"
WORDS = ["red", "blue", "rod", "nut", "Rød", "red-blue", "of the", "the"]


def _graph(spark, seed=3, texts=300):
    """Few words, so many nodes share a text and scores tie; edges of all types."""
    rnd = random.Random(seed)
    nodes, edges = graphs.random_graph(seed)
    kinds = ["Artist", "Label", "Release"]
    nodes += [
        graphs.node(kinds[i % 3], 1000 + i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 5))), profile="p" * (i % 3), year=None)
        for i in range(texts)
    ]
    edges += [graphs.edge("CREDITED", 1, 1000 + 3 * i + 2) for i in range(20)]
    return graphs.frames(spark, nodes, edges)


def _asked(spark):
    texts = ["red", "the", "of the", "the red blue rod", "blue rod rod", "rød nut", "nothing", "red red blue", "artist 1", "+-", "the the nut"]
    return search.prepare(spark.createDataFrame([(q, q, 12) for q in texts], QUERIES))


@pytest.mark.parametrize("block,size", [(128, 60), (4, 7), (2, 500), (1, 3)])
def test_pool_and_rank_are_those_of_the_whole_index(spark, monkeypatch, block, size):
    monkeypatch.setattr(tb.blocks, "__defaults__", (block,))
    nodes, edges = _graph(spark)
    store = search_store.write(nodes, edges, new_folder(spark), buckets=4)
    assert store.read("postings").agg(F.max("texts")).first()[0] <= block
    index = search.build_index(search.documents(nodes))
    columns = ["query_id", "kind", "id", "score"]
    assert rows_of(store.pool(_asked(spark), size), *columns) == rows_of(search.pool(_asked(spark), index, size), *columns)
    if size == 60:
        assert rows_of(store.rank(_asked(spark))) == rows_of(search.rank(_asked(spark), index, nodes, edges))


def test_blocks_below_the_bar_are_not_opened(spark, monkeypatch):
    """A rare word decides, so the long list of the common one stays shut."""
    nodes = [graphs.node("Label", i, "the " + ("gem " if i < 30 else "") + "x " * (i % 9)) for i in range(3000)]
    nodes, edges = graphs.frames(spark, nodes, [graphs.edge("SUBLABEL", 1, 2)])
    opened = []
    plain = tb._scored

    def counted(rows, mean):
        opened.append(rows.select(F.sum("texts")).first()[0] or 0)
        return plain(rows, mean)

    monkeypatch.setattr(tb, "_scored", counted)
    monkeypatch.setattr(tb.blocks, "__defaults__", (8,))
    # Distinct texts, so that there are as many postings.
    nodes = nodes.withColumn("name", F.concat("name", F.lit(" n"), "id"))
    store = search_store.write(nodes, edges, new_folder(spark), buckets=4)
    asked = search.prepare(spark.createDataFrame([("q", "the gem", 5)], QUERIES))
    got = rows_of(store.pool(asked, 20), "id", "score")
    assert got == rows_of(search.pool(asked, search.build_index(search.documents(nodes)), 20), "id", "score")
    assert sum(opened) < 150


def test_a_search_reads_the_buckets_of_its_tokens_only(spark):
    nodes, edges = _graph(spark)
    store = search_store.write(nodes, edges, new_folder(spark), buckets=16)
    asked = tb.asked_tokens(search.prepare(spark.createDataFrame([("q", "nut", 5)], QUERIES)))
    part = store.part("postings", asked, "token")
    folders = part.select(F.regexp_extract("_metadata.file_path", "bucket=[0-9]+", 0)).distinct().collect()
    assert len(folders) == 1 and part.where("token = 'nut'").count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan
    # The index has the blocks; no text is taken apart but those opened.
    found = tb.best_texts(asked, part, *store.totals())._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct" not in found and "explode(entries" in found


def test_a_token_on_every_text_is_many_partitions(spark):
    texts = spark.range(20000).select(
        F.concat(F.lit("hot w"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("documents"),
        F.struct(F.lit(0).alias("rank"), F.col("id").alias("num"), F.lit("").alias("id")).alias("doc_key"), F.lit(None).cast("string").alias("first"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = tb.blocks(tb.spread(texts), 8).where("token = 'hot'")
        sizes = [r[0] for r in made.select(F.size("entries")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20000 and max(sizes) <= 128
    assert len({r.text for e in made.collect() for r in e.entries}) == 20000


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_update_equals_rebuild(spark, monkeypatch, seed):
    monkeypatch.setattr(tb.blocks, "__defaults__", (4,))
    rnd = random.Random(seed)
    nodes, edges = _graph(spark, seed, texts=90)
    nodes = nodes.withColumn("late", F.xxhash64("space", "id", F.lit(seed)) % 4 == 0)
    late = {(r.space, r.id) for r in nodes.where("late").collect()}
    rows = [tuple(r) for r in edges.collect()]
    fresh = [e for e in rows if (e[1], e[2]) in late or (e[3], e[4]) in late or rnd.random() < 0.2]
    base = spark.createDataFrame([e for e in rows if e not in set(fresh)], edges.schema)
    whole = nodes.drop("late")
    # A cap that lists really reach: new edges of rare types push others out.
    store = search_store.write(nodes.where("NOT late").drop("late"), base, new_folder(spark), buckets=4, cap=3)
    search_store.add(store, whole, nodes.where("late").drop("late"), spark.createDataFrame(fresh, edges.schema))
    again = search_store.write(whole, edges, new_folder(spark), buckets=4, cap=3)
    for name in ("facts", "adjacency"):
        columns = again.read(name).columns
        assert rows_of(store.read(name), *columns) == rows_of(again.read(name), *columns)
    assert store.totals() == again.totals()
    entries = lambda s: rows_of(tb.entries_of(s.read("postings")).select("token", "tf", "length", "entry.*"))
    assert entries(store) == entries(again)
    assert rows_of(store.rank(_asked(spark))) == rows_of(again.rank(_asked(spark)))


def test_nothing_new_changes_nothing(spark):
    nodes, edges = _graph(spark, texts=20)
    store = search_store.write(nodes, edges, new_folder(spark), buckets=4)
    before = {name: rows_of(store.read(name)) for name in ("facts", "adjacency", "documents", "totals")}
    search_store.add(store, nodes, nodes.limit(0), edges.limit(0))
    assert {name: rows_of(store.read(name)) for name in before} == before


def test_empty_graph_and_second_write(spark):
    nodes, edges = _graph(spark, texts=5)
    path = new_folder(spark)
    store = search_store.write(nodes.limit(0), edges.limit(0), path, buckets=4)
    assert store.rank(_asked(spark)).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        search_store.write(nodes, edges, path)
    search_store.add(store, nodes, nodes, edges)
    again = search_store.write(nodes, edges, new_folder(spark), buckets=4)
    assert rows_of(store.rank(_asked(spark))) == rows_of(again.rank(_asked(spark)))


def test_stored_walk_is_the_walk(spark):
    nodes, edges = _graph(spark, texts=40)
    store = search_store.write(nodes, edges, new_folder(spark), buckets=4)
    queries = spark.createDataFrame([("a", "artist 1", 9), ("b", "red blue", 5), ("c", "!!", 3)], QUERIES)
    index = search.build_index(search.documents(nodes))
    plain = searching.search_walk(queries, nodes, edges, adj.adjacency(edges), index)
    assert rows_of(searching.stored_walk(queries, store), *plain.columns) == rows_of(plain)


def test_a_store_of_some_parts_writes_and_updates_no_others(spark):
    import os

    nodes, edges = _graph(spark, texts=30)
    late = F.coalesce((F.col("type") == "CREDITED") & (F.crc32("dst") % 2 == 0), F.lit(False))
    fresh, early = edges.where(late), edges.where(~late)
    for part, table in (("facts", "facts"), ("adjacency", "adjacency")):
        path = new_folder(spark)
        store = search_store.write(nodes, early, path, buckets=4, parts=(part,))
        search_store.add(store, nodes, nodes.where("false"), fresh)
        assert os.listdir(path) == [table]
        whole = search_store.write(nodes, edges, new_folder(spark), buckets=4)
        keys = ["id", "space", "rk"] if part == "adjacency" else ["id", "space", "degree"]
        assert rows_of(store.read(table), *keys) == rows_of(whole.read(table), *keys)


def test_names_of_every_node_are_those_of_wanted_ones(spark):
    nodes, edges = _graph(spark, texts=30)
    every = search.tied_names(nodes, nodes, edges, every=True)
    assert rows_of(every) == rows_of(search.tied_names(nodes, nodes, edges))
    assert "LeftSemi" not in every._jdf.queryExecution().optimizedPlan().toString()
