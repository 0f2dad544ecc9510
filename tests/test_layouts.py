"""Bitmaps of ids, nested tags, places of rows, prefix shards, stores by range, footers."""

import os
import random
import re
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tests.conftest import rows_of
from waxgraph.operators import adjacency as adj, integrity, positions, prefix_shards
from waxgraph.session import new_folder
from waxgraph.sources import bucketed_graph, graph_tables, release_store, xml_dumps


@contextmanager
def small_blocks(spark, size):
    """Files are scanned in blocks of so many bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


# --- bitmaps ---------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1 << 18, 2])
def test_bitmap_keeps_what_a_join_keeps(spark, make, monkeypatch, rows):
    monkeypatch.setattr(integrity, "BITMAP_ROWS", rows)
    rnd = random.Random(2)
    wanted = [rnd.randint(-5000, 20000) for _ in range(3000)] + [0, -1, 63, 64, 2047, 2048, 1 << 40, (1 << 62) + 5] * 2
    given = [rnd.randint(-6000, 21000) for _ in range(3000)] + wanted[:500] + [1 << 40, (1 << 40) + 1, (1 << 62) + 5, 2047, 2048, 2049]
    bitmap = integrity.id_bitmap(make([(w,) for w in [*wanted, None]], "id long"))
    frame = make([(str(g), i) for i, g in enumerate(given)] + [("abc", -1), (None, -2)], "_id string, i int")
    frame = frame.withColumns({"bucket": F.lit("x"), "words": F.lit(1)}).select("_id", "i")
    number = F.col("_id").try_cast("bigint")
    kept = [(str(g), i) for i, g in enumerate(given) if g in set(wanted)]
    assert rows_of(integrity.in_bitmap(frame, bitmap, number)) == rows_of(make(kept, "_id string, i int"))
    with_null = rows_of(integrity.in_bitmap(frame, bitmap, number, keep_null=True))
    assert with_null == rows_of(make([*kept, ("abc", -1), (None, -2)], "_id string, i int"))
    assert integrity.in_bitmap(frame, bitmap.limit(0), number).count() == 0


def test_no_text_is_shuffled_for_the_wanted_ids(spark, make):
    texts = make([("<release id=\"1\"><title>x</title></release>", 1)], "content string, place int")
    keyed = release_store.keyed_texts(texts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = release_store.wanted_texts(keyed, make([(1,), (5,)], "id long"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


# --- nested tags -----------------------------------------------------------------------


def outermost(text, tag):
    """The serial way: one pass with a depth."""
    found, depth, start = [], 0, None
    for m in re.finditer(xml_dumps.opening_tag(tag).replace("++", "+").replace("*+", "*") + f"|</{tag}>", text):
        if m[0].startswith("</"):
            depth -= 1
            if depth == 0:
                found.append(text[start : m.end()])
        else:
            if depth == 0:
                start = m.start()
            depth += 1
    return found


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_nested_labels_over_many_blocks_equal_the_serial_parse(spark, tmp_path, block):
    rnd = random.Random(block)

    def label(depth=0):
        inside = "".join(label(depth + 1) for _ in range(rnd.randint(0, 3))) if depth < 3 else ""
        attribute = rnd.choice(["", f' id="{rnd.randint(1, 99)}"', " a='1 > 0' b = \"/\"", "\n x='</' y=\"<b\""])
        empty = rnd.choice(["", "<label/>", "<label a='/>'/>", "<labels2>no</labels2>"])
        return f"<label{attribute}><name>{'n' * rnd.randint(0, 90)}é</name>{empty}{inside}</label>"

    texts = {}
    for name in "abc":
        records = [label() for _ in range(40)]
        texts[name] = "<?xml version='1.0'?>\n<labels>\n" + "\n ".join(records) + "\n</labels>\n"
        (tmp_path / f"{name}.xml").write_text(texts[name], encoding="utf-8")
        assert outermost(texts[name], "label") == records
    with small_blocks(spark, block):
        found = xml_dumps.read_nested_texts(spark, str(tmp_path), "label").orderBy("place").collect()
    assert [r.content for r in found] == [r for name in "abc" for r in outermost(texts[name], "label")]


def test_the_first_label_tells_how_a_dump_is_cut(spark, tmp_path):
    bare = "<labels>\n<label><id>1</id><name>a</name><sublabels><label id='2'>b</label></sublabels></label><label><id>3</id></label></labels>"
    for name, text in (("bare", bare), ("named", bare.replace("<label>", "<label kind='x'>"))):
        (tmp_path / f"{name}.xml").write_text(text)
        found = xml_dumps.read_records_spread(spark, str(tmp_path / f"{name}.xml"), "label", 2)
        assert rows_of(found, "id", "name") == [("1", "a"), ("3", None)]


def test_what_is_open_at_the_end_is_no_whole_record(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<labels><label><name>1</name></label><label a='x'><label>in</label><name>cut")
    found = [r.content for r in xml_dumps.read_nested_texts(spark, str(tmp_path), "label").orderBy("place").collect()]
    assert found[0] == "<label><name>1</name></label>"
    # A second one, if it comes out at all, is malformed and will be set aside.
    assert all("<name>cut</label>" in text for text in found[1:])
    (tmp_path / "a.xml").write_text("<labels>\n</labels>")
    assert xml_dumps.read_nested_texts(spark, str(tmp_path), "label").count() == 0


# --- places ----------------------------------------------------------------------------


def test_places_over_many_files_and_blocks(spark, tmp_path):
    rnd = random.Random(4)
    want, position = [], 0
    for name in ("a", "b", "c", "d"):
        lines = [f"{name}{i} " + "x" * rnd.randint(0, 60) for i in range({"c": 0}.get(name, 200))]
        (tmp_path / f"{name}.txt").write_text("".join(line + "\n" for line in lines))
        for i, line in enumerate(lines):
            want.append((line, f"{name}.txt", i, position))
            position += 1
    with small_blocks(spark, 500):
        scan = spark.read.text(str(tmp_path)).select("value", *(c.alias(n) for n, c in positions.scanned().items()))
        found = positions.numbered(scan).select("value", F.regexp_extract("file", "[^/]+$", 0), "place", "position").collect()
        assert scan.select("block").distinct().count() > 10
    assert sorted(map(tuple, found)) == sorted(want)


# --- prefix shards ---------------------------------------------------------------------


@pytest.mark.parametrize("most,step", [(5, 16), (1, 2), (40, 3), (1000, 16)])
def test_shards_are_bounded_and_every_name_is_found(make, monkeypatch, most, step):
    monkeypatch.setattr(prefix_shards, "STEP", step)
    rnd = random.Random(most)
    names = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5))) for _ in range(300)]
    names += ["Same Name"] * 90 + ["same name x"] * 3 + ["a" * 40, "a" * 41] * 4 + ["", None]
    frame = make([(n, str(i)) for i, n in enumerate(names)], "name string, id string").withColumn("depth", F.lit("x"))
    found = prefix_shards.shards(frame, ["id"], most).collect()
    assert Counter(r.id for r in found) == Counter(str(i) for i, n in enumerate(names) if n)
    assert max(Counter((r.prefix, r.exact, r.part) for r in found).values()) <= most
    counts = Counter()
    for name in filter(None, names):
        counts.update(name.lower()[:d] for d in range(1, len(name) + 1))
    for r in found:
        key = r.name.lower()
        short = next((key[:d] for d in range(1, len(key) + 1) if counts[key[:d]] <= most), None)
        assert (r.prefix, r.exact) == ((short, False) if short else (key, True))
    table = prefix_shards.lookup_table(prefix_shards.shards(frame, ["id"], most))
    asked = sorted({n for n in names if n}) + ["zzz", ""]
    opened = {r.q: r for r in prefix_shards.find(table, make([(q,) for q in asked], "q string")).collect()}
    where = {r.name: (r.prefix, r.exact) for r in found}
    assert {q: (r.prefix, r.exact) for q, r in opened.items()} == where
    parts = Counter(r.name.lower() for r in found)
    assert all(r.parts == -(-parts[q.lower()] // most) for q, r in opened.items() if r.exact)


# --- stores by range, footers ----------------------------------------------------------


def _files(path):
    return {os.path.join(folder, f) for folder, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_update_rewrites_touched_ranges_only(spark, make):
    schema = "id long, content string, pos int"
    old = make([(i, f"old {i}", 0) for i in range(0, 1000, 3)] + [(-7, "old", 0)], schema)
    path = new_folder(spark)
    release_store.write_ranges(old, path, ids=100)
    before = _files(path)
    part = make([(3, "new", 1), (3, "newer", 2), (150, "new", 0), (151, "added", 0), (5000, "far", 0), (-7, "new", 0)], schema)
    assert release_store.update_ranges(path, part, ids=100) == [-1, 0, 1, 50]
    kept = {f for f in before if re.search(r"range=[2-9]/", f)}
    assert kept and kept <= _files(path) and not (before - kept) & _files(path)
    want = {r.id: r.content for r in old.collect()} | {3: "newer", 150: "new", 151: "added", 5000: "far", -7: "new"}
    read = lambda: {r.id: r.content for r in release_store.read_ranges(spark, path).collect()}
    assert read() == want and release_store.read_ranges(spark, path).count() == len(want)
    release_store.update_ranges(path, part, ids=100)
    assert read() == want
    assert release_store.update_ranges(path, part.limit(0), ids=100) == [] and read() == want


def test_counts_come_from_footers(spark):
    nodes, edges = graphs.frames(spark, *graphs.random_graph(5))
    path = new_folder(spark)
    graph_tables.write_graph(nodes, edges, path)
    found = {r.kind: r.n for r in graph_tables.footer_counts(spark, path).collect()}
    assert found == Counter(r.kind for r in nodes.collect()) + Counter(r.type for r in edges.collect())
    before = {k: spark.conf.get(k) for k in graph_tables.FOOTER_SETTINGS}
    for key, value in graph_tables.FOOTER_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        plan = graph_tables._counted(spark, path)._jdf.queryExecution().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plan.count("PushedAggregation: [COUNT(*)]") >= 2 and "PushedGroupBy: [kind]" in plan


# --- buckets ---------------------------------------------------------------------------


def test_joins_of_bucketed_tables_need_no_exchange(spark):
    listed, edges = graphs.random_graph(8)
    listed += [graphs.node("Label", 500 + i, "alone") for i in range(9)]
    edges += [graphs.edge("CREDITED", 1, 9999), graphs.edge("ALIAS_OF", 7777, 7777), graphs.edge("ALIAS_OF", 7777, 1)]
    nodes, edges = graphs.frames(spark, listed, edges)
    path = new_folder(spark)
    graph = bucketed_graph.write(nodes, edges, path, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (graph.with_degree(), graph.unconnected(), graph.dangling_ends()):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows_of(graph.with_degree()) == rows_of(adj.with_degree(nodes, edges).select(*graph.with_degree().columns))
        assert rows_of(graph.unconnected()) == rows_of(adj.unconnected(nodes, edges).select(*graph.unconnected().columns))
        missing = rows_of(graph.dangling_ends().select("space", "id").distinct())
        assert missing == rows_of(integrity.missing_endpoints(edges, nodes), "space", "id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert graph.ends().where("is_src").count() == edges.count() and len(_files(f"{path}/nodes")) <= 4
    # Another session knows nothing of the tables: the layout is stated again.
    other = bucketed_graph.BucketedGraph(spark.newSession(), path, 4)
    spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith('waxgraph_ends')][0]}")
    assert other.degrees().count() == graph.degrees().count()
    with pytest.raises(Exception, match="(?i)exist"):
        bucketed_graph.write(nodes, edges, path, buckets=4)


def test_buckets_and_blocks_follow_the_input():
    from waxgraph.operators import positions
    from waxgraph.sources import bucketed_graph

    assert bucketed_graph.buckets_for(0) == bucketed_graph.buckets_for(4_000_000) == 8
    for edges in (4_000_001, 72_000_000, 432_000_000):
        buckets = bucketed_graph.buckets_for(edges)
        assert bucketed_graph.BUCKET_EDGES // 2 <= edges / buckets <= bucketed_graph.BUCKET_EDGES
    assert positions.block_size(10 << 20, 64 << 10) == 64 << 10
    assert (4 << 30) / positions.block_size(4 << 30, 64 << 10) <= positions.BLOCKS
    assert positions.block_size(1 << 50, 64 << 10) == positions.LARGEST_BLOCK
