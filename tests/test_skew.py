"""One key with a third of all rows: same results, and no task that takes them all."""

import contextlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from waxgraph import fixed
from waxgraph.operators import adjacency as adj, aliases, expand, flatten, integrity, labels, refs, search
from waxgraph.operators.latest import top_per
from waxgraph.session import settle

ROWS = 90_000


@contextlib.contextmanager
def settings(spark, **values):
    """Small thresholds, so that a small test crosses them."""
    keys = {name.replace("__", "."): str(value) for name, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_thresholds(spark):
    return settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__autoBroadcastJoinThreshold=-1,
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor=1.5,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        # Many small tasks: a hot partition is split between the tasks that wrote it.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="10KB",
        spark__sql__shuffle__partitions=16,
    )


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hub_edges(spark):
    """Artist 0 is on a third of all credits; release 0 on another third."""
    i = F.col("id")
    src = F.when(i % 3 == 0, 0).otherwise(i % 997 + 1)
    dst = F.when(i % 3 == 1, 0).otherwise(i % 1009 + 1)
    base = spark.range(0, ROWS, numPartitions=8)
    return base.select(
        F.lit("CREDITED").alias("type"),
        F.lit("entity").alias("src_space"),
        src.cast("string").alias("src"),
        F.lit("release").alias("dst_space"),
        dst.cast("string").alias("dst"),
        i.alias("ordinal"),
    )


def hub_nodes(spark, hole):
    people = spark.range(998).select(F.lit("entity").alias("space"), F.col("id").cast("string").alias("id"))
    records = spark.range(1010).select(F.lit("release").alias("space"), F.col("id").cast("string").alias("id"))
    return people.unionByName(records).where(f"NOT (space = 'entity' AND id = '{hole}')")


def test_a_skewed_join_is_split(spark, hub_edges):
    with small_thresholds(spark):
        bad = integrity.dangling_edges(hub_edges, hub_nodes(spark, 0))
        plan = final_plan(bad)
        assert "skew=true" in plan
        assert bad.count() == ROWS // 3
        assert integrity.good_edges(hub_edges, hub_nodes(spark, 0)).count() == ROWS - ROWS // 3


def test_repeats_of_a_hot_key_are_complete(spark):
    with small_thresholds(spark):
        rows = spark.range(0, ROWS, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 20_000).alias("key"),
            F.col("id").alias("pos"),
        )
        found = integrity.repeat_positions(rows, ["key"], "pos")
        assert found.where("key = -1").count() == ROWS // 3 - 1
        assert found.count() == ROWS - rows.select("key").distinct().count()


def test_a_hub_ships_no_more_than_the_cap_per_task(spark, hub_edges):
    near = adj.adjacency(hub_edges).where("id = '0'")
    assert near.groupBy("space").count().orderBy("space").collect() == [("entity", 300), ("release", 300)]
    want = [r.ordinal for r in hub_edges.where("src = '0'").orderBy(F.col("dst").cast("long"), "ordinal").limit(300).collect()]
    got = [r.ordinal for r in near.where("space = 'entity'").orderBy("rk").collect()]
    assert got == want
    shuffled = shuffled_rows(spark, adj.adjacency(hub_edges))
    # Eight map tasks with two hubs each, and everything that is no hub.
    assert shuffled <= 2 * 8 * fixed.LIMIT_MAX + 2 * ROWS - 2 * (ROWS // 3)


def shuffled_rows(spark, df):
    """Rows written by the first exchange of a plan."""
    with settings(spark, spark__sql__adaptive__enabled="false"):
        plan = df._jdf.queryExecution()
        physical = spark._jsparkSession.sessionState().executePlan(
            df._jdf.queryExecution().analyzed(), plan.mode()
        ).executedPlan()
        list(map(str, [physical.execute().count()]))
        node = physical
        while node.nodeName() != "Exchange":
            node = node.children().apply(0)
        return node.metrics().apply("shuffleRecordsWritten").value()


def test_repeats_are_spread_by_position(spark):
    rows = spark.range(100).select((F.col("id") * 0).alias("key"), F.col("id").alias("pos"))
    with small_thresholds(spark):
        plan = final_plan(integrity.repeat_positions(rows, ["key"], "pos"))
    assert "hashpartitioning(pos" in plan


def test_the_join_with_hot_postings_is_split(spark, monkeypatch):
    """A word on every third title, asked for among many others."""
    i = F.col("id")
    texts = spark.range(0, ROWS, numPartitions=8).select(
        F.concat_ws(" ", F.when(i % 3 == 0, "hot"), F.concat(F.lit("w"), i.cast("string"))).alias("text")
    )
    texts = texts.select("text", F.size(F.split("text", " ")).alias("length"), F.lit(1).cast("long").alias("documents"), F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("num"), F.lit("").alias("id")).alias("doc_key"))
    index = search.Index(texts, texts)
    asked = [("h", "hot"), *((f"q{n}", f"w{n}") for n in range(500))]
    queries = spark.createDataFrame(asked, "query_id string, term string")
    plans, settle = [], search.settle

    def watched(df):
        plans.append(final_plan(df))
        return settle(df)

    monkeypatch.setattr(search, "settle", watched)
    with small_thresholds(spark):
        scores = search.text_scores(queries, index)
        assert any("skew=true" in plan for plan in plans)
        assert scores.where("query_id = 'h'").count() == ROWS // 3


def test_a_hub_in_every_request_is_split(spark):
    """Every artist is credited on release 0, so all frontiers meet there."""
    i = F.col("id")
    base = spark.range(1, ROWS // 3, numPartitions=8)
    edges = base.select(*flatten.edge_row("CREDITED", i.cast("string"), F.lit("0"), i))
    near = settle(adj.adjacency(edges))
    requests = base.select(i.alias("request_id"), F.lit("Artist").alias("kind"), i.cast("string").alias("id"), F.lit(2).alias("limit"))
    with small_thresholds(spark):
        walked = expand.walk(expand.seeds(requests), near)
        assert "skew=true" in final_plan(walked)
    # The artist, the release, and the release's own first two credits.
    nodes = expand.merged_nodes(walked).groupBy("request_id").count()
    assert nodes.where("request_id > 2").where("count <> 4").count() == 0
    assert nodes.where("request_id <= 2").where("count <> 3").count() == 0
    assert nodes.count() == ROWS // 3 - 1


def test_degrees_collapse_before_the_shuffle(spark, hub_edges):
    assert shuffled_rows(spark, adj.degrees(hub_edges)) <= 8 * (998 + 1010)
    degree = {r.id: r.degree for r in adj.degrees(hub_edges).where("space = 'entity'").collect()}
    assert degree["0"] == ROWS // 3


def test_label_with_a_third_of_all_sightings(spark):
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit("7")).otherwise((i % 5000 + 10).cast("string"))
    seen = spark.range(0, ROWS, numPartitions=8).select(
        *labels.sighting(labels.FROM_RELEASES, key, i.cast("string"), None, i, F.lit(0))
    )
    merged = labels.merge(seen)
    assert merged.where("id = '7'").first().name == str(ROWS - 3)
    assert shuffled_rows(spark, merged) <= 8 * 5001


def test_one_title_on_a_third_of_all_nodes(spark):
    """Every node of the title is a candidate; the pool takes the first ones, whole."""
    i = F.col("id")
    nodes = spark.range(0, ROWS, numPartitions=8).select(
        F.lit("release").alias("space"),
        F.lit("Release").alias("kind"),
        i.cast("string").alias("id"),
        i.alias("id_num"),
        F.when(i % 3 == 2, F.lit("Untitled Live")).otherwise(F.concat(F.lit("No "), i.cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("name"),
    )
    index = search.build_index(search.documents(nodes))
    asked = search.prepare(spark.createDataFrame([("u", "untitled", 60)], "query_id string, q string, limit int"))
    found = search.pool(asked, index)
    assert sorted(r.id_num for r in found.collect()) == [2 + 3 * n for n in range(60)]
    # The text is scored once, not once per node.
    assert search.text_scores(asked, index).count() == 1


def test_a_release_credited_by_everybody_gets_three_names(spark, hub_edges):
    named = spark.range(998).select(
        F.lit("entity").alias("space"), F.col("id").cast("string").alias("id"), F.format_string("N%04d", F.col("id")).alias("name")
    )
    wanted = spark.createDataFrame([("release", "0")], "space string, id string")
    tied = search.tied_names(wanted, named, hub_edges)
    credited = hub_edges.where("dst = '0'").select(F.col("src").cast("long")).distinct().orderBy("src").limit(3)
    assert rows_of(tied, "artists") == [([f"N{r[0]:04d}" for r in credited.collect()],)]


def test_one_reference_in_every_profile(spark):
    found = spark.range(0, 30_000, numPartitions=8).select(
        F.lit("Artist").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("l").alias("letter"), F.lit("Big House").alias("ref")
    )
    resolved = spark.createDataFrame(
        [("l", "Big House", "name", "Label", "1")], "letter string, ref string, method string, target_kind string, target_id string"
    )
    with small_thresholds(spark):
        mentions = refs.mentions(found, resolved)
        assert mentions.count() == 30_000
        assert mentions.agg(F.sum("times")).first()[0] == 30_000


def test_alias_of_everybody(spark):
    i = F.col("id")
    entries = spark.range(1, ROWS, numPartitions=8).select(
        i.cast("string").alias("self"), F.when(i % 3 == 0, F.lit("1")).otherwise((i + 1).cast("string")).alias("alias"), i.alias("seq")
    )
    pairs = aliases.pairs(entries, F.col("seq"))
    # 1 is declared by every third, and once by its own entry (1, 2).
    assert pairs.where("a = '1'").count() == ROWS // 3 - 1 + 1
    assert pairs.where("CAST(a AS LONG) > CAST(b AS LONG)").count() == 0


def test_top_per_of_one_group_only(spark):
    rows = spark.range(0, ROWS, numPartitions=8).withColumn("key", F.when(F.col("id") >= 0, 1).otherwise(2))
    best = top_per(rows, ["key"], [F.col("id").desc()], 5)
    assert [r.id for r in best.orderBy("rk").collect()] == list(range(ROWS - 1, ROWS - 6, -1))
    assert shuffled_rows(spark, best) <= 8 * 5
