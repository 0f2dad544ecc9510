import math

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tests.conftest import rows_of
from waxgraph.operators import adjacency as adj, expand, subgraph

SEEDS = {
    "artist": [("entity", "1")],
    "group": [("entity", "103")],
    "label": [("label", "2")],
    "several": [("release", "3"), ("entity", "2"), ("release", "3"), ("label", "1")],
    "alone": [("entity", "9999")],
}


def seeded(spark, limit):
    rows = [(name, no, *key, limit) for name, ids in SEEDS.items() for no, key in enumerate(ids, 1)]
    return spark.createDataFrame(rows, "request_id string, seed_no long, space string, id string, limit int")


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit,cap", [(3, 300), (7, 15), (300, 300), (1, 4)])
def test_two_hops_against_plain_python(spark, seed, limit, cap):
    rows, links = graphs.random_graph(seed)
    rows.append(graphs.node("Artist", 9999, "Nobody's friend"))
    nodes, edges = graphs.frames(spark, rows, links)
    walked = expand.walk(seeded(spark, limit), adj.adjacency(edges)).cache()
    found, linked = {}, {}
    for r in expand.result_nodes(walked, nodes, cap).collect():
        space = {"Artist": "entity", "Group": "entity", "Release": "release", "Label": "label"}[r.kind]
        found.setdefault(r.request_id, []).append((r.position, ((space, r.id), r.degree, r.expanded)))
    for r in expand.result_edges(walked, cap).collect():
        linked.setdefault(r.request_id, []).append((r.type, r.src_space, r.src, r.dst_space, r.dst, r.ordinal))
    for name, ids in SEEDS.items():
        want_nodes, want_edges = graphs.two_hops(links, ids, limit, cap)
        assert [entry for _, entry in sorted(found[name])] == want_nodes, name
        assert sorted(linked.get(name, [])) == sorted(want_edges), name


def test_rare_types_never_lose_to_common_ones(spark):
    links = [graphs.edge("CREDITED", 1, release) for release in range(500)]
    links += [graphs.edge("MEMBER_OF", 1, 101), graphs.edge("ALIAS_OF", 1, 2)]
    _, edges = graphs.frames(spark, [graphs.node("Artist", 1)], links)
    near = adj.unfold(adj.adjacency(edges)).where("space = 'entity' AND id = '1'")
    assert near.count() == 300
    assert rows_of(near.where("rk <= 2"), "rk", "type") == [(1, "MEMBER_OF"), (2, "ALIAS_OF")]


def test_hub_rows_are_cut_before_the_shuffle(spark):
    _, edges = graphs.frames(spark, [graphs.node("Artist", 1)], [graphs.edge("CREDITED", 1, 1)])
    plan = adj.adjacency(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_adjacency_of_wanted_nodes_is_the_same_list(spark):
    rows, links = graphs.random_graph(3)
    nodes, edges = graphs.frames(spark, rows, links)
    wanted = nodes.where("kind = 'Label'")
    full = adj.adjacency(edges).where("space = 'label'")
    assert rows_of(adj.adjacency_of(edges, wanted)) == rows_of(full)


def test_degree_counts_parallel_edges_and_a_loop_once(spark):
    links = [
        graphs.edge("CREDITED", 1, 7, 0),
        graphs.edge("CREDITED", 1, 7, 1),
        graphs.edge("ALIAS_OF", 1, 1),
    ]
    nodes, edges = graphs.frames(
        spark, [graphs.node("Artist", 1), graphs.node("Release", 7), graphs.node("Label", 7)], links
    )
    assert rows_of(adj.with_degree(nodes, edges), "kind", "degree") == [("Artist", 3), ("Label", 0), ("Release", 2)]
    assert rows_of(adj.unconnected(nodes, edges), "kind") == [("Label",)]
    # Inside a subgraph a loop has two ends.
    tagged = edges.withColumn("request_id", F.lit(1))
    assert rows_of(expand.subgraph_degrees(tagged), "space", "degree") == [("entity", 4), ("release", 2)]


def test_simple_graph_and_panel(spark):
    links = [
        ("r", 3, *graphs.edge("CREDITED", 1, 7, 0)),
        ("r", 1, *graphs.edge("CREDITED", 1, 7, 1)),
        ("r", 2, *graphs.edge("CREDITED", 2, 7, 0)),
        ("r", 4, *graphs.edge("ALIAS_OF", 1, 1)),
        ("r", 5, *graphs.edge("ALIAS_OF", 1, 2)),
        ("r", 6, *graphs.edge("RELEASED_ON", 7, 7)),
    ]
    schema = "request_id string, arrival long, type string, src_space string, src string, dst_space string, dst string, ordinal long"
    simple = subgraph.simple_edges(spark.createDataFrame(links, schema))
    assert rows_of(simple, "arrival", "type") == [(1, "CREDITED"), (2, "CREDITED"), (5, "ALIAS_OF"), (6, "RELEASED_ON")]
    counts = subgraph.panel_counts(simple)
    assert rows_of(counts, "space", "id", "neighbours", "credited", "alias_of", "released_on") == [
        ("entity", "1", 2, 1, 1, 0),
        ("entity", "2", 2, 1, 1, 0),
        ("label", "7", 1, 0, 0, 1),
        ("release", "7", 3, 2, 0, 1),
    ]
    nodes, _ = graphs.frames(
        spark, [graphs.node("Artist", 1, "Zed"), graphs.node("Artist", 2, "Amy")], [graphs.edge("ALIAS_OF", 1, 2)]
    )
    assert rows_of(subgraph.panel_artists(simple, nodes), "id", "artists") == [("7", "Zed, Amy")]


def test_accumulated_sizes(spark):
    rows, links = graphs.random_graph(4)
    nodes, edges = graphs.frames(spark, rows, links)
    walked = expand.walk(seeded(spark, 4), adj.adjacency(edges))
    landed = expand.result_edges(walked).withColumns(
        {"session": F.lit("s"), "landed": F.struct("request_id", "arrival")}
    )
    near = {}
    for ids in SEEDS.values():
        for e in graphs.two_hops(links, ids, 4, 300)[1]:
            if (e[1], e[2]) != (e[3], e[4]):
                near.setdefault((e[1], e[2]), set()).add((e[3], e[4]))
                near.setdefault((e[3], e[4]), set()).add((e[1], e[2]))
    want = sorted(
        (*key, len(others), round(min(26, 4 + math.log2(len(others) + 1) * 19.8 / math.log2(11)), 6))
        for key, others in near.items()
    )
    found = subgraph.accumulated(landed, "session", "landed")
    assert sorted(tuple(r) for r in found.select("space", "id", "degree", "size").collect()) == want


def test_expand_as_one_call(spark):
    rows, links = graphs.random_graph(5)
    nodes, edges = graphs.frames(spark, rows, links)
    requests = spark.createDataFrame([(1, "Label", "1", 5), (2, "Group", "101", 5)], "request_id long, kind string, id string, limit int")
    found, linked = expand.expand(requests, nodes, adj.adjacency(edges))
    for number, key in ((1, ("label", "1")), (2, ("entity", "101"))):
        want_nodes, want_edges = graphs.two_hops(links, [key], 5, 300)
        assert found.where(F.col("request_id") == number).count() == len(want_nodes)
        assert linked.where(F.col("request_id") == number).count() == len(want_edges)


def test_a_request_beyond_the_stored_cap_is_an_error_and_beyond_the_limit_is_clamped(spark):
    nodes, edges = graphs.frames(
        spark, [graphs.node("Artist", 1, "A")] + [graphs.node("Release", i, "R") for i in range(1, 401)],
        [graphs.edge("CREDITED", 1, i) for i in range(1, 401)],
    )

    def found(cap, limit):
        request = spark.createDataFrame([(1, "Artist", "1", limit)], "request_id long, kind string, id string, limit int")
        return expand.neighbours(expand.seeds(request), adj.adjacency(edges, cap)).count()

    assert found(50, 40) == 40 and found(50, 50) == 50
    with pytest.raises(Exception, match="more edges than the stored adjacency"):
        found(50, 60)
    assert found(300, 400) == 300 and found(500, 400) == 300 and found(300, None) == 60
