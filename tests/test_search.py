import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tests.conftest import rows_of
from waxgraph.operators import expand, refs, search
from waxgraph.plans import searching

QUERIES = "query_id string, q string, limit int"


@pytest.fixture(scope="module")
def golden(spark):
    nodes = [
        graphs.node("Release", 1, "Timeless", year="1995-08-07"),
        graphs.node("Release", 2, "Goldie ", year="1964"),
        graphs.node("Release", 3, "Goldie", year="2012-04-27"),
        graphs.node("Artist", 1, "Goldie", profile="x" * 700),
        graphs.node("Artist", 2, "GOLDIE GOLDIE"),
        graphs.node("Label", 1, "North Road"),
        # Enough other text for the two words to be rare.
        *[graphs.node("Label", 100 + i, f"House number {i}") for i in range(200)],
    ]
    edges = [graphs.edge("CREDITED", 1, 1), graphs.edge("RELEASED_ON", 1, 1)]
    return graphs.frames(spark, nodes, edges)


def index_of(nodes):
    return search.build_index(search.documents(nodes))


def test_golden_case(spark, golden):
    nodes, edges = golden
    queries = spark.createDataFrame([("g", "goldie timeless", 10), ("empty", " +-&& ", 10)], QUERIES)
    found = searching.suggest(queries, nodes, edges, index_of(nodes)).orderBy("position").collect()
    assert {row.query_id for row in found} == {"g"}
    releases = [row.title for row in found if row.kind == "Release"]
    assert releases[0] == "Timeless" and set(releases) == {"Timeless", "Goldie", "Goldie "}
    assert found[0].subtitle == "Goldie · North Road · 1995-08-07"
    artist = next(row for row in found if row.kind == "Artist" and row.id == "1")
    assert artist.subtitle == artist.profile == "x" * 200


def test_without_the_boost_the_release_is_not_first(spark, golden):
    nodes, edges = golden
    asked = search.prepare(spark.createDataFrame([("g", "goldie timeless", 10)], QUERIES))
    plain = search.rank(asked, index_of(nodes), nodes, edges, worth=0.0).collect()
    boosted = search.rank(asked, index_of(nodes), nodes, edges).collect()
    score = {r.id: r.score for r in plain if r.kind == "Release"}
    more = {r.id: r.score for r in boosted if r.kind == "Release"}
    assert more["1"] == pytest.approx(score["1"] + 6.0, abs=1e-6)
    assert more["2"] == score["2"] and more["3"] == score["3"]


def test_boost_needs_the_term_missing_here_and_present_there(spark):
    schema = "terms array<string>, own string, names array<string>"
    rows = [
        (["goldie", "timeless"], "timeless", ["Goldie"]),
        (["goldie"], "goldie", ["Goldie"]),
        (["old"], "timeless", ["Goldie"]),
        (["x", "x"], "own", ["XX"]),
        (["x"], "own", []),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(search.boost(*[F.col(c) for c in df.columns])).collect()] == [6, 0, 6, 12, 0]


def test_pool_against_plain_python(spark):
    """Titles drawn from few words, so many nodes share a text and scores tie."""
    rnd = random.Random(11)
    words = ["red", "blue", "rod", "nut", "Rød", "red-blue"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(400)]
    kinds = ["Artist", "Label", "Release"]
    nodes, _ = graphs.frames(
        spark, [graphs.node(kinds[i % 3], i, t) for i, t in texts], [graphs.edge("ALIAS_OF", 1, 1)]
    )
    asked = ["red", "blue rod rod", "rød nut", "nothing", "red red blue"]
    queries = spark.createDataFrame([(q, q, 10) for q in asked], QUERIES)

    docs = {(kinds[i % 3], i): re.findall(r"\w+", t.lower()) for i, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(token for tokens in docs.values() for token in set(tokens))
    for size in (7, 60, 500):
        want = set()
        for q in asked:
            scores = {}
            for key, tokens in docs.items():
                hits = [t for t in q.split() if t in tokens]
                if hits:
                    scores[key] = round(sum(
                        math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                        * tokens.count(t) * 2.2
                        / (tokens.count(t) + 1.2 * (0.25 + 0.75 * len(tokens) / mean))
                        for t in hits
                    ), 6)
            best = sorted(scores, key=lambda k: (-scores[k], k))[:size]
            want |= {(q, kind, str(id_), scores[kind, id_]) for kind, id_ in best}
        found = search.pool(search.prepare(queries), index_of(nodes), size)
        assert {tuple(r) for r in found.select("query_id", "kind", "id", "score").collect()} == want


def test_degree_breaks_ties(spark):
    nodes = [graphs.node("Artist", i, "Same Name") for i in (1, 2, 3)]
    edges = [graphs.edge("CREDITED", 3, 7), graphs.edge("CREDITED", 2, 7), graphs.edge("CREDITED", 3, 8)]
    nodes, edges = graphs.frames(spark, nodes, edges)
    asked = search.prepare(spark.createDataFrame([("q", "same", 2)], QUERIES))
    ranked = search.rank(asked, index_of(nodes), nodes, edges)
    assert rows_of(ranked, "position", "id", "degree") == [(1, "3", 2), (2, "2", 1)]


def test_names_are_few_sorted_and_never_multiplied(spark):
    nodes = [graphs.node("Release", 1, "R"), graphs.node("Release", 2, "S")]
    nodes += [graphs.node("Artist", i, f"A{i}") for i in range(9)] + [graphs.node("Artist", 99)]
    nodes += [graphs.node("Label", i, f"L{i}") for i in range(5)]
    edges = [graphs.edge("CREDITED", i, 1, o) for i in (8, 2, 5, 7, 99) for o in (0, 1)]
    edges += [graphs.edge("RELEASED_ON", 1, i) for i in (4, 0, 3)]
    nodes, edges = graphs.frames(spark, nodes, edges)
    tied = search.tied_names(nodes.where("kind = 'Release'"), nodes, edges)
    assert rows_of(tied, "id", "artists", "labels") == [("1", ["A2", "A5", "A7"], ["L0", "L3"]), ("2", [], [])]


def test_search_walk_uses_a_quarter_of_the_limit_as_seeds(spark, golden, tmp_path):
    nodes, edges = golden
    searching.write_search_tables(nodes, edges, str(tmp_path))
    adjacency, index = searching.read_search_tables(spark, str(tmp_path))
    queries = spark.createDataFrame([("one", "goldie timeless", 4), ("two", "goldie", 8)], QUERIES)
    walked = searching.search_walk(queries, nodes, edges, adjacency, index)
    found = expand.result_nodes(walked, nodes)
    one = rows_of(found.where("request_id = 'one'"), "position", "kind", "id", "expanded")
    # The release, its label and its artist.
    assert one == [(1, "Release", "1", True), (2, "Label", "1", True), (3, "Artist", "1", True)]
    assert found.where("request_id = 'two'").where("position <= 2").count() == 2


def test_wider_text_finds_the_release_by_both_words(spark, golden):
    nodes, edges = golden
    asked = search.prepare(spark.createDataFrame([("g", "goldie timeless", 10)], QUERIES))
    wide = search.widened_documents(nodes, edges)
    best = search.widened_pool(asked, wide).where("position = 1").first()
    assert (best.kind, best.id) == ("Release", "1")


PROFILE = "[a371918] [l=Optimal Media GmbH] [A=Foo] [r=12] [m99] [at] [aged 79] [b]x[/b] [a=] [l=two\nlines] [r=a[b]]"


def test_profile_refs(spark):
    nodes, _ = graphs.frames(
        spark, [graphs.node("Artist", 1, "x", profile=PROFILE), graphs.node("Artist", 2, "y")], [graphs.edge("ALIAS_OF", 1, 2)]
    )
    found = refs.profile_refs(nodes)
    assert rows_of(found, "no", "letter", "form", "ref") == [
        (0, "a", "id", "371918"),
        (1, "l", "text", "Optimal Media GmbH"),
        (2, "a", "text", "Foo"),
        (3, "r", "text", "12"),
        (4, "m", "id", "99"),
    ]
    assert rows_of(refs.usage(found)) == [("a", "id", 1), ("a", "text", 1), ("l", "text", 1), ("m", "id", 1), ("r", "text", 1)]
    links = found.select(refs.ref_link("https://site", F.col("letter"), F.col("ref")))
    assert [r[0] for r in links.collect()] == [
        "https://site/artist/371918", None, None, "https://site/release/12", "https://site/master/99",
    ]


def test_resolution(spark):
    nodes = [
        graphs.node("Artist", 5, "Twice"),
        graphs.node("Group", 4, "Twice"),
        graphs.node("Group", 6, "Band", profile="[a=twice] [a5] [a6] [a7] [l=No Road] [l6] [r=12] [m5] [a=Nothing Alike] [l=north road]"),
        graphs.node("Label", 6, "North Road"),
        graphs.node("Release", 12, "Title"),
    ]
    nodes, edges = graphs.frames(spark, nodes, [graphs.edge("CREDITED", 5, 12)])
    found = refs.profile_refs(nodes)
    resolved = refs.resolve(found, nodes, edges, index_of(nodes))
    assert rows_of(resolved, "letter", "ref", "method", "target_kind", "target_id") == [
        ("a", "5", "id", "Artist", "5"),
        ("a", "6", "id", "Group", "6"),
        ("a", "7", None, None, None),
        ("a", "Nothing Alike", None, None, None),
        ("a", "twice", "name", "Artist", "5"),
        ("l", "6", "id", "Label", "6"),
        ("l", "No Road", "rank", "Label", "6"),
        ("l", "north road", "name", "Label", "6"),
        ("r", "12", "id", "Release", "12"),
    ]
    mentions = refs.mentions(found, resolved)
    assert rows_of(mentions, "id", "target_kind", "target_id", "times") == [
        ("6", "Artist", "5", 2), ("6", "Group", "6", 1), ("6", "Label", "6", 3), ("6", "Release", "12", 1),
    ]


def test_rank_only_helps_within_the_best_five(spark):
    """Five better matches of another kind hide the label."""
    nodes = [graphs.node("Artist", i, "North Road") for i in range(5)] + [graphs.node("Label", 9, "North Road Records House")]
    nodes, edges = graphs.frames(spark, nodes, [graphs.edge("ALIAS_OF", 1, 2)])
    asked = spark.createDataFrame([("l", "North Road Store"), ("a", "North Road Store")], "letter string, ref string")
    resolved = refs.resolve(asked, nodes, edges, index_of(nodes))
    assert rows_of(resolved, "letter", "method") == [("a", "rank"), ("l", None)]


def test_rows_scored_do_not_grow_with_a_common_token(spark, make):
    def scored(common):
        texts = [f"rare{i % 3} word{i}" for i in range(90)] + [f"common {i} filler{i}" for i in range(common)]
        texts = [f"{t} common" if t.startswith("rare") else t for t in texts]
        nodes = make([("entity", "Artist", str(i), i, None, t) for i, t in enumerate(texts)],
                     "space string, kind string, id string, id_num long, title string, name string")
        index = search.build_index(search.documents(nodes))
        queries = search.prepare(make([(1, "rare0 rare1 rare2 common")], "query_id long, q string"))
        found = search.text_scores(queries, index)
        return found.count(), sorted((r.text, r.score) for r in found.orderBy(F.desc("score"), "doc_key").limit(60).collect())[:3]

    few, many = scored(300)[0], scored(3000)[0]
    assert few == many == 90
