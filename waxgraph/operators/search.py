"""Ranked text search over node names, for a batch of queries in one job.

The unit of scoring is a distinct text, not a node: nodes with the same tokens
score the same, so a title shared by a third of all nodes is scored once. The
index is an ordinary table of (token, text) rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators.adjacency import NODE, endpoints
from waxgraph.operators.latest import top_per
from waxgraph.session import settle

SCORE_DIGITS = 6
LAST_NUMBER = (1 << 63) - 1


def doc_key(kind: Column, id_num: Column, id_: Column) -> Column:
    """Ties go by kind, then by number, then by the id itself; ids without a number come last."""
    rank = F.when(kind == "Artist", 0).when(kind == "Group", 1).when(kind == "Label", 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.coalesce(id_num, F.lit(LAST_NUMBER)).alias("num"), id_.alias("id"))


@dataclass(frozen=True)
class Index:
    """Text index of a node table.

    documents: space, kind, id, id_num, doc_key, text
    texts:     text, length, documents, doc_key (smallest)
    """

    documents: DataFrame
    texts: DataFrame

    def postings(self) -> DataFrame:
        """(token, text, tf, length, documents, doc_key), one row per distinct pair."""
        words = F.split("text", " ")
        spread = self.texts.select("*", words.alias("words")).select(
            "*", F.explode(F.array_distinct("words")).alias("token")
        )
        tf = F.size(F.filter("words", lambda word: word == F.col("token")))
        return spread.select("token", "text", tf.alias("tf"), "length", "documents", "doc_key")


def documents(nodes: DataFrame, text: Column | None = None) -> DataFrame:
    """One document per node with at least one token in ``text``."""
    words = X.tokens(X.node_text() if text is None else text)
    listed = nodes.select(
        *NODE,
        "kind",
        "id_num",
        doc_key(F.col("kind"), F.col("id_num"), F.col("id")).alias("doc_key"),
        F.array_join(words, " ").alias("text"),
    )
    return listed.where("text <> ''")


def build_index(docs: DataFrame) -> Index:
    texts = docs.groupBy("text").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_key").alias("doc_key")
    )
    length = F.size(F.split("text", " "))
    return Index(docs, texts.select("text", length.alias("length"), "documents", "doc_key"))


def postings_table(docs: DataFrame) -> DataFrame:
    """(kind, id, token, tf, length): the index by node."""
    words = F.split("text", " ")
    spread = docs.select("kind", "id", words.alias("words"))
    spread = spread.select("*", F.explode(F.array_distinct("words")).alias("token"))
    tf = F.size(F.filter("words", lambda word: word == F.col("token")))
    return spread.select(
        "kind", "id", "token", tf.alias("tf"), F.size("words").alias("length")
    )


def prepare(queries: DataFrame, term_width: int = fixed.TERM_MAX) -> DataFrame:
    """Add the cleaned ``term`` to queries; those with nothing left drop out."""
    cleaned = queries.withColumn("term", X.clean_term(F.col("q"), term_width))
    return cleaned.where("term <> ''")


def _weighted_tokens(queries: DataFrame, counts: DataFrame, total: Column) -> DataFrame:
    """(query_id, token, weight, upper, texts): how often a query holds a token times
    its idf, and what the token can add to a score at the most.

    ``counts`` (token, df, texts, best) was summed up before any shuffle, and the
    result is a few rows per query in a table of its own: postings of a token that is
    on a third of all texts meet it by broadcast, or by a join that can be split.
    """
    asked = queries.select("query_id", F.explode(X.tokens(F.col("term"))).alias("token"))
    asked = asked.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
    idf = F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * idf
    return settle(
        asked.join(counts, "token").select(
            "query_id", "token", weight.alias("weight"), (weight * F.col("best")).alias("upper"), "texts"
        )
    )


def _saturation(mean: Column) -> Column:
    """What a token is worth in a text before it is weighted."""
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("length") / mean)
    return F.col("tf") * (fixed.BM25_K1 + 1) / (F.col("tf") + norm)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    # The document key follows from the others.
    return parts.groupBy("query_id", *keys, "doc_key").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))


def best_scores(
    queries: DataFrame, postings: DataFrame, keys: list[str], whole: Column, df: Column, size: int
) -> DataFrame:
    """(query_id, *keys, score, doc_key): BM25 of everything that can be among the best ``size``.

    ``postings``: token, *keys, tf, length, doc_key; ``whole`` holds total and mean. The
    rarest tokens of a query are scored first; the score of the ``size``-th row found is a
    bar. Tokens that even together stay below it cannot carry a row by themselves: they
    complete the scores of rows that other tokens opened, and their long lists of
    postings are met on (token, row) only. The best ``size`` rows are the same as without.
    """
    mean = whole["mean"]
    counts = postings.groupBy("token").agg(
        df.alias("df"), F.count(F.lit(1)).alias("texts"), F.max(_saturation(mean)).alias("best")
    )
    weighted = _weighted_tokens(queries, counts, whole["total"])

    def opened_by(tokens: DataFrame) -> DataFrame:
        part = (F.col("weight") * _saturation(mean)).alias("part")
        return postings.join(tokens.select("query_id", "token", "weight"), "token").select("query_id", *keys, part, "doc_key")

    # A query is short, so windows over its tokens are too.
    rare_first = Window.partitionBy("query_id").orderBy("texts", "token")
    before = rare_first.rowsBetween(Window.unboundedPreceding, -1)
    onward = rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = weighted.withColumns(
        {
            "rare": F.coalesce(F.sum("texts").over(before), F.lit(0)) < size,
            "onward": F.sum("upper").over(onward),
        }
    )
    first = _summed(opened_by(placed.where("rare")), keys)
    bars = (
        top_per(first, ["query_id"], [F.col("score").desc()], size)
        .where(F.col("rk") == size)
        .select("query_id", F.col("score").alias("bar"))
    )
    # Scores are rounded, so the bar is met with some room.
    opens = F.col("rare") | F.col("bar").isNull() | (F.col("onward") >= F.col("bar") - 10.0 ** (1 - SCORE_DIGITS))
    marked = settle(placed.join(bars, "query_id", "left").select("query_id", "token", "weight", opens.alias("opens")))
    opened = settle(opened_by(marked.where("opens")))
    lacking = opened.select("query_id", *keys).distinct().join(marked.where("NOT opens"), "query_id")
    completed = lacking.join(postings, ["token", *keys]).select(
        "query_id", *keys, (F.col("weight") * _saturation(mean)).alias("part"), "doc_key"
    )
    return _summed(opened.unionByName(completed), keys)


def text_scores(queries: DataFrame, index: Index, size: int = fixed.POOL) -> DataFrame:
    """(query_id, text, score, doc_key): BM25 of the texts that can be among the best ``size``.

    A token repeated in the query counts as often as it stands there.
    """
    words = F.sum(F.col("length") * F.col("documents"))
    whole = F.struct(F.sum("documents").alias("total"), (words / F.sum("documents")).alias("mean"))
    whole = index.texts.agg(whole).scalar()
    return best_scores(queries, index.postings(), ["text"], whole, F.sum("documents"), size)


def pool(queries: DataFrame, index: Index, size: int = fixed.POOL) -> DataFrame:
    """(query_id, kind, space, id, id_num, score): the best ``size`` nodes per query.

    A text outside the best ``size`` texts, ordered by score and then by their
    first node, cannot hold a node of the pool, and neither can a node outside
    the first ``size`` of its text. Both cuts are therefore exact.
    """
    best = top_per(
        text_scores(queries, index, size),
        ["query_id"],
        [F.col("score").desc(), F.col("doc_key").asc()],
        size,
    )
    best = settle(best.select("query_id", "text", "score"))
    members = index.documents.join(best.select("text"), "text", "left_semi")
    members = top_per(members, ["text"], [F.col("doc_key").asc()], size).drop("rk")
    order = [F.col("score").desc(), F.col("doc_key").asc()]
    return top_per(best.join(members, "text"), ["query_id"], order, size).select(
        "query_id", "kind", *NODE, "id_num", "score"
    )


def neighbour_names(
    wanted: DataFrame | None, nodes: DataFrame, edges: DataFrame, edge_type: str, near: str, far: str, most: int
) -> DataFrame:
    """(space, id, names): at most ``most`` distinct names across an edge type.

    ``near`` is the end of the edge the wanted node is on; without ``wanted`` every node of
    an edge is. Far ends meet the nodes of their space only: labels are few. Names are cut to the
    first ``most`` per node by rank before they are collected.
    """
    across = edges.where(F.col("type") == edge_type).select(
        F.col(f"{near}_space").alias("space"),
        F.col(near).alias("id"),
        F.col(f"{far}_space").alias("far_space"),
        F.col(far).alias("far_id"),
    )
    if wanted is not None:
        across = across.join(wanted.select(*NODE), NODE, "left_semi")
    across = across.distinct()
    far_space = fixed.EDGE_SPACES[edge_type][("src", "dst").index(far)]
    named = nodes.where(F.col("space") == far_space).select(F.col("space").alias("far_space"), F.col("id").alias("far_id"), "name")
    names = across.join(named.where(F.col("name").isNotNull()), ["far_id", "far_space"])
    first = top_per(names.select(*NODE, "name").distinct(), NODE, [F.col("name").asc()], most)
    return first.groupBy(*NODE).agg(F.sort_array(F.collect_list("name")).alias("names"))


def tied_names(
    wanted: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    most_artists: int = fixed.NAMES_ARTISTS,
    most_labels: int = fixed.NAMES_LABELS,
    every: bool = False,
) -> DataFrame:
    """(space, id, artists, labels) for the wanted nodes; empty where there are none.

    With ``every`` the edges are not narrowed to the wanted nodes first, which only costs
    where these are most of the graph; the rows are the same. The two sides are collected apart, so no artist is paired with a label.
    """
    ends = None if every else wanted
    artists = neighbour_names(ends, nodes, edges, "CREDITED", "dst", "src", most_artists)
    labels = neighbour_names(ends, nodes, edges, "RELEASED_ON", "src", "dst", most_labels)
    empty = F.array().cast("array<string>")
    joined = wanted.select(*NODE).distinct()
    joined = joined.join(artists.withColumnRenamed("names", "artists"), NODE, "left")
    joined = joined.join(labels.withColumnRenamed("names", "labels"), NODE, "left")
    return joined.select(
        *NODE,
        F.coalesce("artists", empty).alias("artists"),
        F.coalesce("labels", empty).alias("labels"),
    )


def boost(query_terms: Column, own: Column, names: Column, worth: float = fixed.NEIGHBOUR_BOOST) -> Column:
    """``worth`` for every term missing from the own title but part of a neighbour's."""
    lowered = F.transform(names, lambda name: F.lower(name))
    carried = F.filter(
        query_terms,
        lambda term: ~F.contains(own, term) & F.exists(lowered, lambda name: F.contains(name, term)),
    )
    return F.size(carried) * F.lit(worth)


def rank(
    queries: DataFrame,
    index: Index,
    nodes: DataFrame,
    edges: DataFrame,
    pool_size: int = fixed.POOL,
    worth: float = fixed.NEIGHBOUR_BOOST,
    preview: int = fixed.PREVIEW_SUGGEST,
) -> DataFrame:
    """The best ``limit`` nodes of every query, best first in ``position``.

    ``queries``: query_id, term, limit, and ``said`` where the words that names are
    tested for differ from the term. Score and degree decide, then kind and id.
    """
    # At most ``pool_size`` rows per query, and everything below starts from them.
    candidates = settle(pool(queries, index, pool_size))
    return rank_pool(queries, candidates, facts(nodes, edges, candidates, preview), worth)


def facts(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None, preview: int = fixed.PREVIEW_SUGGEST) -> DataFrame:
    """(space, id, title, year, profile, artists, labels, degree) of the wanted nodes, or of all."""
    named = nodes if wanted is None else wanted
    touching = endpoints(edges).select(*NODE)
    if wanted is not None:
        touching = touching.join(wanted.select(*NODE), NODE, "left_semi")
    degree = touching.groupBy(*NODE).agg(F.count(F.lit(1)).alias("degree"))
    shown = nodes.select(
        *NODE,
        X.display_title().alias("title"),
        F.coalesce("year", F.lit("")).alias("year"),
        F.substring(F.coalesce("profile", F.lit("")), 1, preview).alias("profile"),
    )
    if wanted is not None:
        shown = wanted.select(*NODE).distinct().join(shown, NODE)
    joined = shown.join(tied_names(named, nodes, edges, every=wanted is None), NODE).join(degree, NODE, "left")
    return joined.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def rank_pool(queries: DataFrame, candidates: DataFrame, known: DataFrame, worth: float = fixed.NEIGHBOUR_BOOST) -> DataFrame:
    """Ranked rows of ``candidates`` (as ``pool`` gives them), whose ``facts`` are known."""
    said = F.col("said" if "said" in queries.columns else "term")
    joined = candidates.join(known, NODE).join(queries.select("query_id", said.alias("said"), "limit"), "query_id")
    total = F.col("score") + boost(
        X.terms(F.col("said")), F.lower("title"), F.concat("artists", "labels"), worth
    )
    scored = joined.withColumn("score", F.round(total, SCORE_DIGITS))
    order = [
        F.col("score").desc(),
        F.col("degree").desc(),
        F.col("kind").asc(),
        F.col("id_num").asc(),
        F.col("id").asc(),
    ]
    return top_per(scored, ["query_id"], order, F.col("limit")).select(
        "query_id",
        F.col("rk").alias("position"),
        "kind",
        "space",
        "id",
        "title",
        "year",
        "profile",
        "artists",
        "labels",
        "score",
        "degree",
    )


def suggestions(ranked: DataFrame) -> DataFrame:
    """What a drop-down shows: no rank columns, one line of description."""
    line = X.subtitle(
        F.col("kind"), F.col("artists"), F.col("labels"), F.col("year"), F.col("profile")
    )
    return ranked.select(
        "query_id",
        "position",
        "kind",
        "id",
        "title",
        "year",
        "profile",
        F.array_join("artists", ", ").alias("artists"),
        F.array_join("labels", ", ").alias("labels"),
        line.alias("subtitle"),
    )


def seeds_of(ranked: DataFrame, limits: DataFrame) -> DataFrame:
    """Ranked nodes as the seeds of one expansion per query."""
    joined = ranked.join(limits.select("query_id", F.col("limit").alias("budget")), "query_id")
    return joined.select(
        F.col("query_id").alias("request_id"),
        F.col("position").cast("bigint").alias("seed_no"),
        "space",
        "id",
        X.clamp_limit(F.col("budget").cast("string")).alias("limit"),
    )


def tied_pieces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, id, name): the name of every artist credited on a release and,
    apart from those, of every label it is on."""

    def names(edge_type: str, near: str, far: str) -> DataFrame:
        pairs = edges.where(F.col("type") == edge_type).select(
            F.col(near).alias("id"), F.col(f"{far}_space").alias("far_space"), F.col(far).alias("far_id")
        )
        named = nodes.select(F.col("space").alias("far_space"), F.col("id").alias("far_id"), "name")
        joined = pairs.distinct().join(named.where(F.col("name").isNotNull()), ["far_id", "far_space"])
        return joined.select(F.lit("release").alias("space"), "id", "name").distinct()

    return names("CREDITED", "dst", "src").unionByName(names("RELEASED_ON", "src", "dst"))


def widened_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(space, kind, id, id_num, doc_key, token, tf, length) over the wider text.

    Kept as token rows: a release with millions of credits is never put together
    into one value.
    """
    own = nodes.select(*NODE, X.node_text().alias("piece"))
    texts = own.unionByName(tied_pieces(nodes, edges).withColumnRenamed("name", "piece"))
    spread = texts.select(*NODE, F.explode(X.tokens(F.col("piece"))).alias("token"))
    counted = settle(spread.groupBy(*NODE, "token").agg(F.count(F.lit(1)).alias("tf")))
    lengths = counted.groupBy(*NODE).agg(F.sum("tf").alias("length"))
    keys = nodes.select(*NODE, "kind", "id_num", doc_key(F.col("kind"), F.col("id_num"), F.col("id")).alias("doc_key"))
    # One row per node, as a table of its own, so that the join with the token
    # rows of a node with very many of them can be split.
    return counted.join(settle(keys.join(lengths, NODE)), NODE)


def widened_pool(queries: DataFrame, wide: DataFrame, size: int = fixed.POOL) -> DataFrame:
    """The best ``size`` nodes per query by BM25 over the wider text."""
    lengths = wide.select(*NODE, "length").distinct()
    whole = F.struct(F.count(F.lit(1)).alias("total"), F.avg("length").alias("mean"))
    whole = lengths.agg(whole).scalar()
    postings = wide.select("token", "kind", *NODE, "id_num", "tf", "length", "doc_key")
    scored = best_scores(queries, postings, ["kind", *NODE, "id_num"], whole, F.count(F.lit(1)), size)
    order = [F.col("score").desc(), F.col("doc_key").asc()]
    return top_per(scored, ["query_id"], order, size).select(
        "query_id", F.col("rk").alias("position"), "kind", "id", "score"
    )
