"""References inside profile texts, and the nodes they mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators import search
from waxgraph.operators.latest import top_per
from waxgraph.session import settle


def matches(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """(*keep, no, match): every match of a pattern in a text, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return df.select(*keep, F.posexplode(found).alias("no", "match"))


def profile_refs(nodes: DataFrame) -> DataFrame:
    """(space, kind, id, no, letter, form, ref): references in document order.

    ``form`` tells the bare id form from the free text one, which may still hold
    a number.
    """
    found = matches(nodes, "profile", fixed.PROFILE_REF, "space", "kind", "id")
    number = F.regexp_extract("match", fixed.PROFILE_REF, 2)
    free = F.regexp_extract("match", fixed.PROFILE_REF, 3)
    return found.select(
        "space",
        "kind",
        "id",
        "no",
        F.lower(F.regexp_extract("match", fixed.PROFILE_REF, 1)).alias("letter"),
        F.when(number != "", "id").otherwise("text").alias("form"),
        F.when(number != "", number).otherwise(free).alias("ref"),
    )


def usage(refs: DataFrame) -> DataFrame:
    return refs.groupBy("letter", "form").agg(F.count(F.lit(1)).alias("n"))


def links(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, no, href): link targets in page source, by the same method."""
    found = matches(texts, text, fixed.HREF, *keep)
    return found.select(*keep, "no", F.regexp_extract("match", fixed.HREF, 1).alias("href"))


def ref_key(ref: Column) -> Column:
    return F.substring(X.strip(ref), 1, fixed.REF_MAX)


def _space_of_letter(letter: Column) -> Column:
    chain = None
    for name, kinds in fixed.REF_KINDS.items():
        space = fixed.SPACE_OF_KIND[kinds[0]]
        chain = F.when(letter == name, space) if chain is None else chain.when(letter == name, space)
    return chain


def distinct_refs(refs: DataFrame) -> DataFrame:
    """(letter, ref, space): each reference once, those that can name no node left out."""
    keyed = refs.select("letter", ref_key(F.col("ref")).alias("ref"))
    keyed = keyed.withColumn("space", _space_of_letter(F.col("letter")))
    return keyed.where("space IS NOT NULL AND ref <> ''").distinct()


def is_number(ref: Column) -> Column:
    return ref.rlike("^[0-9]+$")


def _found(kind: Column, id_: Column) -> Column:
    return F.struct(kind.alias("kind"), id_.alias("id"))


def by_id(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(letter, ref, target): nodes with that native id, Artist before Group."""
    numbers = refs.where(is_number(F.col("ref")))
    named = nodes.select("space", F.col("id").alias("ref"), "kind").join(numbers, ["ref", "space"], "left_semi")
    known = named.groupBy("space", "ref").agg(F.min("kind").alias("kind"))
    joined = numbers.join(known, ["ref", "space"])
    return joined.select("letter", "ref", _found(F.col("kind"), F.col("ref")).alias("target"))


def by_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(letter, ref, target): nodes of exactly that name, in any case.

    Nodes of one name are reduced to the first of them before the join.
    """
    texts = refs.where(~is_number(F.col("ref"))).withColumn("folded", F.lower("ref"))
    own = F.when(F.col("space") == "release", F.col("title")).otherwise(F.col("name"))
    named = nodes.select("space", "kind", "id", "id_num", F.lower(own).alias("folded"))
    named = named.where(F.col("folded").isNotNull())
    named = named.join(texts.select("folded", "space"), ["folded", "space"], "left_semi")
    first = named.groupBy("space", "folded").agg(
        F.min(F.struct("kind", "id_num", "id")).alias("first")
    )
    joined = texts.join(first, ["folded", "space"])
    return joined.select("letter", "ref", _found(F.col("first.kind"), F.col("first.id")).alias("target"))


Ranker = Callable[[DataFrame], DataFrame]


def by_rank(refs: DataFrame, rank: Ranker, top: int = fixed.REF_TOP) -> DataFrame:
    """(letter, ref, target): first node of an allowed kind among the best few.

    ``rank`` gives the rows of ``search.rank`` for prepared queries.
    """
    queries = refs.select("ref").distinct().select(
        F.col("ref").alias("query_id"), F.col("ref").alias("q"), F.lit(top).alias("limit")
    )
    # Scored by the cleaned text; names are tested for the words as they were written.
    asked = search.prepare(queries, fixed.REF_MAX).withColumn("said", F.col("q"))
    ranked = rank(asked)
    hits = refs.join(
        ranked.select(F.col("query_id").alias("ref"), "space", "kind", "id", "position"),
        ["ref", "space"],
    )
    best = top_per(hits, ["ref", "letter"], [F.col("position").asc()], 1)
    return best.select("letter", "ref", _found(F.col("kind"), F.col("id")).alias("target"))


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame, index: search.Index) -> DataFrame:
    """``resolve_by`` with a search over nodes and edges."""
    return resolve_by(refs, nodes, lambda queries: search.rank(queries, index, nodes, edges))


def resolve_by(refs: DataFrame, nodes: DataFrame, rank: Ranker) -> DataFrame:
    """(letter, ref, method, target_kind, target_id) of every distinct reference.

    A number is looked up by id and nothing else. A text is looked up by name
    and, failing that, by rank. ``method`` is null where nothing was found.
    """
    keys = settle(distinct_refs(refs))
    numbers = by_id(keys, nodes).withColumn("method", F.lit("id"))
    names = settle(by_name(keys, nodes).withColumn("method", F.lit("name")))
    texts = keys.where(~is_number(F.col("ref")))
    left = texts.join(names.select("letter", "ref"), ["ref", "letter"], "left_anti")
    ranks = by_rank(left, rank).withColumn("method", F.lit("rank"))
    found = numbers.unionByName(names).unionByName(ranks)
    joined = keys.join(found, ["ref", "letter"], "left")
    return joined.select(
        "letter",
        "ref",
        "method",
        F.col("target.kind").alias("target_kind"),
        F.col("target.id").alias("target_id"),
    )


def mentions(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """MENTIONS edges: which node's profile names which other node, how often."""
    keyed = refs.select("kind", "id", "letter", ref_key(F.col("ref")).alias("ref"))
    counted = keyed.groupBy("kind", "id", "letter", "ref").agg(F.count(F.lit(1)).alias("times"))
    found = resolved.where(F.col("method").isNotNull())
    joined = counted.join(found, ["ref", "letter"])
    return joined.groupBy("kind", "id", "target_kind", "target_id").agg(
        F.sum("times").alias("times")
    )


def ref_link(site: str, letter: Column, ref: Column) -> Column:
    """Page to open for a reference with no node; null for free text."""
    kind = None
    for name, kinds in fixed.REF_KINDS.items():
        kind = F.when(letter == name, kinds[0]) if kind is None else kind.when(letter == name, kinds[0])
    master = F.concat(F.lit(f"{site.rstrip('/')}/{fixed.MASTER_PATH}/"), ref)
    page = F.when(letter == "m", master).otherwise(X.site_link(site, kind, ref))
    return F.when(is_number(ref), page)
