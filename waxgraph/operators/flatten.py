"""Nested records to node and edge rows.

All functions take accepted records in the shape of ``schemas`` with ``place``;
elements with an array of links are exploded in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X


def node_row(kind: Column | str, id_: Column, **texts: Column) -> list[Column]:
    """Columns of the unified node table; texts not given are null."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    columns = [
        X.space_of(kind).alias("space"),
        kind.alias("kind"),
        id_.alias("id"),
        X.numeric_id(id_).alias("id_num"),
    ]
    for name in ("title", "name", "realname", "year", "profile"):
        given = texts.get(name)
        value = F.lit(None).cast("string") if given is None else X.blank_to_null(given)
        columns.append(value.alias(name))
    return columns


def edge_row(edge_type: str, src: Column, dst: Column, ordinal: Column | int = 0) -> list[Column]:
    """Columns of the unified edge table."""
    src_space, dst_space = fixed.EDGE_SPACES[edge_type]
    ordinal = F.lit(ordinal) if isinstance(ordinal, int) else ordinal
    return [
        F.lit(edge_type).alias("type"),
        F.lit(src_space).alias("src_space"),
        src.cast("string").alias("src"),
        F.lit(dst_space).alias("dst_space"),
        dst.cast("string").alias("dst"),
        ordinal.cast("bigint").alias("ordinal"),
    ]


def entity_kind(members: Column) -> Column:
    """A record with a members element is a Group, even if that is empty."""
    return F.when(members.isNotNull(), "Group").otherwise("Artist")


def entity_nodes(artists: DataFrame) -> DataFrame:
    """Artist and Group nodes; a Group has no real name."""
    kind = entity_kind(F.col("members"))
    realname = F.when(F.col("members").isNull(), F.col("realname"))
    return artists.select(
        *node_row(kind, F.col("id"), name=F.col("name"), realname=realname, profile=F.col("profile"))
    )


def member_edges(artists: DataFrame) -> DataFrame:
    items = artists.select("id", F.posexplode("members.name").alias("item_no", "item"))
    return items.select(*edge_row("MEMBER_OF", F.col("item._id"), F.col("id"), F.col("item_no")))


def alias_entries(artists: DataFrame) -> DataFrame:
    """(self, alias, place, item_no) as declared; entries without id are left out."""
    items = artists.select("id", "place", F.posexplode("aliases.name").alias("item_no", "item"))
    entries = items.select(
        F.col("id").alias("self"), F.col("item._id").alias("alias"), "place", "item_no"
    )
    return entries.where(X.blank_to_null(F.col("alias")).isNotNull())


def release_nodes(releases: DataFrame) -> DataFrame:
    return releases.select(
        *node_row("Release", F.col("_id"), title=F.col("title"), year=F.col("released"))
    )


def credit_entries(
    releases: DataFrame, placeholders: Iterable[str] = fixed.PLACEHOLDER_IDS
) -> DataFrame:
    """(release, artist, role, item_no): main and extra credits, both kept.

    Credits without an id and those of placeholder performers are left out.
    """

    def tagged(column: str, role: str) -> Column:
        listed = F.coalesce(F.col(column), F.array())
        return F.transform(listed, lambda c: F.struct(c["id"].alias("artist"), F.lit(role).alias("role")))

    both = F.concat(tagged("artists.artist", "main"), tagged("extraartists.artist", "extra"))
    items = releases.select(F.col("_id").alias("release"), F.posexplode(both).alias("item_no", "item"))
    credits = items.select("release", "item.artist", "item.role", "item_no")
    return credits.where(F.col("artist").isNotNull() & ~F.col("artist").isin(*placeholders))


def credited_edges(credits: DataFrame) -> DataFrame:
    return credits.select(
        *edge_row("CREDITED", F.col("artist"), F.col("release"), F.col("item_no"))
    )


def listed_labels(releases: DataFrame) -> DataFrame:
    """(release, label, name, place, item_no) of the labels a release is on."""
    items = releases.select(
        F.col("_id").alias("release"), "place", F.posexplode("labels.label").alias("item_no", "item")
    )
    listed = items.select(
        "release", F.col("item._id").alias("label"), F.col("item._name").alias("name"), "place", "item_no"
    )
    return listed.where(F.col("label").isNotNull())


def released_on_edges(listed: DataFrame) -> DataFrame:
    return listed.select(
        *edge_row("RELEASED_ON", F.col("release"), F.col("label"), F.col("item_no"))
    )


def sublabels(labels: DataFrame) -> DataFrame:
    """(parent, label, name, place, item_no); entries without an id are left out."""
    items = labels.select("id", "place", F.posexplode("sublabels.label").alias("item_no", "item"))
    listed = items.select(
        F.col("id").alias("parent"),
        F.col("item._id").alias("label"),
        F.col("item._VALUE").alias("name"),
        "place",
        "item_no",
    )
    return listed.where(F.col("label").isNotNull())


def sublabel_edges(listed: DataFrame) -> DataFrame:
    return listed.select(*edge_row("SUBLABEL", F.col("label"), F.col("parent"), F.col("item_no")))


def all_nodes(*tables: DataFrame) -> DataFrame:
    """One keyed set from node tables of any kinds."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
