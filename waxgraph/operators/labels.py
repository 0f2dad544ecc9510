"""Labels as the sum of their sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph.functions import text as X
from waxgraph.operators.flatten import node_row

# Release listings are read after the label dump, so their names come later.
FROM_DUMP, FROM_RELEASES = 0, 1

# A nested sublabel is seen before the record around it is complete.
LAST_ITEM = 2**31 - 1


def sighting(
    source: int, label: Column, name: Column, profile: Column | None, place: Column, item_no: Column
) -> list[Column]:
    """One sighting with its place in the order of all of them."""
    return [
        label.alias("id"),
        F.coalesce(name, F.lit("")).alias("name"),
        (F.lit("") if profile is None else F.coalesce(profile, F.lit(""))).alias("profile"),
        F.struct(
            F.lit(source).alias("source"), place.alias("place"), item_no.cast("int").alias("item_no")
        ).alias("seq"),
    ]


def dump_sightings(labels: DataFrame) -> DataFrame:
    return labels.select(
        *sighting(
            FROM_DUMP, F.col("id"), F.col("name"), F.col("profile"), F.col("place"), F.lit(LAST_ITEM)
        )
    )


def sublabel_sightings(listed: DataFrame) -> DataFrame:
    return _named(listed, FROM_DUMP)


def release_sightings(listed: DataFrame) -> DataFrame:
    return _named(listed, FROM_RELEASES)


def _named(listed: DataFrame, source: int) -> DataFrame:
    return listed.select(
        *sighting(source, F.col("label"), F.col("name"), None, F.col("place"), F.col("item_no"))
    )


def merge(sightings: DataFrame) -> DataFrame:
    """One row per id: the name seen last, empty or not, and the last profile
    that was not empty.

    Both are partial aggregates, so a label seen on a third of all releases is
    reduced to one row per map task before the shuffle.
    """
    usable = sightings.where(X.numeric_id(F.col("id")).isNotNull())
    filled = F.col("profile") != ""
    return usable.groupBy("id").agg(
        F.max_by("name", "seq").alias("name"),
        F.coalesce(
            F.max_by(F.when(filled, F.col("profile")), F.when(filled, F.col("seq"))), F.lit("")
        ).alias("profile"),
    )


def unusable(sightings: DataFrame) -> DataFrame:
    """Sightings that ``merge`` leaves out, as reject rows."""
    return sightings.where(X.numeric_id(F.col("id")).isNull()).select(
        F.lit("label").alias("tag"), F.col("seq.place").alias("place"), "id", F.lit("listed id not a number").alias("reason")
    )


def label_nodes(merged: DataFrame) -> DataFrame:
    return merged.select(
        *node_row("Label", F.col("id"), name=F.col("name"), profile=F.col("profile"))
    )
