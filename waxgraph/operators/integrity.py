"""Checks on keys and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph import fixed
from waxgraph.operators.adjacency import NODE, endpoints
from waxgraph.session import settle


class TooManyBadEdges(ValueError):
    """More edges without a node at an end than the tolerance allows."""


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(space, id) that edges name and no node has.

    Ends collapse to distinct keys in the map tasks, so a node on a third of all
    edges is compared once.
    """
    named = endpoints(edges).select(*NODE).distinct()
    return named.join(nodes.select(*NODE), NODE, "left_anti")


def flag_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``src_missing`` and ``dst_missing``.

    The edges meet the short list of missing ids rather than all nodes. It serves
    both ends, so it is written once; as a plain table it is broadcast while it
    is small, and past that the join can be split where an id is hot.
    """
    missing = settle(missing_endpoints(edges, nodes))

    def side(name: str) -> DataFrame:
        return missing.select(
            F.col("space").alias(f"{name}_space"),
            F.col("id").alias(name),
            F.lit(True).alias(f"{name}_missing"),
        )

    flagged = edges
    for name in ("src", "dst"):
        flagged = flagged.join(side(name), [name, f"{name}_space"], "left")
        flagged = flagged.withColumn(f"{name}_missing", F.col(f"{name}_missing").isNotNull())
    return flagged


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return flag_edges(edges, nodes).where("src_missing OR dst_missing")


def good_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    flagged = flag_edges(edges, nodes).where("NOT src_missing AND NOT dst_missing")
    return flagged.drop("src_missing", "dst_missing")


def check_tolerance(dangling: DataFrame, tolerance: int = fixed.BAD_EDGE_TOLERANCE) -> int:
    """Number of dangling edges; raises where it is above ``tolerance``."""
    count = dangling.count()
    if count > tolerance:
        raise TooManyBadEdges(f"{count} bad edges, {tolerance} tolerated")
    return count


def repeated_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, times) of the keys seen more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def repeat_positions(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """(*keys, position) of every repeat of a key, its first row left out.

    One row per repeat instead of a list per key, and taken as all rows but the
    first ones: that is a join on key and position together, so a key on a third
    of all rows is spread like any other.
    """
    listed = rows.select(*keys, position)
    first = listed.groupBy(*keys).agg(F.min(position).alias(position))
    return listed.join(first, [position, *keys], "left_anti").select(*keys, position)


def repeat_counts(tables: DataFrame, table: str = "table", key: str = "id") -> DataFrame:
    """How many ids each table holds more than once, tables without any included."""
    times = tables.groupBy(table, key).agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy(table).agg(F.count_if(F.col("times") > 1).alias("repeated"))


def node_repeats(nodes: DataFrame) -> DataFrame:
    """Repeated ids per kind, and per shared id space under ``space:<name>``."""
    keyed = nodes.select(
        F.inline(
            F.array(
                F.struct(F.col("kind").alias("table"), F.col("id").alias("id")),
                F.struct(F.concat(F.lit("space:"), "space").alias("table"), F.col("id").alias("id")),
            )
        )
    )
    return repeat_counts(keyed)


def main_releases(masters: DataFrame) -> DataFrame:
    """(id) the main release of every master that names one."""
    number = F.col("main_release").try_cast("bigint")
    return masters.select(number.alias("id")).where(F.col("id").isNotNull())


def wanted_ids(masters: DataFrame) -> DataFrame:
    """(id) every distinct main release named by a master."""
    return main_releases(masters).distinct()


def canonical(releases: DataFrame, wanted: DataFrame, id_: str | Column = "_id") -> DataFrame:
    """Releases whose id is in ``wanted``, which may hold an id more than once."""
    number = (F.col(id_) if isinstance(id_, str) else id_).try_cast("bigint")
    return releases.withColumn("wanted_id", number).join(
        wanted.select(F.col("id").alias("wanted_id")), "wanted_id", "left_semi"
    ).drop("wanted_id")


# Ids in one row of a bitmap, as words of 64 bits.
BITMAP_IDS, WORD = 2048, 64
# Rows of a bitmap that go to every task at once: about 64 MB, or 500 million ids in a row.
BITMAP_ROWS = 1 << 18


def id_bitmap(ids: DataFrame) -> DataFrame:
    """(bucket, words): the ids as bits, a row for each range of ``BITMAP_IDS`` that has one."""
    number = F.col("id")
    word = F.shiftright(number.bitwiseAND(BITMAP_IDS - 1), 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(WORD - 1).cast("int"))
    words = ids.where(number.isNotNull()).groupBy(F.shiftright(number, 11).alias("bucket"), word.alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    listed = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    places = F.array(*(F.lit(i) for i in range(BITMAP_IDS // WORD)))
    return listed.select(
        "bucket", F.transform(places, lambda i: F.coalesce(F.try_element_at("words", i), F.lit(0).cast("bigint"))).alias("words")
    )


def in_bitmap(rows: DataFrame, bitmap: DataFrame, number: Column, keep_null: bool = False) -> DataFrame:
    """Rows whose number has its bit set, tested where they are: none is ever shuffled.

    The bitmap is stored first. One of more than ``BITMAP_ROWS`` rows is sent in slices,
    and the rows are read once for each. With ``keep_null`` rows without a number stay.
    """
    bitmap = settle(bitmap)
    slices = max(1, -(-bitmap.count() // BITMAP_ROWS))
    keyed = rows.select("*", number.alias("number"))
    bits = F.get("words", F.shiftright(F.col("number").bitwiseAND(BITMAP_IDS - 1), 6).cast("int"))
    shifted = F.call_function("shiftright", bits, F.col("number").bitwiseAND(WORD - 1).cast("int"))
    is_set = shifted.bitwiseAND(F.lit(1).cast("bigint")) == 1
    found = None
    for i in range(slices):
        part = bitmap.where(F.pmod(F.xxhash64("bucket"), F.lit(slices)) == i) if slices > 1 else bitmap
        # An outer join, so that rows without a number pass by the same scan.
        met = keyed.join(F.broadcast(part), F.shiftright(F.col("number"), 11) == F.col("bucket"), "left")
        kept = met.where(is_set | F.col("number").isNull() if keep_null and i == 0 else is_set).select(*rows.columns)
        found = kept if found is None else found.unionByName(kept)
    return found


def missing_wanted(releases: DataFrame, wanted: DataFrame, id_: str | Column = "_id") -> DataFrame:
    """Wanted ids no release has."""
    number = (F.col(id_) if isinstance(id_, str) else id_).try_cast("bigint")
    return wanted.join(releases.select(number.alias("id")).distinct(), "id", "left_anti")
