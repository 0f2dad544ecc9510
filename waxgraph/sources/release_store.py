"""Raw release store: the XML text of a release by its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waxgraph.functions import text as X
from waxgraph.operators import integrity
from waxgraph.operators.latest import last_write
from waxgraph.session import settle
from waxgraph.sources import xml_dumps

STORE = "id long, content string"


def keyed_texts(texts: DataFrame) -> DataFrame:
    """(id, content, place) from release texts; the id is null where it is no number."""
    attribute = F.regexp_extract("content", r"^<release(?:\s[^>]*?)?\sid\s*=\s*([\"'])\s*([0-9]+)\s*\1", 2)
    return texts.select(X.numeric_id(attribute).alias("id"), "content", "place")


def wanted_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose id is wanted, and those without one, in a single pass over the dump.

    The bitmap meets the texts in the task that cuts them.
    """
    return integrity.in_bitmap(keyed, integrity.id_bitmap(wanted), F.col("id"), keep_null=True)


def build_store(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text of every release in a dump, the last one where an id repeats."""
    texts = keyed_texts(xml_dumps.read_texts(spark, path, "release")).where(F.col("id").isNotNull())
    return last_write(texts, ["id"], [F.col("place")]).select("id", "content")


def read_parts(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all part stores with the part they came from and their position."""
    rows = spark.read.schema(STORE).parquet(*paths)
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1)
    return rows.select(
        "*",
        folder.alias("part"),
        F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index")).alias("pos"),
    )


def merge_parts(parts: DataFrame, part: Column | None = None, pos: Column | None = None) -> DataFrame:
    """One row per id; the part last in name order wins, inside it the last row."""
    order = [F.col("part") if part is None else part, F.col("pos") if pos is None else pos]
    return last_write(parts, ["id"], order).select("id", "content")


# Ids of one range, a folder of the stored table.
RANGE_IDS = 1 << 16


def _ranged(rows: DataFrame, ids: int) -> DataFrame:
    return rows.select("id", "content", F.floor(F.col("id") / F.lit(ids)).cast("bigint").alias("range"))


def _write_ranges(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.hint("rebalance", "range")
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(path)


def write_ranges(rows: DataFrame, path: str, ids: int = RANGE_IDS) -> None:
    """Store merged rows (id, content) by ranges of ids; an existing store is refused."""
    _write_ranges(_ranged(rows, ids), path, "errorifexists")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STORE}, range long").parquet(path)


def update_ranges(path: str, part: DataFrame, pos: Column | None = None, ids: int = RANGE_IDS) -> list[int]:
    """Merge a newer part (id, content, and what ``pos`` orders by) into a store; the ranges rewritten.

    Rows of the part displace those of the store, its last row those before it. Only
    ranges the part has ids in are read and rewritten: the files of all others stay. The
    result is that of merging all parts anew, and doing it again changes nothing.
    """
    spark = part.sparkSession
    order = [F.col("pos") if pos is None else pos]
    fresh = settle(_ranged(last_write(part, ["id"], order), ids))
    # No more ranges than ids over the width of one.
    touched = sorted(row["range"] for row in fresh.select("range").distinct().collect())
    old = read_ranges(spark, path).where(F.col("range").isin(*touched)).join(fresh.select("id"), "id", "left_anti")
    # Spark does not write a table it reads from, so the rows are put down first.
    merged = settle(old.select("id", "content", "range").unionByName(fresh))
    if touched:
        _write_ranges(merged, path, "overwrite")
    return touched


def part_rows(parts: DataFrame) -> DataFrame:
    """Rows in each part and, under a null part, in all of them."""
    return parts.rollup("part").agg(F.count(F.lit(1)).alias("rows"))


def documents_of(masters: DataFrame, store: DataFrame) -> DataFrame:
    """Parsed main release of each master; masters without one in store drop out.

    Masters sharing a main release yield it once.
    """
    wanted = masters.select(X.numeric_id(F.col("main_release")).alias("id"))
    found = store.join(wanted.where(F.col("id").isNotNull()).distinct(), "id", "left_semi")
    return xml_dumps.parse_texts(found, "release")
