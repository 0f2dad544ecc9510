"""Catalogue dumps as DataFrames: one row per record, plus where it stood.

Every reader adds ``place``, a struct (file, block, pos, item) that compares in
document order. ``pos`` only grows inside one file block, which is why the file
and the start of the block come before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waxgraph import schemas
from waxgraph.functions import text as X
from waxgraph.session import settle

# Text is kept as written, white space included.
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def _place() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.lit(0).alias("item"),
    ).alias("place")


def read_records(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """Every outermost ``tag`` element of plain or gzip XML, one file per task."""
    reader = spark.read.format("xml").options(rowTag=tag, **XML_OPTIONS)
    return reader.schema(schemas.RECORDS[tag]).load(path).select("*", _place())


def read_texts(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """(place, content): the XML text of every ``tag`` element, unparsed.

    Cuts at the closing tag, so it is for tags that do not nest in themselves.
    Plain files split into blocks; a gzip member is inflated by one task, which
    does nothing else.
    """
    closing = f"</{tag}>"
    chunks = spark.read.option("lineSep", closing).text(path).select("value", _place())
    # Elements without content, <tag/>, may stand before the one a chunk ends with.
    pieces = F.split("value", rf"(?=<{tag}[\s>/])")
    spread = chunks.select("place", F.posexplode(pieces).alias("item", "piece"))
    # What precedes the first element or follows the last one is no record.
    spread = spread.where(F.col("piece").rlike(rf"^<{tag}[\s>/]"))
    empty = F.regexp_extract("piece", rf"^<{tag}(\s[^>]*)?/>", 0)
    content = F.when(empty != "", empty).otherwise(F.concat("piece", F.lit(closing)))
    return spread.select(F.col("place").withField("item", F.col("item")).alias("place"), content.alias("content"))


def parse_texts(texts: DataFrame, tag: str) -> DataFrame:
    """Record columns from the XML text in ``content``."""
    parsed = F.from_xml("content", schemas.RECORDS[tag], XML_OPTIONS)
    others = [name for name in texts.columns if name != "content"]
    return texts.select(*others, parsed.alias("record")).select("record.*", *others)


def read_records_spread(
    spark: SparkSession, path: str | list[str], tag: str, partitions: int | None = None
) -> DataFrame:
    """Like ``read_records``, with parsing spread over the cluster.

    Parsing costs several times what inflating does, so the raw text of a big
    compressed dump is dealt out first: to ``partitions`` tasks, or to as many as its
    size asks for.
    """
    texts = read_label_texts(spark, path) if tag == "label" else read_texts(spark, path, tag)
    return parse_texts(texts.repartition(partitions or _parts(spark, path)), tag)


# Compressed bytes of a dump that one task parses.
PART_BYTES = 8 << 20


def _parts(spark: SparkSession, path: str | list[str]) -> int:
    """As many tasks as the size of the files asks for, and no fewer than any shuffle has."""
    files = spark.read.text(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(files) / PART_BYTES))


def opening_tag(tag: str) -> str:
    """Pattern of a tag that opens an element with content; an attribute may hold ``>`` or ``/``."""
    return rf"""<{tag}(?:\s(?:[^"'>/]++|/(?!>)|"[^"]*+"|'[^']*+')*+)?>"""


def read_nested_texts(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    """(place, content): the XML text of every outermost ``tag`` element, unparsed.

    For tags that nest in themselves. The text is cut at every closing tag. How many
    elements are open after a cut is a sum over all before it; sums within a block of a
    file and over blocks give it without a look at the text again. An outermost element
    ends where none is open, so pieces between two such cuts are one. What is still open
    at the end of a file is no record; ``place`` is that of the first piece.
    """
    closing = f"</{tag}>"
    opening = opening_tag(tag)
    pieces = spark.read.option("lineSep", closing).text(path).select("value", _place())
    # Stored, as places must not change and the text is to be read once. ``pos`` is one of
    # a kind in a scan; it only orders pieces of one block.
    opens = F.regexp_count("value", F.lit(opening)).cast("long")
    pieces = settle(pieces.select("place", "value", F.col("place.pos").alias("pos"), opens.alias("opens")))
    block = ["file", "block"]
    inside = Window.partitionBy(*block).orderBy("pos")
    narrow = pieces.select("place.file", "place.block", "pos", "opens").withColumn("nth", F.row_number().over(inside))
    # The last piece of a file ends with no closing tag; nothing after it counts.
    steps = settle(narrow.select(*block, "pos", "nth", (F.sum("opens").over(inside) - F.col("nth")).alias("after")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nets = steps.groupBy(*block).agg(F.max_by("after", "nth").alias("net"))
    depths = settle(nets.select(*block, F.coalesce(F.sum("net").over(before), F.lit(0)).alias("depth")))
    ended = steps.join(depths, block).select(*block, "pos", (F.col("after") + F.col("depth") <= 0).cast("long").alias("ends"))
    counts = ended.groupBy(*block).agg(F.sum("ends").alias("ends"))
    # Numbers go on from file to file: a record is told by one of them.
    every = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.select(*block, F.coalesce(F.sum("ends").over(every), F.lit(0)).alias("earlier")))
    upto = F.coalesce(F.sum("ends").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owner = ended.withColumn("own", upto).join(counts, block).select("file", "pos", (F.col("own") + F.col("earlier")).alias("record"))
    owned = pieces.join(owner, "pos").select("record", "file", F.struct("place.block", "pos", "place", "value").alias("piece"))
    joined = owned.groupBy("record", "file").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    text = F.concat(F.array_join("pieces.value", closing), F.lit(closing))
    body = F.regexp_extract(text, rf"(?s){opening}.*$", 0)
    return joined.select(F.col("pieces")[0]["place"].alias("place"), body.alias("content")).where("content <> ''")


def read_label_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(place, content): the XML text of every outermost label, unparsed.

    Labels nest in labels. Where the first of a dump opens without an attribute, outermost
    ones do and nested ones do not: the cut is at that tag, which costs a fraction, and a
    label that does not keep to it comes out malformed and is set aside. A dump that
    begins otherwise is read by ``read_nested_texts``.
    """
    tag = F.regexp_extract("value", opening_tag("label"), 0)
    pieces = spark.read.option("lineSep", "</label>").text(path).select(tag.alias("tag"))
    first = pieces.where("tag <> ''").head()
    if first and first["tag"] != "<label>":
        return read_nested_texts(spark, path, "label")
    return _read_bare_labels(spark, path)


def _read_bare_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    opening, closing = "<label>", "</label>"
    pieces = spark.read.option("lineSep", opening).text(path).select("value", _place())
    # What stands before the first record has no closing tag.
    body = F.regexp_extract("value", r"(?s)^(.*)</label>", 1)
    return pieces.where(F.contains("value", F.lit(closing))).select(
        "place", F.concat(F.lit(opening), body, F.lit(closing)).alias("content")
    )


def _item_ids(column: str, field: str) -> Column:
    return F.coalesce(F.col(f"{column}.{field}._id"), F.array())


def reject_reason(tag: str) -> Column:
    """Why a record is set aside as a whole; null where it is fine."""
    malformed = F.when(F.col("_corrupt_record").isNotNull(), "malformed")
    if tag == "artist":
        declared = F.filter(_item_ids("aliases", "name"), lambda i: i.isNotNull() & (i != ""))
        members = _item_ids("members", "name")
        return (
            malformed.when(X.blank_to_null(F.col("id")).isNull(), "no id")
            .when((F.size(declared) > 0) & X.numeric_id(F.col("id")).isNull(), "id not a number")
            .when(F.exists(declared, lambda i: X.numeric_id(i).isNull()), "alias id not a number")
            .when(F.exists(members, lambda i: i.isNull()), "member without id")
        )
    if tag == "label":
        return malformed.when(X.blank_to_null(F.col("id")).isNull(), "no id").when(
            X.numeric_id(F.col("id")).isNull(), "id not a number"
        )
    if tag == "master":
        given = X.blank_to_null(F.col("main_release"))
        return malformed.when(
            given.isNotNull() & X.numeric_id(given).isNull(), "main_release not a number"
        )
    return malformed.when(X.numeric_id(F.col("_id")).isNull(), "id not a number").when(
        F.col("title").isNull(), "no title"
    )


def screen(records: DataFrame, tag: str) -> DataFrame:
    """Add the column ``reject`` with the reason, or null."""
    return records.withColumn("reject", reject_reason(tag))


def accepted(screened: DataFrame) -> DataFrame:
    return screened.where(F.col("reject").isNull()).drop("reject", "_corrupt_record")


def rejected(screened: DataFrame, tag: str) -> DataFrame:
    key = {"release": "_id", "master": "main_release"}.get(tag, "id")
    return screened.where(F.col("reject").isNotNull()).select(
        F.lit(tag).alias("tag"), "place", F.col(key).alias("id"), F.col("reject").alias("reason")
    )


def load_counters(screened: DataFrame, wanted: DataFrame | None = None, key: str = "_id") -> DataFrame:
    """Records scanned, records set aside and their share in per cent.

    With the ids that were ``wanted`` also how many of them were found among the
    accepted records and how many were not.
    """
    counts = screened.agg(
        F.count(F.lit(1)).alias("scanned"), F.count("reject").alias("errors")
    )
    rate = F.coalesce(F.try_divide(F.col("errors") * 100.0, F.col("scanned")), F.lit(0.0))
    counts = counts.select("scanned", "errors", rate.alias("error_rate"))
    if wanted is None:
        return counts
    asked = wanted.select("id").distinct()
    found = accepted(screened).select(X.numeric_id(F.col(key)).alias("id")).distinct().withColumn("hit", F.lit(1))
    met = asked.join(found, "id", "left").agg(
        F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("missing")
    )
    return counts.select("*", met.select("matched").scalar().alias("matched"), met.select("missing").scalar().alias("missing"))


def audit(files: DataFrame) -> DataFrame:
    """Per input file of a scan: bytes, rows and the dump date in its name.

    ``files`` must come straight from a file source.
    """
    seen = files.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    per_file = seen.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows"))
    date = X.blank_to_null(F.regexp_extract("file", r"^[^_]*_([0-9]+)_", 1))
    return per_file.select("file", "bytes", "rows", date.alias("dump_date"))
