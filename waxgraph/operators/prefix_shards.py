"""Names in shards of bounded size, by a prefix tree that grows where names are many.

A prefix is split into those of one more character while it has more rows than a shard
may hold. A name that is itself a split prefix has a shard of its own, in parts if very
many rows share it. So a lookup opens one shard, or the parts of one name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waxgraph.operators import positions
from waxgraph.session import settle

MOST = 1000
# Characters of a name that are looked at in one pass.
STEP = 16


def _leaves(names: DataFrame, most: int) -> DataFrame:
    """(key, prefix, exact) of every distinct name, from (key, n).

    One pass for ``STEP`` characters, over the names that are still in a prefix with too
    many rows; a name that very many rows share is one row here.
    """
    left, found, start = names, [], 1
    while True:
        depths = F.sequence(F.lit(start), F.least(F.lit(start + STEP - 1), F.length("key")))
        spread = left.select("key", "n", F.explode(depths).alias("depth"))
        spread = spread.withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("depth")))
        small = spread.groupBy("prefix").agg(F.sum("n").alias("rows")).where(F.col("rows") <= most).select("prefix")
        first = settle(spread.join(small, "prefix").groupBy("key").agg(F.min("depth").alias("depth")))
        prefix = F.substring(F.col("key"), F.lit(1), F.col("depth"))
        found.append(first.select("key", prefix.alias("prefix"), F.lit(False).alias("exact")))
        rest = settle(left.join(first.select("key"), "key", "left_anti"))
        start += STEP
        found.append(rest.where(F.length("key") < start).select("key", F.col("key").alias("prefix"), F.lit(True).alias("exact")))
        left = rest.where(F.length("key") >= start)
        if left.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def shards(rows: DataFrame, order: list[str], most: int = MOST, name: str = "name") -> DataFrame:
    """``rows`` with ``prefix, exact, part``: the shard each is looked up in.

    Names are compared in lower case; rows without one are left out. ``order`` names the
    columns that put rows of one name in order, which its parts follow. No shard has more
    than ``most`` rows.
    """
    keyed = rows.where(F.col(name).isNotNull() & (F.col(name) != "")).withColumn("key", F.lower(name))
    names = settle(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    placed = settle(_leaves(names, most).join(names, "key"))
    big = settle(placed.where(F.col("exact") & (F.col("n") > most)).select(F.col("key").alias("of")))
    few = keyed.join(big, F.col("key") == F.col("of"), "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    many = keyed.join(big, F.col("key") == F.col("of"), "left_semi")
    # Ranks within a name by prefix sums: a name on a third of all rows is many partitions.
    dealt = many.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumns(
        {"block": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}
    )
    ranked = positions.numbered(dealt, file="key").withColumn("part", F.floor(F.col("place") / most).cast("bigint"))
    columns = [*rows.columns, "key", "part"]
    every = few.select(*columns).unionByName(ranked.select(*columns))
    return every.join(placed.drop("n"), "key").drop("key").select(*rows.columns, "prefix", "exact", "part")


def lookup_table(sharded: DataFrame) -> DataFrame:
    """(prefix, exact, parts, rows): what there is to open, the table a client reads first."""
    return sharded.groupBy("prefix", "exact").agg(
        (F.max("part") + 1).alias("parts"), F.count(F.lit(1)).alias("rows")
    )


def find(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (q) with the shard that holds names equal to ``q``: ``prefix, exact, parts``.

    All prefixes of a text are looked for; the exact shard of the text comes first, then
    the longest prefix. No row where the tree has no such branch.
    """
    key = F.lower("q")
    prefixes = F.transform(F.sequence(F.lit(1), F.length(key)), lambda d: F.substring(key, F.lit(1), d))
    spread = asked.where(F.length("q") > 0).select("q", F.explode(prefixes).alias("prefix"))
    met = spread.join(table, "prefix").where(~F.col("exact") | (F.col("prefix") == key))
    best = F.max_by(F.struct("prefix", "exact", "parts"), F.struct("exact", F.length("prefix").alias("size")))
    return met.groupBy("q").agg(best.alias("best")).select("q", "best.*")
