"""Places of rows in their files, over many files, without a sort.

A scan numbers the rows of each block of a file by itself. Rows per block and prefix sums
over blocks make exact numbers out of that: the n-th row of the file, the n-th of all
files in order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph.session import settle


BLOCKS = 400
LARGEST_BLOCK = 128 << 20


def block_size(size: int, least: int) -> int:
    """Bytes of a block that gives some ``BLOCKS`` blocks of ``size`` bytes; more only above 128 MB each."""
    return min(max(least, -(-size // BLOCKS)), LARGEST_BLOCK)


def scanned() -> dict[str, Column]:
    """``file, block, pos`` of the rows of a file source; ``pos`` only grows inside a block."""
    return {
        "file": F.col("_metadata.file_path"),
        "block": F.col("_metadata.file_block_start"),
        "pos": F.monotonically_increasing_id(),
    }


def numbered(rows: DataFrame, file: str = "file", block: str = "block", pos: str = "pos") -> DataFrame:
    """``rows`` with ``place`` (from 0, in the file) and ``position`` (from 0, in all files by name).

    ``rows`` must be all rows of the scan; what is not wanted is left out afterwards. They
    are stored first, as a place must not change between two looks at it. Only one row per
    block goes through a single task; with a block of 128 MB that is a million for 100 TB.
    """
    stored = settle(rows)
    blocks = stored.groupBy(file, block).agg(F.count(F.lit(1)).alias("rows"), F.min(pos).alias("start"))
    in_file = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(
        blocks.select(
            F.col(file).alias("of_file"), F.col(block).alias("of_block"), "start",
            F.coalesce(F.sum("rows").over(in_file), F.lit(0)).alias("before"),
            F.coalesce(F.sum("rows").over(in_all), F.lit(0)).alias("before_all"),
        )
    )
    same = (F.col(file) == F.col("of_file")) & (F.col(block) == F.col("of_block"))
    inside = F.col(pos) - F.col("start")
    return stored.join(sums, same).select(
        *rows.columns, (F.col("before") + inside).alias("place"), (F.col("before_all") + inside).alias("position")
    )
