"""First or last row per key under an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count) -> DataFrame:
    """The first ``count`` rows of every key, numbered from 1 in ``rk``.

    The filter on the row number lets Spark drop surplus rows inside every map
    task, so a hot key ships ``count`` rows per task and no more.
    """
    ranked = df.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rk") <= count)


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that would be left after writing all rows in order, by key."""
    return top_per(df, keys, [column.desc() for column in order], 1).drop("rk")
