"""The build log: JSON lines, one record per change of state of a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waxgraph import schemas


def _records(rows: DataFrame) -> DataFrame:
    """Blank and malformed lines, and records without a step number, drop out."""
    return rows.where("n IS NOT NULL").drop("_corrupt_record")


def read_steps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _records(spark.read.schema(schemas.STEPS).json(path))


def stream_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The same while files keep arriving in ``folder``."""
    return _records(spark.readStream.schema(schemas.STEPS).json(folder))
