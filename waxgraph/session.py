"""Session settings the plans rely on, and the one way lineage gets cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Run-time SQL settings only, so they can be applied to any running session.
# Shuffle partition counts and memory belong to the cluster and stay untouched;
# adaptive execution coalesces small partitions, switches a join to broadcast
# once the measured size of a side allows it, and splits skewed partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    # What a finished query shuffled is not kept on disk until the driver collects garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="waxgraph-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    That is ``spark.checkpoint.dir``, or else what the session was given as its
    checkpoint directory. Only a session in one process, as in a test, gets a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return _local_folder()


def new_folder(spark: SparkSession) -> str:
    """Path of a folder of one's own in the shared one, gone when the scope or the application ends."""
    path = f"{shared_folder(spark)}/waxgraph-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if _scopes:
        _scopes[-1].append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are deleted at its end; nothing read from them may be used after it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back from there.

    Used where one intermediate feeds several later steps: it is computed once,
    a lost executor costs no recomputation beyond it, and the planner knows its
    size. The table goes when the ``scope`` around it or else the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
