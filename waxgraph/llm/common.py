"""What the training-data operators share: intermediate tables, sizes, Arrow helpers."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waxgraph.session import shared_folder, tune

# Rows that go to Python at once; texts can be long, so batches stay short.
BATCH_ROWS = 1000
# Shuffle files of a finished job are of no use: every intermediate is a table.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's run-time settings and those of this subpackage."""
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a frame and reads it back, which cuts the lineage: a lost executor
    costs no recomputation beyond the table. ``drop`` deletes tables that are used up;
    the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def _jvm_path(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path, jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        df.write.parquet(path)
        jvm_path, files = self._jvm_path(path)
        files.deleteOnExit(jvm_path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            jvm_path, files = self._jvm_path(self.paths.pop(id(frame)))
            files.delete(jvm_path, True)


def parts_for(total: int, each: int) -> int:
    """How many parts of ``each`` hold ``total``, one at least."""
    return max(1, math.ceil(total / each))


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads; a null text counts as empty."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        *more,
    )


def batch_of(schema: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
