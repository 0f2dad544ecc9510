"""Live build status from a growing step log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from waxgraph.operators.progress import latest_steps, summary
from waxgraph.sources.step_log import stream_steps


def live_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Latest record per step; the state kept is one row per step."""
    return latest_steps(stream_steps(spark, folder))


def watch(
    spark: SparkSession, folder: str, out: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Write the steps and their summary after every batch of new records.

    Each batch owns the folder named after it, so writing it again after a lost
    task or a restart leaves the same files.
    """

    def write(steps: DataFrame, batch: int) -> None:
        path = f"{out}/steps/batch={batch}"
        steps.write.mode("overwrite").json(path)
        written = steps.sparkSession.read.schema(steps.schema).json(path)
        summary(written).write.mode("overwrite").json(f"{out}/summary/batch={batch}")

    writer = live_steps(spark, folder).writeStream.outputMode("complete")
    writer = writer.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
