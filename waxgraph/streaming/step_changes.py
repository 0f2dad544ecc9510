"""Keyed state over the step log: what changed, and what has been running for too long.

Each step keeps its last record. A batch gives a row for every step whose last record it
changed, and for every step that is still running when its timer goes off. Timers go by
the clock of the machine, not by the log: a build that hangs writes no more records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from waxgraph import fixed
from waxgraph.sources.step_log import stream_steps

FIELDS = ["of", "name", "state", "elapsed", "ts"]
_STATE = "of int, name string, state string, elapsed long, ts string"
CHANGES = f"n int, {_STATE}, stalled boolean"
# State of this kind is kept by the one provider that has timers.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
STALLED_AFTER_MS = 30 * 60 * 1000


def _order(record: tuple) -> tuple:
    """Later time wins; of one second, the state further on."""
    of, name, state, elapsed, ts = record
    return (ts is not None, ts or "", fixed.STEP_RANK.get(state, -1))


class LastRecords(StatefulProcessor):
    """One value per step, and a timer while it runs."""

    def __init__(self, stalled_after_ms: int):
        self.stalled_after_ms = stalled_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def _row(self, key: tuple, record: tuple, stalled: bool) -> pd.DataFrame:
        return pd.DataFrame({"n": [key[0]], **{f: [v] for f, v in zip(FIELDS, record)}, "stalled": [stalled]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        best = before
        for batch in rows:
            for record in batch[FIELDS].astype(object).where(batch[FIELDS].notna(), None).itertuples(index=False, name=None):
                if best is None or _order(record) > _order(best):
                    best = record
        if best == before:
            return
        self.last.update(tuple(None if v is None else int(v) if f in ("of", "elapsed") else v for f, v in zip(FIELDS, best)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if best[2] == "running":
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stalled_after_ms)
        yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and (record := tuple(self.last.get()))[2] == "running":
            yield self._row(key, record, True)

    def close(self) -> None:
        pass


def changes(spark: SparkSession, folder: str, stalled_after_ms: int = STALLED_AFTER_MS) -> DataFrame:
    """A stream of (n, of, name, state, elapsed, ts, stalled), started under ``STATE_SETTINGS``."""
    steps = stream_steps(spark, folder).select("n", *FIELDS)
    return steps.groupBy("n").transformWithStateInPandas(
        LastRecords(stalled_after_ms), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime"
    )


def watch_changes(
    spark: SparkSession, folder: str, out: str, checkpoint: str, stalled_after_ms: int = STALLED_AFTER_MS, **trigger: object
) -> StreamingQuery:
    """Write the changed and the stalled steps of every batch, to a folder of its own.

    With a trigger by time, batches go on while the log is silent, and a timer that goes
    off is reported then. A run over what is there (the default) ends with the log: its
    timers go off with the next run that finds new records.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{out}/changes/batch={batch}")

    trigger = trigger or {"availableNow": True}
    # Timers by the clock always ask for one more batch, so a run that is to end must not have such.
    settings = {**STATE_SETTINGS, NO_DATA: str("availableNow" not in trigger).lower()}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer = changes(spark, folder, stalled_after_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return writer.foreachBatch(write).trigger(**trigger).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def state_of(spark: SparkSession, out: str) -> DataFrame:
    """(n, of, name, state, elapsed, ts, stalled): where all steps stand, from the changes written."""
    rows = spark.read.schema(f"{CHANGES}, batch long").json(f"{out}/changes")
    newest = Window.partitionBy("n").orderBy(F.col("batch").desc(), F.col("stalled").desc())
    return rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("n", *FIELDS, "stalled")
