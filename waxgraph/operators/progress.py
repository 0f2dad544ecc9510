"""Where a build stands, from its step log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waxgraph import fixed


def state_rank(state: Column) -> Column:
    """Breaks ties between records of one second: a step only moves forward."""
    chain = None
    for name, rank in fixed.STEP_RANK.items():
        chain = F.when(state == name, rank) if chain is None else chain.when(state == name, rank)
    return F.coalesce(chain, F.lit(-1))


def latest_steps(records: DataFrame, *tie: str) -> DataFrame:
    """(n, of, name, state, elapsed, ts): the last record of every step.

    An ordinary aggregate, so it runs on a stream as it does on a table. ``tie``
    names columns to decide between records equal in time and state.
    """
    order = F.struct("ts", state_rank(F.col("state")), *tie)
    last = F.max_by(F.struct("of", "name", "state", "elapsed", "ts"), order)
    return records.groupBy("n").agg(last.alias("last")).select("n", "last.*")


def summary(steps: DataFrame) -> DataFrame:
    """One row about all steps: how many, how far, whether one failed."""
    settled = F.col("state").isin(*fixed.SETTLED_STATES)
    running = F.col("state") == "running"
    row = steps.agg(
        F.coalesce(F.min_by("of", "n"), F.lit(0)).alias("total"),
        F.count_if(settled).alias("done"),
        F.coalesce(F.bool_or(F.col("state") == "failed"), F.lit(False)).alias("failed"),
        F.min_by(F.when(running, F.col("name")), F.when(running, F.col("n"))).alias("running"),
        F.coalesce(F.sum(F.when(F.col("state") == "done", F.col("elapsed"))), F.lit(0)).alias("elapsed"),
    )
    finished = (F.col("total") > 0) & (F.col("done") >= F.col("total")) & ~F.col("failed")
    return row.withColumn("finished", finished)
