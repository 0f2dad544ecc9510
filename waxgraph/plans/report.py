"""The report on a built graph: what it holds, what it cost, whether it looks sane."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from waxgraph.functions import text as X
from waxgraph.operators import progress, stats
from waxgraph.session import settle

Section = Callable[[], DataFrame]


def build_times(steps: DataFrame) -> DataFrame:
    """Steps with their time for reading, in order."""
    shown = steps.select("n", "name", "state", "elapsed", X.human_seconds(F.col("elapsed")).alias("time"))
    return shown.orderBy("n")


def file_sizes(files: DataFrame) -> DataFrame:
    """Audited input files with their size for reading."""
    return files.select("file", "bytes", X.human_bytes(F.col("bytes")).alias("size"), "rows", "dump_date")


def graph_report(
    nodes: DataFrame,
    edges: DataFrame,
    steps: DataFrame | None = None,
    files: DataFrame | None = None,
    deep: bool = False,
) -> DataFrame:
    """(section, row): one row of JSON text per line of the report.

    Each section is computed by itself; one that fails leaves a row under
    ``errors`` and costs only itself. ``deep`` adds what has to scan the graph.
    """
    sections: dict[str, Section] = {"shares": lambda: stats.graph_shares(nodes, edges)}
    if steps is not None:
        sections["build"] = lambda: build_times(steps)
        sections["progress"] = lambda: progress.summary(steps)
    if files is not None:
        sections["files"] = lambda: file_sizes(files)
    if deep:
        releases = nodes.where("kind = 'Release'")
        sections["hubs"] = lambda: stats.hubs(nodes, edges)
        sections["orphans"] = lambda: stats.orphans(nodes, edges)
        sections["decades"] = lambda: stats.with_bars(stats.decades(releases))
    done, errors = {}, []
    for name, section in sections.items():
        try:
            done[name] = settle(section())
        except PySparkException as error:
            errors.append((name, f"{type(error).__name__}: {str(error).splitlines()[0]}"))
    if errors:
        done["errors"] = nodes.sparkSession.createDataFrame(errors, "name string, error string")
    return stats.flat_report(done)
