"""Statistics, integrity checks, progress and its stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests import graphs
from tests.conftest import rows_of
from waxgraph import fixed
from waxgraph.operators import integrity, latest, progress, stats
from waxgraph.plans.report import graph_report
from waxgraph.sources import graph_tables
from waxgraph.sources.step_log import read_steps
from waxgraph.streaming import step_changes
from waxgraph.streaming.build_status import live_steps, watch


def test_counts_keep_what_does_not_occur(spark):
    nodes, edges = graphs.frames(spark, [graphs.node("Artist", 1)], [graphs.edge("ALIAS_OF", 1, 1)])
    assert rows_of(stats.node_counts(nodes)) == [("Artist", 1), ("Group", 0), ("Label", 0), ("Release", 0)]
    assert dict(rows_of(stats.edge_counts(edges)))["CREDITED"] == 0
    # The list of types is a choice: one report leaves aliases out.
    chosen = [t for t in fixed.EDGE_TYPES if t != "ALIAS_OF"]
    assert sum(n for _, n in rows_of(stats.edge_counts(edges, chosen))) == 0


def test_shares_of_an_empty_graph_do_not_divide_by_zero(spark):
    nodes, edges = graphs.frames(spark, [], [])
    rows = {(r.section, r.key): (r.value, r.share) for r in stats.graph_shares(nodes, edges).collect()}
    assert rows["nodes", "Artist"] == (0.0, 0.0)
    assert rows["ratios", "edges per node"] == (None, None)


def test_decades_take_the_first_three_characters_of_any_year(spark):
    years = [("1995-08-07",), ("1991",), ("199",), (None,), ("19?? or so",), ("2001",)]
    found = stats.decades(spark.createDataFrame(years, "year string"))
    assert rows_of(stats.with_bars(found)) == [("1990s", 2, 32), ("19?0s", 1, 16), ("2000s", 1, 16)]


def test_hubs(spark):
    rows, links = graphs.random_graph(6)
    nodes, edges = graphs.frames(spark, rows, links)
    degree = {key: len(near) for key, near in graphs.adjacency(links).items()}
    for kind in fixed.KINDS:
        own = [r for r in rows if r[1] == kind]
        want = sorted(((degree.get((r[0], r[2]), 0), r) for r in own), key=lambda x: (-x[0], x[1][3]))[:3]
        found = stats.hubs(nodes, edges, 3).where(F.col("kind") == kind).orderBy("position").collect()
        assert [(r.degree, r.id) for r in found] == [(d, r[2]) for d, r in want]


def test_orphans(spark):
    nodes, edges = graphs.frames(
        spark, [graphs.node("Artist", i) for i in range(4)] + [graphs.node("Label", 1)], [graphs.edge("ALIAS_OF", 1, 1)]
    )
    assert rows_of(stats.orphans(nodes, edges)) == [
        ("Artist", 3, 4, 75.0), ("Group", 0, 0, 0.0), ("Label", 1, 1, 100.0), ("Release", 0, 0, 0.0),
    ]


def test_report_is_one_table(spark, tmp_path):
    nodes, edges = graphs.frames(spark, *graphs.random_graph(7))
    report = stats.flat_report({"nodes": stats.node_counts(nodes), "hubs": stats.hubs(nodes, edges, 1)})
    graph_tables.write_report(report, f"{tmp_path}/report")
    back = spark.read.json(f"{tmp_path}/report")
    counts = [json.loads(r.row) for r in back.where("section = 'nodes'").collect()]
    assert {"kind": "Artist", "n": 14} in counts and back.where("section = 'hubs'").count() == 4


def test_a_failing_section_costs_only_itself(spark, tmp_path):
    nodes, edges = graphs.frames(spark, *graphs.random_graph(8))
    broken = F.when(F.length("title") > 0, F.raise_error(F.lit("no year today")).cast("string"))
    steps = progress.latest_steps(read_steps(spark, log_file(tmp_path / "log", "a.jsonl", LOG)))
    report = graph_report(nodes.withColumn("year", broken), edges, steps=steps, deep=True)
    sections = {}
    for section, row in report.collect():
        sections.setdefault(section, []).append(json.loads(row))
    assert set(sections) == {"shares", "build", "progress", "hubs", "orphans", "errors"}
    assert sections["errors"][0]["name"] == "decades" and len(sections["errors"]) == 1
    assert sections["build"][0] == {"n": 1, "name": "one", "state": "done", "elapsed": 7, "time": "7s"}


def test_a_short_report_does_not_scan(spark):
    nodes, edges = graphs.frames(spark, *graphs.random_graph(9))
    files = spark.createDataFrame([("a.xml.gz", 2048, 7, "20260801")], "file string, bytes long, rows long, dump_date string")
    rows = graph_report(nodes, edges, files=files).collect()
    assert {row.section for row in rows} == {"shares", "files"}
    assert json.loads(next(row.row for row in rows if row.section == "files"))["size"] == "2.0 KiB"


def test_the_same_id_in_two_spaces_is_no_match(spark):
    nodes, edges = graphs.frames(
        spark, [graphs.node("Release", 1), graphs.node("Artist", 2)], [graphs.edge("CREDITED", 1, 1), graphs.edge("CREDITED", 2, 1)]
    )
    bad = integrity.dangling_edges(edges, nodes)
    assert rows_of(bad, "src", "src_missing", "dst_missing") == [("1", True, False)]
    assert rows_of(integrity.good_edges(edges, nodes), "src") == [("2",)]
    assert integrity.check_tolerance(bad, 1) == 1
    with pytest.raises(integrity.TooManyBadEdges):
        integrity.check_tolerance(bad, 0)


def test_repeats(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate("abacab")], "pos long, id string")
    assert rows_of(integrity.repeat_positions(rows, ["id"], "pos"), "id", "pos") == [("a", 2), ("a", 4), ("b", 5)]
    assert rows_of(integrity.repeated_ids(rows, ["id"])) == [("a", 3), ("b", 2)]
    nodes, _ = graphs.frames(
        spark, [graphs.node("Artist", 1), graphs.node("Group", 1), graphs.node("Label", 1), graphs.node("Label", 1)], []
    )
    assert dict(rows_of(integrity.node_repeats(nodes))) == {
        "Artist": 0, "Group": 0, "Label": 1, "space:entity": 1, "space:label": 1,
    }


def test_last_write_and_top(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, pos int, v string")
    assert rows_of(latest.last_write(rows, ["id"], [F.col("pos")]), "id", "v") == [(1, "b"), (2, "c")]
    assert latest.top_per(rows, ["id"], [F.col("pos").asc()], 1).count() == 2


LOG = [
    '{"n":1,"of":3,"name":"one","state":"pending","elapsed":0,"ts":"2026-08-01T00:00:00Z"}',
    '{"n":2,"of":3,"name":"two","state":"pending","elapsed":0,"ts":"2026-08-01T00:00:00Z"}',
    "",
    "not json {",
    '{"of":3,"name":"no number","state":"done","elapsed":9,"ts":"2026-08-01T00:00:05Z"}',
    '{"n":1,"of":3,"name":"one","state":"running","elapsed":0,"ts":"2026-08-01T00:00:01Z"}',
    '{"n":1,"of":3,"name":"one","state":"done","elapsed":7,"ts":"2026-08-01T00:00:01Z"}',
]
MORE = [
    '{"n":3,"of":3,"name":"three","state":"skipped","elapsed":0,"ts":"2026-08-01T00:00:02Z"}',
    '{"n":2,"of":3,"name":"two","state":"running","elapsed":0,"ts":"2026-08-01T00:00:03Z"}',
]
LAST = ['{"n":2,"of":3,"name":"two","state":"done","elapsed":5,"ts":"2026-08-01T00:00:09Z"}']


def log_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_progress(spark, tmp_path):
    steps = progress.latest_steps(read_steps(spark, log_file(tmp_path / "log", "a.jsonl", LOG)))
    assert rows_of(steps, "n", "state", "elapsed") == [(1, "done", 7), (2, "pending", 0)]
    row = progress.summary(steps).first().asDict()
    assert row == {"total": 3, "done": 1, "failed": False, "running": None, "elapsed": 7, "finished": False}


def test_progress_of_nothing_and_of_a_failure(spark):
    schema = "n int, of int, name string, state string, elapsed long, ts string"
    row = progress.summary(spark.createDataFrame([], schema)).first()
    assert (row.total, row.done, row.failed, row.finished, row.elapsed) == (0, 0, False, False, 0)
    row = progress.summary(spark.createDataFrame([(1, 1, "a", "failed", 3, "t")], schema)).first()
    assert row.failed and not row.finished and row.elapsed == 0


def test_the_stream_ends_where_the_table_does(spark, tmp_path):
    folder = tmp_path / "log"
    log_file(folder, "a.jsonl", LOG)
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run():
        watch(spark, str(folder), out, checkpoint).awaitTermination()

    run()
    first = spark.read.json(f"{out}/steps/batch=0")
    assert rows_of(first, "n", "state") == [(1, "done"), (2, "pending")]
    log_file(folder, "b.jsonl", MORE)
    run()
    summary = spark.read.json(f"{out}/summary/batch=1").first()
    assert (summary.running, summary.done, summary.finished) == ("two", 2, False)
    log_file(folder, "c.jsonl", LAST)
    run()
    assert spark.read.json(f"{out}/summary/batch=2").first().finished
    batch = progress.latest_steps(read_steps(spark, str(folder)))
    streamed = spark.read.json(f"{out}/steps/batch=2")
    columns = ["n", "of", "name", "state", "elapsed", "ts"]
    assert rows_of(streamed, *columns) == rows_of(batch, *columns)


def test_live_steps_is_a_stream(spark, tmp_path):
    assert live_steps(spark, log_file(tmp_path / "log", "a.jsonl", LOG)).isStreaming


def test_changes_of_steps_over_restarts_late_records_and_a_stalled_step(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "log", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    columns = ["n", "of", "name", "state", "elapsed", "ts"]

    def run(name, lines, after_ms=3_600_000):
        log_file(folder, name, lines)
        step_changes.watch_changes(spark, str(folder), out, checkpoint, after_ms).awaitTermination()
        newest = max(os.listdir(f"{out}/changes"), key=lambda d: int(d.split("=")[1]))
        written = spark.read.schema(step_changes.CHANGES).json(f"{out}/changes/{newest}")
        batch = progress.latest_steps(read_steps(spark, str(folder)))
        assert rows_of(step_changes.state_of(spark, out), *columns) == rows_of(batch, *columns)
        return rows_of(written, "n", "state", "stalled")

    assert run("a.jsonl", LOG) == [(1, "done", False), (2, "pending", False)]
    # Only what changed is written; the timer of the running step is set.
    assert run("b.jsonl", MORE, after_ms=1) == [(2, "running", False), (3, "skipped", False)]
    # Late records change nothing, and by now the step has been running for too long.
    assert run("c.jsonl", [LOG[0], MORE[0], LOG[5]]) == [(2, "running", True)]
    assert [r.n for r in step_changes.state_of(spark, out).where("stalled").collect()] == [2]
    assert run("d.jsonl", LAST) == [(2, "done", False)]
    assert step_changes.state_of(spark, out).where("stalled").count() == 0
