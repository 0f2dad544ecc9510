"""From four dumps to a checked graph on disk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from waxgraph import fixed
from waxgraph.operators import aliases, flatten, integrity, labels as label_ops
from waxgraph.sources import graph_tables, release_store, xml_dumps


@dataclass(frozen=True)
class Dumps:
    """Paths of the dumps, plain or gzip; any may be a folder or a pattern."""

    artists: str
    labels: str
    masters: str
    releases: str


@dataclass(frozen=True)
class BuildReport:
    scanned_releases: int
    wanted_releases: int
    missing_releases: int
    rejected_records: int
    bad_edges: int


def _land(screened: DataFrame, path: str) -> DataFrame:
    screened.write.mode("errorifexists").parquet(path)
    return screened.sparkSession.read.parquet(path)


def land_records(
    spark: SparkSession, path: str, tag: str, stage: str, partitions: int | None = None
) -> DataFrame:
    """Parse a dump once into Parquet; later steps read only the columns they use."""
    records = xml_dumps.read_records_spread(spark, path, tag, partitions)
    return _land(xml_dumps.screen(records, tag), f"{stage}/{tag}")


def land_releases(
    spark: SparkSession, path: str, wanted: DataFrame, stage: str
) -> tuple[DataFrame, int]:
    """The releases named in ``wanted`` and how many records the dump holds.

    The id is read off the opening tag and only wanted texts go further, so
    parsing, by far the dearest part, is done for those alone. ``wanted`` goes to every
    cutting task as a bitmap, so no other text is shuffled at any size. Of a release given
    twice the last accepted copy is taken; copies set aside and texts whose id is no
    number stay as rejects. The shuffle by id also spreads the parsing.
    """
    seen = Observation()
    texts = xml_dumps.read_texts(spark, path, "release")
    texts = texts.observe(seen, F.count(F.lit(1)).alias("scanned"))
    kept = release_store.wanted_texts(release_store.keyed_texts(texts), wanted)
    # Texts without a number are spread by their place.
    spread = kept.repartition("id", F.when(F.col("id").isNull(), F.xxhash64("place")))
    screened = xml_dumps.screen(xml_dumps.parse_texts(spread, "release"), "release")
    copies = Window.partitionBy("id", F.when(F.col("reject").isNotNull(), F.col("place"))).orderBy(F.col("place").desc())
    last = screened.withColumn("nth", F.row_number().over(copies)).where("nth = 1").drop("nth", "id")
    return _land(last, f"{stage}/release"), seen.get["scanned"]


def label_sightings(labels: DataFrame, releases: DataFrame) -> DataFrame:
    """Every mention of a label: its record, as a sublabel, on a release."""
    return (
        label_ops.dump_sightings(labels)
        .unionByName(label_ops.sublabel_sightings(flatten.sublabels(labels)))
        .unionByName(label_ops.release_sightings(flatten.listed_labels(releases)))
    )


def graph_of(
    artists: DataFrame,
    labels: DataFrame,
    releases: DataFrame,
    placeholders: tuple[str, ...] = fixed.PLACEHOLDER_IDS,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of accepted records, edges not yet checked."""
    listed = flatten.listed_labels(releases)
    nested = flatten.sublabels(labels)
    entries = flatten.alias_entries(artists)
    pairs = aliases.pairs(entries, F.struct("place", "item_no"))
    nodes = flatten.all_nodes(
        flatten.entity_nodes(artists),
        flatten.release_nodes(releases),
        label_ops.label_nodes(label_ops.merge(label_sightings(labels, releases))),
    )
    edges = (
        flatten.member_edges(artists)
        .unionByName(flatten.credited_edges(flatten.credit_entries(releases, placeholders)))
        .unionByName(flatten.released_on_edges(listed))
        .unionByName(flatten.sublabel_edges(nested))
        .unionByName(aliases.alias_edges(pairs))
    )
    return nodes, edges


def build_graph(
    spark: SparkSession,
    dumps: Dumps,
    out: str,
    partitions: int | None = None,
    tolerance: int = fixed.BAD_EDGE_TOLERANCE,
) -> BuildReport:
    """Build the graph under ``out``: stage/, nodes/, edges/, bad_edges/, rejects/.

    Refuses an output that exists. Raises before any node or edge is written
    when more edges dangle than the tolerance allows.
    """
    stage = f"{out}/stage"
    paths = {"label": dumps.labels, "artist": dumps.artists, "master": dumps.masters}
    screened = {tag: land_records(spark, path, tag, stage, partitions) for tag, path in paths.items()}

    wanted = _land(integrity.wanted_ids(xml_dumps.accepted(screened["master"])), f"{stage}/wanted")
    wanted_count = wanted.count()
    screened["release"], scanned = land_releases(spark, dumps.releases, wanted, stage)
    missing = integrity.missing_wanted(screened["release"], wanted).count()

    rejects = None
    for tag, rows in screened.items():
        part = xml_dumps.rejected(rows, tag)
        rejects = part if rejects is None else rejects.unionByName(part)
    usable = {tag: xml_dumps.accepted(rows) for tag, rows in screened.items()}
    rejects = rejects.unionByName(label_ops.unusable(label_sightings(usable["label"], usable["release"])))
    rejected_count, _ = graph_tables.write_rejects(rejects, f"{out}/rejects")

    nodes, edges = graph_of(usable["artist"], usable["label"], usable["release"])
    nodes, edges = _land(nodes, f"{stage}/nodes"), _land(edges, f"{stage}/edges")
    flagged = integrity.flag_edges(edges, nodes)
    bad = _land(flagged.where("src_missing OR dst_missing"), f"{out}/bad_edges")
    bad_count = integrity.check_tolerance(bad, tolerance)
    checked = flagged.where("NOT src_missing AND NOT dst_missing").drop("src_missing", "dst_missing")
    graph_tables.write_graph(nodes, checked, out)
    return BuildReport(scanned, wanted_count, missing, rejected_count, bad_count)
