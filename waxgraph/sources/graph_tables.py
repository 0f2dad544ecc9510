"""Graph tables on disk: Parquet for work, CSV for interchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from waxgraph import fixed, schemas
from waxgraph.functions import text as X
from waxgraph.operators.adjacency import NODE, degrees
from waxgraph.operators.flatten import edge_row, node_row
from waxgraph.session import settle

LINE_END = "\r\n"
# White space at the ends of a text belongs to the text.
KEEP_SPACE = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE = {"header": "true", "escape": '"', "lineSep": LINE_END, **KEEP_SPACE}
CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', **KEEP_SPACE}


class MissingInput(FileNotFoundError):
    """One of the nine tables of an interchange set is not there."""


def write_graph(nodes: DataFrame, edges: DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Nodes by kind and edges by type; an existing output is refused by default."""
    nodes.write.mode(mode).partitionBy("kind").parquet(f"{out}/nodes")
    edges.write.mode(mode).partitionBy("type").parquet(f"{out}/edges")


def read_graph(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema(schemas.NODES).parquet(f"{out}/nodes")
    edges = spark.read.schema(schemas.EDGES).parquet(f"{out}/edges")
    return nodes.select(*schemas.NODES.names), edges.select(*schemas.EDGES.names)


# The second generation of the Parquet reader can count without a column.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_counts(spark: SparkSession, out: str) -> DataFrame:
    """(kind, n) of the nodes by kind and the edges by type of a stored graph.

    The numbers of rows stand in the footers of the files and the kind in their folder, so
    not one column is read.
    """
    before = {key: spark.conf.get(key) for key in FOOTER_SETTINGS}
    try:
        for key, value in FOOTER_SETTINGS.items():
            spark.conf.set(key, value)
        return settle(_counted(spark, out))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _counted(spark: SparkSession, out: str) -> DataFrame:
    def by(path: str, schema: T.StructType, column: str) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{out}/{path}")
        return rows.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n"))

    return by("nodes", schemas.NODES, "kind").unionByName(by("edges", schemas.EDGES, "type"))


def _write_quoted(df: DataFrame, path: str) -> None:
    """CSV in which every text is quoted and a null is not, so that an empty text
    and no text stay apart. Every part file starts with the header.

    The CSV writer can quote all values or few, but not all except nulls, so the
    lines are put together here. The low 33 bits of the row id count the rows of
    a task, and a task writes one file.
    """

    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    fields = [F.coalesce(quoted(F.col(f"`{name}`")), F.lit("")) for name in df.columns]
    header = ",".join(f'"{name}"' for name in df.columns) + LINE_END
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    line = F.concat(F.when(first, header).otherwise(""), F.concat_ws(",", *fields))
    lines = df.select(line.alias("value"))
    # A limit on records per file would start further files without a header.
    lines.write.mode("errorifexists").options(lineSep=LINE_END, maxRecordsPerFile=0).text(path)


def write_node_csv(kind: str, rows: DataFrame, out: str) -> None:
    """One node table under its interchange header.

    ``rows`` has the columns of the header in order, with text as the dump had
    it: a missing element is written as an empty string, an empty one as null.
    """
    folder, header = fixed.NODE_FILES[kind]
    columns = [F.col(rows.columns[0])] + [X.csv_text(F.col(name)) for name in rows.columns[1:]]
    _write_quoted(rows.select(*columns).toDF(*header), f"{out}/{folder}")


def write_edge_csv(edge_type: str, edges: DataFrame, out: str) -> None:
    folder, header = fixed.EDGE_FILES[edge_type]
    rows = edges.where(F.col("type") == edge_type).select("src", "dst")
    _write_quoted(rows.toDF(*header), f"{out}/{folder}")


def write_csv_set(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    """All nine tables from a finished graph."""
    for kind in fixed.KINDS:
        columns = {"Artist": ("id", "name", "realname", "profile"), "Release": ("id", "year", "title")}
        chosen = columns.get(kind, ("id", "name", "profile"))
        write_node_csv(kind, nodes.where(F.col("kind") == kind).select(*chosen), out)
    for edge_type in fixed.EDGE_TYPES:
        write_edge_csv(edge_type, edges, out)


def write_labels_csv(labels: DataFrame, out: str) -> None:
    """The merged label table on its own: (id, name, profile)."""
    folder, header = fixed.NODE_FILES["Label"]
    _write_quoted(labels.select("id", "name", "profile").toDF(*header), f"{out}/{folder}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_csv_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from the nine tables; raises if one is missing.

    A table may be a folder of part files or a single ``.csv`` file.
    """
    found = {}
    for name, header in [*fixed.NODE_FILES.values(), *fixed.EDGE_FILES.values()]:
        options = [path for path in (f"{folder}/{name}", f"{folder}/{name}.csv") if _exists(spark, path)]
        if not options:
            raise MissingInput(f"{folder}/{name}")
        schema = ", ".join(f"`{column}` string" for column in header)
        found[name] = spark.read.options(**CSV_READ).schema(schema).csv(options[0])
    nodes, edges = [], []
    for kind, (name, header) in fixed.NODE_FILES.items():
        texts = {column: F.col(f"`{column}`") for column in header[1:]}
        nodes.append(found[name].select(*node_row(kind, F.col(f"`{header[0]}`"), **texts)))
    for edge_type, (name, header) in fixed.EDGE_FILES.items():
        src, dst = (F.col(f"`{column}`") for column in header)
        # Rows of a table have no order of their own; parallel rows stay apart.
        edges.append(found[name].select(*edge_row(edge_type, src, dst, F.monotonically_increasing_id())))
    all_nodes, all_edges = nodes[0], edges[0]
    for table in nodes[1:]:
        all_nodes = all_nodes.unionByName(table)
    for table in edges[1:]:
        all_edges = all_edges.unionByName(table)
    return all_nodes, all_edges


def search_export(nodes: DataFrame, kinds: Sequence[str] = fixed.KINDS) -> DataFrame:
    """(type, id, name) of the chosen kinds, rows without a visible name left out."""
    unknown = [kind for kind in kinds if kind not in fixed.KINDS]
    if unknown:
        raise ValueError(f"unknown kinds {unknown}, choose from {list(fixed.KINDS)}")
    name = F.when(F.col("kind") == "Release", F.col("title")).otherwise(F.col("name"))
    chosen = nodes.where(F.col("kind").isin(*kinds)).select(
        F.col("kind").alias("type"), "id", name.alias("name")
    )
    return chosen.where(X.has_text(F.col("name")))


def skipped_names(nodes: DataFrame) -> DataFrame:
    """How many rows of each kind the export leaves out."""
    name = F.when(F.col("kind") == "Release", F.col("title")).otherwise(F.col("name"))
    return nodes.groupBy(F.col("kind").alias("type")).agg(F.count_if(~X.has_text(name)).alias("skipped"))


def write_search_export(
    nodes: DataFrame, out: str, kinds: Sequence[str] = fixed.KINDS, gzip: bool = False
) -> None:
    options = {**CSV_WRITE, "compression": "gzip" if gzip else "none"}
    search_export(nodes, kinds).write.mode("errorifexists").options(**options).csv(out)


def trimmed_export(
    nodes: DataFrame, edges: DataFrame, kinds: Sequence[str], least_degree: int
) -> DataFrame:
    """The search export of some kinds without their hardly connected nodes.

    Releases can be reached through their artists, so leaving them out costs
    little and saves much.
    """
    known = degrees(edges).where(F.col("degree") >= least_degree).select(*NODE)
    return search_export(nodes.join(known, NODE, "left_semi"), kinds)


def name_shards(exported: DataFrame, width: int = 2) -> DataFrame:
    """Export rows with the prefix of their name they are looked up under."""
    return exported.withColumn("prefix", F.lower(F.substring("name", 1, width)))


def write_name_shards(exported: DataFrame, out: str, width: int = 2) -> None:
    """One folder per prefix, JSON rows.

    Range partitioning on prefix and name keeps the number of files per folder
    low and still splits a prefix that holds a large part of all names.
    """
    sharded = name_shards(exported, width)
    sharded.repartitionByRange("prefix", "name", "id").write.mode("errorifexists").partitionBy(
        "prefix"
    ).json(out)


def write_report(report: DataFrame, out: str) -> None:
    report.write.mode("overwrite").json(out)


def write_rejects(rejects: DataFrame, out: str, show: int = 5) -> tuple[int, list]:
    """Write rows set aside; return how many there are and the first few."""
    rejects.write.mode("errorifexists").parquet(out)
    written = rejects.sparkSession.read.parquet(out)
    return written.count(), written.limit(show).collect()
