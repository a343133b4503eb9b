"""Files in and out: case records, PDFs, markdown versions, graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statvine.operators.graph import audit, require_whole
from statvine.operators.structure import chunked
from statvine.sources.shared import stash

CASE = "id string, record_id string, title string, body string, text string, source_url string"


def read_cases(spark: SparkSession, path: str, names: str = "[!.]*.json*") -> DataFrame:
    """id, title, body of JSON-lines case records of either dialect; hidden files, blank and malformed lines are skipped."""
    rows = spark.read.schema(CASE).option("mode", "DROPMALFORMED").option("pathGlobFilter", names).json(path)
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    return rows.select(first("id", "record_id").alias("id"), "title", first("body", "text").alias("body")).where("id <> ''")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """chapter_number, title, download_id, text of files ``8_08_Some_Title/123.md``."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.md").text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    slug = r"([0-9]{1,3})_([0-9]{2,3})_([^/]+)/([0-9]+)\.md$"
    part = lambda k: F.regexp_extract("path", slug, k)
    return rows.select(F.concat_ws(":", part(1), part(2)).alias("chapter_number"), F.translate(part(3), "_", " ").alias("title"), part(4).try_cast("long").alias("download_id"), "text").where("download_id is not null")


def sections(versions: DataFrame) -> DataFrame:
    """A row for each section and schedule of ``text``, addressable by section_ref; part, schedule, heading, chunk_index, chunk_text."""
    return chunked(versions, *(c for c in versions.columns if c != "text"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Nodes, edges and ``meta`` (their numbers, by type and evidence too); a dangling edge is an error and nothing is written.

    Nodes and edges are evaluated once; the numbers of rows are taken while they are written, those by type from the written columns.
    """
    nodes, edges = stash(nodes, "graph-nodes"), stash(edges, "graph-edges")
    require_whole(nodes, edges)
    seen = {}
    for name, rows in (("nodes", nodes), ("edges", edges)):
        seen[name] = Observation()
        rows.observe(seen[name], F.count(F.lit(1)).alias("n")).write.mode("overwrite").format(form).save(f"{path}/{name}")
    meta(nodes, edges, {name: o.get["n"] for name, o in seen.items()}).write.mode("overwrite").json(f"{path}/meta")


def meta(nodes: DataFrame, edges: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """One row: nodes, edges, and maps node_types, edge_types, evidence."""
    counts = audit(nodes, edges)
    of = lambda what: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("type", "n")))))
    maps = counts.where("type is not null").agg(of("node").alias("node_types"), of("edge").alias("edge_types"), of("evidence").alias("evidence"))  # a row a type
    return maps.select(F.lit(numbers["nodes"]).cast("long").alias("nodes"), F.lit(numbers["edges"]).cast("long").alias("edges"), "node_types", "edge_types", "evidence")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    kinds = "map<string, long>"
    return spark.read.schema(f"nodes long, edges long, node_types {kinds}, edge_types {kinds}, evidence {kinds}").json(f"{path}/meta")


def read_graph(spark: SparkSession, path: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    return spark.read.format(form).load(f"{path}/nodes"), spark.read.format(form).load(f"{path}/edges")


def write_clusters(members: DataFrame, audit: DataFrame, path: str) -> None:
    """The members of communities (community, size, id) and the graph's counts, as JSON lines."""
    members.write.mode("overwrite").json(f"{path}/clusters")
    audit.write.mode("overwrite").json(f"{path}/graph")


def write_case_edges(edges: DataFrame, report: DataFrame, path: str) -> None:
    """Case citations and their report, as JSON lines."""
    edges.write.mode("overwrite").json(f"{path}/edges")
    report.write.mode("overwrite").json(f"{path}/meta")
