"""A prepared graph on disk: five tables and a manifest, published at once and checked again when opened.

The manifest has the rows of each table and a sum of row hashes that does not depend on their order, so a table that
changed after publication is found even when nothing else of it is checked.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, PublicationError
from ..operators import graph as G
from ..operators import tasks as T
from ..plans.pagerank import Graph
from ..plans.scratch import Scratch
from ..schema import COMPACT_EDGES, DEGREES, TASKS, VERTICES

TABLES = {"vertices": VERTICES, "in_edges": COMPACT_EDGES, "in_degree": DEGREES, "out_degree": DEGREES, "tasks": TASKS}
MANIFEST = "manifest"
KEYS = {"vertex_count", "edge_count", "edge_slice_size", "max_task_edges", "max_task_vertices", "files"}


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def check_bundle(vertices: DataFrame, edges: DataFrame, in_degrees: DataFrame, out_degrees: DataFrame, tasks: DataFrame, limits: T.TaskLimits) -> None:
    """Raise for tables that do not make a well-formed graph."""
    found = G.graph_invariants(vertices, edges, in_degrees, out_degrees).unionByName(T.task_validation(tasks, in_degrees, limits))
    bad = [r["name"] for r in found.where("violations > 0").collect()]
    if bad:
        raise DataError(f"graph is malformed: {', '.join(bad)}")
    if G.out_degree_audit(edges, out_degrees).limit(1).count():
        raise DataError("out-degrees differ from the edges")


def table_sums(tables: dict[str, DataFrame]) -> list[dict]:
    """name, rows, checksum of each table: the sum of 64-bit row hashes modulo 2**64, in hexadecimal."""
    found = []
    for name, df in tables.items():
        row = F.xxhash64(*df.columns)
        sums = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.shiftrightunsigned(row, k).bitwiseAND(0xFFFFFFFF)), F.lit(0)).alias(f"s{k}") for k in (0, 32))).first()
        found.append({"name": name, "rows": sums["n"], "checksum": f"{(sums['s0'] + (sums['s32'] << 32)) % (1 << 64):016x}"})
    return found


def move_to(spark: SparkSession, source: str, target: str) -> None:
    """Rename in one step of the file system; an existing target is an error, never replaced and never moved into."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    place = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), place, never)
    except Py4JJavaError as e:
        if "Exists" in e.java_exception.getClass().getName():
            raise PublicationError(f"output exists: {target}", "target_exists") from None
        raise


def publish_graph(graph: Graph, path: str, limits: T.TaskLimits = T.TaskLimits()) -> None:
    """Write a graph beside its place, check what was written, and rename it; an existing path is never replaced."""
    spark = graph.edges.sparkSession
    target, files = _files(spark, path)
    if files.exists(target):
        raise PublicationError(f"output exists: {path}", "target_exists")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    degrees = graph.in_degrees()
    frames = {"vertices": graph.vertices, "in_edges": G.sorted_in_edges(graph.edges).select("dst_idx", "src_idx"), "in_degree": degrees, "out_degree": graph.out_degrees, "tasks": T.task_partition(degrees, limits)}
    try:
        for name, df in frames.items():
            df.write.parquet(f"{staging}/{name}")
        row = G.graph_manifest(graph.vertices, graph.edges, limits.edge_slice_size, limits.max_task_edges, limits.max_task_vertices).first()
        written = {name: spark.read.schema(schema).parquet(f"{staging}/{name}") for name, schema in TABLES.items()}
        row = {**row.asDict(), "files": table_sums(written)}
        spark.createDataFrame([(G.encode_manifest(row)[:-1],)], "value string").coalesce(1).write.text(f"{staging}/{MANIFEST}")
        open_graph(spark, staging)
        move_to(spark, staging, path)
    finally:
        place, _ = _files(spark, staging)
        files.delete(place, True)


def read_manifest(spark: SparkSession, path: str) -> dict:
    lines = [r["value"] for r in spark.read.text(f"{path}/{MANIFEST}").limit(2).collect()]
    try:
        found = G.parse_manifest("\n".join(lines) + "\n")
        if not isinstance(found, dict) or not KEYS <= set(found):
            raise ValueError("manifest lacks keys")
        return found
    except ValueError as e:
        raise DataError(str(e)) from None


def open_graph(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """A published graph whose tables are those that were written; with ``check`` every invariant is proved again."""
    manifest = read_manifest(spark, path)
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}
    if table_sums(tables) != manifest["files"]:
        raise DataError("tables differ from the manifest")
    if check:
        limits = T.TaskLimits(manifest["edge_slice_size"], manifest["max_task_edges"], manifest["max_task_vertices"])
        counts = tables["vertices"].agg(F.count("*")).first()[0], tables["in_edges"].agg(F.count("*")).first()[0]
        if counts != (manifest["vertex_count"], manifest["edge_count"]):
            raise DataError("counts differ from the manifest")
        check_bundle(tables["vertices"], tables["in_edges"], tables["in_degree"], tables["out_degree"], tables["tasks"], limits)
    return Graph(tables["vertices"], tables["in_edges"], tables["out_degree"], manifest["vertex_count"], Scratch(spark, "graph"))
