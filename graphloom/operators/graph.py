"""Graph operators: from raw edges to a compact graph, its degrees and its checks.  All are DataFrame plans."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as rows."""
    return edges.select(F.explode(F.array("src", "dst")).alias("vid"))


def distinct_vertices(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges become one; self-loops stay."""
    return edges.select("src", "dst").distinct()


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with the place of each row in the given order, from 0.

    Rows are dealt out by range and sorted in place; the driver only sees one count a partition, so no task and no window
    ever holds them all.
    """
    scratch = Scratch(df.sparkSession, "index")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    code = F.monotonically_increasing_id()
    local = scratch.write(dealt.withColumn("__part", F.shiftright(code, 33)).withColumn("__row", code.bitwiseAND((1 << 33) - 1)), "local")
    counts = {r["__part"]: r["n"] for r in local.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    starts = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __start long")
    return local.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__row")).drop("__part", "__row", "__start")


def compact_vertex_ids(edges: DataFrame) -> DataFrame:
    """vid, idx: the dictionary of vertices in ascending order."""
    found = dense_index(distinct_vertices(edges), ["vid"])
    return found.select("vid", F.col("idx").cast("int").alias("idx"))


def compact_edges(edges: DataFrame, vertices: DataFrame, unique: bool = False) -> DataFrame:
    """dst_idx, src_idx of the distinct edges; ``unique``: they are distinct already.

    Spark broadcasts the dictionary where it is small and sorts otherwise.
    """
    s, d = (vertices.select(F.col("vid").alias(c), F.col("idx").alias(f"{c}_idx")) for c in ("src", "dst"))
    edges = edges if unique else distinct_edges(edges)
    return edges.join(s, "src").join(d, "dst").select("dst_idx", "src_idx")


def dictionary_misses(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Ends of edges that the dictionary lacks."""
    return endpoints(edges).join(vertices, "vid", "left_anti").distinct()


def sorted_in_edges(compact: DataFrame) -> DataFrame:
    """Edges in order of destination and source, dealt out by destination."""
    return compact.repartitionByRange("dst_idx").sortWithinPartitions("dst_idx", "src_idx")


def _degree(compact: DataFrame, vertices: DataFrame, column: str) -> DataFrame:
    counts = compact.groupBy(F.col(column).alias("idx")).agg(F.count("*").alias("degree"))
    return vertices.select("idx").join(counts, "idx", "left").select("idx", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_degree(compact: DataFrame, vertices: DataFrame) -> DataFrame:
    return _degree(compact, vertices, "dst_idx")


def out_degree(compact: DataFrame, vertices: DataFrame) -> DataFrame:
    return _degree(compact, vertices, "src_idx")


def out_degree_audit(compact: DataFrame, stored: DataFrame) -> DataFrame:
    """Vertices whose stored out-degree differs from the histogram of the edges."""
    counts = compact.groupBy(F.col("src_idx").alias("idx")).agg(F.count("*").alias("counted"))
    both = stored.join(counts, "idx", "full_outer").select("idx", F.coalesce("degree", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.where("stored <> counted")


def degree_histogram(degrees: DataFrame) -> DataFrame:
    return degrees.groupBy("degree").agg(F.count("*").alias("vertices"))


def degree_statistics(degrees: DataFrame) -> DataFrame:
    """least, most, mean, edges of a degree table."""
    return degrees.agg(F.min("degree").alias("least"), F.max("degree").alias("most"), F.avg("degree").alias("mean"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"))


def dangling_vertices(out_degrees: DataFrame) -> DataFrame:
    return out_degrees.where("degree = 0").select("idx")


def hub_vertices(in_degrees: DataFrame, edge_slice_size: int) -> DataFrame:
    """Vertices with more incoming edges than a slice holds."""
    return in_degrees.where(F.col("degree") > edge_slice_size)


def self_loops(edges: DataFrame) -> DataFrame:
    return distinct_edges(edges).where("src = dst")


def duplicate_summary(edges: DataFrame) -> DataFrame:
    """input_edges, unique_edges, duplicate_edges."""
    grouped = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return grouped.agg(total.alias("input_edges"), F.count("*").alias("unique_edges"), (total - F.count("*")).alias("duplicate_edges"))


def int32_domain(column: str) -> Column:
    """Whether a text is a canonical decimal of a signed 32-bit integer."""
    text = F.col(column)
    value = F.when(text.rlike(r"\A(0|-?[1-9][0-9]{0,9})\z"), text).cast("long")
    return F.coalesce(value.between(INT_MIN, INT_MAX), F.lit(False))


def graph_invariants(vertices: DataFrame, compact: DataFrame, in_degrees: DataFrame, out_degrees: DataFrame) -> DataFrame:
    """name, violations: what must be 0 for a graph to be well formed."""
    one = lambda df, name, expr: df.agg(F.coalesce(expr, F.lit(0)).cast("long").alias("violations")).select(F.lit(name).alias("name"), "violations")
    n, e = vertices.count(), compact.count()
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    after = vertices.select((F.col("idx") - 1).alias("idx"), F.col("vid").alias("next"))
    pairs = compact.groupBy("dst_idx", "src_idx").agg(F.count("*").alias("n"))
    checks = [
        one(vertices.join(after, "idx"), "ids_ascending", bad(F.col("vid") >= F.col("next"))),
        one(vertices, "ids_dense", bad(~F.col("idx").between(0, n - 1)) + (F.count("*") - F.countDistinct("idx"))),
        one(compact, "edge_ends_in_range", bad(~F.col("src_idx").between(0, n - 1) | ~F.col("dst_idx").between(0, n - 1))),
        one(pairs, "edges_unique", bad(F.col("n") > 1)),
        one(in_degrees, "in_degree_range", bad(F.col("degree") > n)),
        one(out_degrees, "out_degree_range", bad(F.col("degree") > n)),
        one(in_degrees, "in_degree_sum", F.abs(F.sum("degree") - e)),
        one(out_degrees, "out_degree_sum", F.abs(F.sum("degree") - e)),
    ]
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    return found


def graph_manifest(vertices: DataFrame, compact: DataFrame, edge_slice_size: int, max_task_edges: int, max_task_vertices: int) -> DataFrame:
    """One row that describes a graph."""
    counts = vertices.agg(F.count("*").alias("vertex_count")).crossJoin(compact.agg(F.count("*").alias("edge_count")))
    fixed = {"edge_slice_size": edge_slice_size, "max_task_edges": max_task_edges, "max_task_vertices": max_task_vertices}
    return counts.select(
        "vertex_count", "edge_count", *(F.lit(v).cast("long").alias(k) for k, v in fixed.items()), F.lit("removed").alias("duplicate_edges"), F.lit("preserved").alias("self_loops"), F.lit("signed-int32-ascending").alias("vertex_ids")
    )


def encode_manifest(row) -> str:
    """Canonical JSON of a manifest row: keys in order, no blanks, one line."""
    return json.dumps(row if isinstance(row, dict) else row.asDict(), separators=(",", ":")) + "\n"


def parse_manifest(text: str) -> dict:
    """The manifest, if the text is its canonical form."""
    found = json.loads(text)
    if json.dumps(found, separators=(",", ":")) + "\n" != text:
        raise ValueError("manifest is not canonical")
    return found
