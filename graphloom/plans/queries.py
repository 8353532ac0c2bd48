"""One query for each operator of the engine: (spark, sf_dir) -> DataFrame.

Graphs: ``supply`` (customers, suppliers, parts), ``hops`` (consecutive users of events) and the generator's smallest
profile.  Small task limits make every branch of the work partition occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rank_lines
from ..functions.thresholds import RankConfig, accepts
from ..operators import graph as G
from ..operators import pagerank as P
from ..operators import tasks as T
from ..sources import dataset, generator, tables
from ..sources.edge_csv import parse_lines
from ..sources.graph_store import open_graph, publish_graph, read_manifest
from .pagerank import Graph, Report, iterate, run
from .scratch import Scratch

LIMITS = T.TaskLimits(64, 256, 16)
STEPS = 20
ALPHA = RankConfig().alpha
DIGITS = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) for c in columns))


_graphs: dict[tuple[str, str], Graph] = {}


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Built once a session and folder: the queries stand for the steps after it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = Graph.build(tables.supply(spark, sf_dir))
    return _graphs[key]


def supply_state(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The state after one step, so that ranks differ."""
    g = supply_graph(spark, sf_dir)
    start = P.initial_state(g.out_degrees, g.n)
    step = P.candidate(start, g.edges, g.n, ALPHA, P.dangling_mass(start).first()[0])
    return g, P.normalised(step, P.raw_mass(step).first()[0])


# --------------------------------------------------------------------------- graph


@query
def endpoint_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.endpoints(tables.supply(spark, sf_dir)).groupBy("vid").agg(F.count("*").alias("n"))


@query
def distinct_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distinct_vertices(tables.supply(spark, sf_dir))


@query
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.distinct_edges(tables.supply(spark, sf_dir))


@query
def compact_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.compact_vertex_ids(tables.supply(spark, sf_dir))


@query
def compact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_graph(spark, sf_dir).edges


@query
def dictionary_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a dictionary without the suppliers."""
    edges = tables.supply(spark, sf_dir)
    vertices = G.compact_vertex_ids(edges).where(~F.col("vid").between(tables.SUPPLIERS, tables.PARTS - 1))
    return G.dictionary_misses(edges, vertices)


@query
def sorted_in_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge with its place in the order of destination and source."""
    edges = G.sorted_in_edges(supply_graph(spark, sf_dir).edges)
    return G.dense_index(edges, ["dst_idx", "src_idx"], "place").select("dst_idx", "src_idx", "place")


@query
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(G.duplicate_summary(tables.supply(spark, sf_dir)), "input_edges", "unique_edges", "duplicate_edges")


@query
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.self_loops(tables.hops(spark, sf_dir))


@query
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_graph(spark, sf_dir).in_degrees()


@query
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_graph(spark, sf_dir).out_degrees


@query
def out_degree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against degrees that are one too high for every tenth vertex."""
    g = supply_graph(spark, sf_dir)
    stored = g.out_degrees.select("idx", (F.col("degree") + F.when(F.col("idx") % 10 == 0, 1).otherwise(0)).alias("degree"))
    return G.out_degree_audit(g.edges, stored)


@query
def degree_histogram_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_histogram(supply_graph(spark, sf_dir).in_degrees())


@query
def degree_histogram_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_histogram(supply_graph(spark, sf_dir).out_degrees)


@query
def degree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both directions."""
    g = supply_graph(spark, sf_dir)
    found = [G.degree_statistics(d).withColumn("direction", F.lit(name)) for name, d in (("in", g.in_degrees()), ("out", g.out_degrees))]
    return found[0].unionByName(found[1]).select("direction", "least", "most", F.round("mean", DIGITS).alias("mean"), "edges")


@query
def dangling_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling_vertices(supply_graph(spark, sf_dir).out_degrees)


@query
def hub_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hub_vertices(supply_graph(spark, sf_dir).in_degrees(), LIMITS.edge_slice_size)


@query
def graph_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = supply_graph(spark, sf_dir)
    return G.graph_invariants(g.vertices, g.edges, g.in_degrees(), g.out_degrees)


@query
def graph_invariants_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a graph with ids out of order and some gone, edges twice, ends out of range and degrees too high: every check fires."""
    g = supply_graph(spark, sf_dir)
    vertices = g.vertices.withColumn("vid", F.col("vid") - F.when(F.col("idx") % 40 == 7, 10_000_000).otherwise(0)).where("idx % 100 <> 99")
    twice = g.edges.where("dst_idx % 50 = 0")
    beyond = g.edges.where("src_idx % 70 = 1").select((F.col("dst_idx") + g.n).cast("int").alias("dst_idx"), "src_idx")
    high = lambda d, k: d.select("idx", (F.col("degree") + F.when(F.col("idx") % k == 0, g.n).otherwise(0)).alias("degree"))
    return G.graph_invariants(vertices, g.edges.union(twice).union(beyond), high(g.in_degrees(), 10), high(g.out_degrees, 30))


@query
def graph_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = supply_graph(spark, sf_dir)
    return G.graph_manifest(g.vertices, g.edges, LIMITS.edge_slice_size, LIMITS.max_task_edges, LIMITS.max_task_vertices)


@query
def int32_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts made of order keys are canonical 32-bit integers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, (k * 1_000_003 - 2_147_483_648).cast("string")).when(k % 4 == 1, F.concat(F.lit("0"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("-"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(" ")))
    return orders.select("o_orderkey", text.alias("value")).select("o_orderkey", "value", G.int32_domain("value").alias("ok"))


# --------------------------------------------------------------------------- tasks


@query
def hub_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hub_slices(supply_graph(spark, sf_dir).in_degrees(), LIMITS)


@query
def task_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.task_partition(supply_graph(spark, sf_dir).in_degrees(), LIMITS)


@query
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.task_summary(T.task_partition(supply_graph(spark, sf_dir).in_degrees(), LIMITS))
    return _ids(found, "tasks", "ordinary", "slices", "destinations", "edges")


@query
def task_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = supply_graph(spark, sf_dir).in_degrees()
    return T.task_validation(T.task_partition(degrees, LIMITS), degrees, LIMITS)


@query
def task_validation_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tasks cut for smaller limits, some gone, some with an edge too many, seen under other limits: every check fires."""
    degrees = supply_graph(spark, sf_dir).in_degrees()
    tasks = T.task_partition(degrees, T.TaskLimits(LIMITS.edge_slice_size, LIMITS.max_task_edges, 4)).where("edge_begin % 11 <> 3")
    tasks = tasks.withColumn("edge_count", F.col("edge_count") + F.when(F.col("edge_begin") % 13 == 0, 1).otherwise(0))
    return T.task_validation(tasks, degrees, T.TaskLimits(LIMITS.edge_slice_size, LIMITS.max_task_edges, 3))


@query
def slice_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.slice_histogram(supply_graph(spark, sf_dir).in_degrees(), LIMITS.edge_slice_size)


# --------------------------------------------------------------------------- ranks


@query
def contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = supply_state(spark, sf_dir)
    return P.contribution(state).select("idx", F.round("contribution", 12).alias("contribution"))


@query
def dangling_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state = supply_state(spark, sf_dir)
    return P.dangling_mass(state).select(F.round("dangling", DIGITS).alias("dangling"))


@query
def gather_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    return P.gather_sum(state, g.edges).select("idx", F.round("gathered", DIGITS).alias("gathered"))


@query
def hub_slice_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    found = P.hub_slice_partials(state, g.edges, LIMITS.edge_slice_size)
    return found.select("idx", F.col("slice").cast("long").alias("slice"), F.round("partial", DIGITS).alias("partial"))


@query
def pagerank_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    step = P.candidate(state, g.edges, g.n, ALPHA, P.dangling_mass(state).first()[0])
    return step.select("idx", F.round("candidate", DIGITS).alias("candidate"))


@query
def raw_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    step = P.candidate(state, g.edges, g.n, ALPHA, P.dangling_mass(state).first()[0])
    return P.raw_mass(step).select(F.round("raw_mass", DIGITS).alias("raw_mass"))


@query
def delta_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    step = P.candidate(state, g.edges, g.n, ALPHA, P.dangling_mass(state).first()[0])
    return P.delta_l1(step, P.raw_mass(step).first()[0]).select(F.round("delta_l1", DIGITS).alias("delta_l1"))


@query
def true_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    found = P.true_residual(state, g.edges, g.n, ALPHA, P.dangling_mass(state).first()[0])
    return found.select(F.round("residual_l1", DIGITS).alias("residual_l1"))


@query
def rank_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bad rank for every seventh vertex."""
    _, state = supply_state(spark, sf_dir)
    bad = state.withColumn("rank", F.when(F.col("idx") % 21 == 0, F.lit(-1.0)).when(F.col("idx") % 21 == 7, F.lit(float("nan"))).when(F.col("idx") % 21 == 14, F.lit(float("inf"))).otherwise(F.col("rank")))
    return P.rank_domain_check(bad)


@query
def decode_vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, state = supply_state(spark, sf_dir)
    return P.decode_vertex_ids(state, g.vertices).select("vertex", F.round("rank", DIGITS).alias("rank"))


@query
def pagerank_k20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks after twenty steps."""
    _, ranks = iterate(supply_graph(spark, sf_dir), STEPS)
    return ranks.select("vertex", F.round("rank", DIGITS).alias("rank"))


@query
def pagerank_k20_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the join strategy, on the events' graph."""
    _, ranks = iterate(Graph.build(tables.hops(spark, sf_dir)), STEPS, strategy="join")
    return ranks.select("vertex", F.round("rank", DIGITS).alias("rank"))


@query
def pagerank_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace, _ = iterate(supply_graph(spark, sf_dir), STEPS)
    rows = [(t.iteration, t.raw_mass, t.delta_l1) for t in trace]
    found = spark.createDataFrame(rows, "iteration int, raw_mass double, delta_l1 double")
    return found.select("iteration", F.round("raw_mass", DIGITS).alias("raw_mass"), F.round("delta_l1", DIGITS).alias("delta_l1"))


def _converged(spark: SparkSession, sf_dir: str) -> tuple[Report, DataFrame]:
    """Of a graph of any size, as in SQL: the limit of vertices is one of the command."""
    report, ranks = run(supply_graph(spark, sf_dir), RankConfig(max_vertices=None))
    if ranks is None:
        raise RuntimeError(f"{report.status}: {report.failure}")
    return report, ranks


@query
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converged(spark, sf_dir)[1].select("vertex", F.round("rank", DIGITS).alias("rank"))


@query
def pagerank_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = _converged(spark, sf_dir)
    row = (r.status, r.iterations, r.residual_checks, r.vertex_count, accepts(r.true_residual_l1, RankConfig()), r.max_mass_error, r.delta_l1, r.step_error_bound, r.true_residual_l1, r.residual_error_bound)
    names = ("max_mass_error", "delta_l1", "step_error_bound", "residual_l1", "residual_error_bound")
    found = spark.createDataFrame([row], "status string, iterations int, residual_checks int, vertex_count long, accepted boolean, " + ", ".join(f"{c} double" for c in names))
    return found.select("status", "iterations", "residual_checks", "vertex_count", "accepted", *(F.round(c, DIGITS).alias(c) for c in names), (F.col("residual_error_bound") < 1e-8).alias("within_eta"))


@query
def top_k_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the hundred largest ranks, ties by vertex."""
    rounded = pagerank_k20(spark, sf_dir)
    return P.top_k_ranks(rounded, 100)


# --------------------------------------------------------------------------- sources and sinks


@query
def gen_reduced_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.generate(spark, "reduced-skew")


@query
def gen_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the smallest profile without the edges of vertex 5 and with one more."""
    found = generator.generate(spark, "reduced-skew").where("src <> 5").unionByName(spark.createDataFrame([(7, 7)], "src int, dst int"))
    return generator.verify(found, "reduced-skew").select("kind", F.col("n").cast("long").alias("n"))


@query
def gen_skew_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree histograms of the generator's largest skewed profile: 1,000,000 vertices and 50,000,000 edges."""
    return dataset.degree_counts(generator.generate(spark, "skew"))


@query
def edge_csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows as the parser sees them, some with blanks and carriage returns, some malformed."""
    edges = tables.supply(spark, sf_dir).select("src", "dst")
    s, d = (F.col(c).cast("string") for c in ("src", "dst"))
    kind = (F.col("src") + F.col("dst")) % 5
    value = F.when(kind == 0, F.concat(F.lit(" \t"), s, F.lit(" ,\t"), d, F.lit("\r"))).when(kind == 1, F.concat(F.lit("0"), s, F.lit(","), d)).when(kind == 2, F.concat(s, F.lit(","), d, F.lit(",1"))).otherwise(F.concat(s, F.lit(","), d))
    parsed = parse_lines(edges.select(value.alias("value"), kind.alias("kind")))
    return parsed.groupBy("kind", "ok").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


@query
def rank_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the rank CSV of the supply graph after twenty steps, of ranks to ten places: sums differ beyond them."""
    return rank_lines(pagerank_k20(spark, sf_dir))


@query
def strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the events' graph after twenty steps by either strategy, and vertices on which they differ."""
    graph = Graph.build(tables.hops(spark, sf_dir))
    gather, join = (iterate(graph, STEPS, strategy=s)[1] for s in ("gather", "join"))
    both = gather.join(join.select("vertex", F.col("rank").alias("other")), "vertex", "full_outer")
    differ = F.when(F.coalesce(F.abs(F.col("rank") - F.col("other")) <= 1e-12, F.lit(False)), 0).otherwise(1)
    return both.agg(F.count("*").alias("vertices"), F.coalesce(F.sum(differ), F.lit(0)).cast("long").alias("differ"), F.round(F.sum("rank"), DIGITS).alias("mass"))


@query
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the supply graph, published and opened again."""
    scratch = Scratch(spark, "store")
    publish_graph(supply_graph(spark, sf_dir), f"{scratch.root}/graph", LIMITS)
    manifest = read_manifest(spark, f"{scratch.root}/graph")
    opened = open_graph(spark, f"{scratch.root}/graph", check=False)
    counts = spark.createDataFrame([(f["name"], f["rows"]) for f in manifest["files"]], "name string, n long")
    return counts.unionByName(opened.edges.where("dst_idx = src_idx").agg(F.lit("self_loops").alias("name"), F.count("*").alias("n")))
