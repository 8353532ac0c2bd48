"""PageRank operators on (idx, out_degree, rank) and (dst_idx, src_idx), one DataFrame plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dense_index


def initial_state(out_degrees: DataFrame, n: int) -> DataFrame:
    return out_degrees.select("idx", F.col("degree").alias("out_degree"), F.lit(1.0 / n).alias("rank"))


def contribution(state: DataFrame) -> DataFrame:
    """idx, contribution: rank by out-degree, once a vertex rather than once an edge."""
    return state.where("out_degree > 0").select("idx", (F.col("rank") / F.col("out_degree")).alias("contribution"))


def dangling_mass(state: DataFrame) -> DataFrame:
    return state.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling"))


def gather_sum(state: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, gathered: contributions summed by destination.  Partial sums come before the shuffle."""
    sent = edges.join(contribution(state).withColumnRenamed("idx", "src_idx"), "src_idx")
    return sent.groupBy(F.col("dst_idx").alias("idx")).agg(F.sum("contribution").alias("gathered"))


def hub_slice_partials(state: DataFrame, edges: DataFrame, edge_slice_size: int) -> DataFrame:
    """idx, slice, partial: sums of the slices of hubs, in order of source.

    The edges of hubs are dealt out by range of destination and source, so a hub of any degree is spread over partitions,
    and numbered there; a slice is a part of the numbers from its hub's first one on.
    """
    degree = edges.groupBy("dst_idx").agg(F.count("*").alias("n")).where(F.col("n") > edge_slice_size)
    own = edges.join(degree.select("dst_idx"), "dst_idx")
    placed = dense_index(own, ["dst_idx", "src_idx"], "place")
    first = placed.groupBy("dst_idx").agg(F.min("place").alias("first"))
    sliced = placed.join(first, "dst_idx").withColumn("slice", F.floor((F.col("place") - F.col("first")) / edge_slice_size))
    sent = sliced.join(contribution(state).withColumnRenamed("idx", "src_idx"), "src_idx")
    return sent.groupBy(F.col("dst_idx").alias("idx"), "slice").agg(F.sum("contribution").alias("partial"))


def candidate(state: DataFrame, edges: DataFrame, n: int, alpha: float, dangling: float) -> DataFrame:
    """idx, out_degree, rank, candidate: one step before normalisation; every vertex has a row."""
    base = (1 - alpha) / n + (alpha * dangling) / n
    found = state.join(gather_sum(state, edges), "idx", "left")
    return found.select("idx", "out_degree", "rank", (F.lit(base) + F.lit(alpha) * F.coalesce("gathered", F.lit(0.0))).alias("candidate"))


def raw_mass(step: DataFrame) -> DataFrame:
    return step.agg(F.sum("candidate").alias("raw_mass"))


def previous_rank() -> Column:
    """The old rank as it is rebuilt from the contribution."""
    return F.when(F.col("out_degree") > 0, F.col("rank") / F.col("out_degree") * F.col("out_degree")).otherwise(F.col("rank"))


def delta_l1(step: DataFrame, mass: float) -> DataFrame:
    return step.agg(F.sum(F.abs(F.col("candidate") / F.lit(mass) - previous_rank())).alias("delta_l1"))


def normalised(step: DataFrame, mass: float) -> DataFrame:
    return step.select("idx", "out_degree", (F.col("candidate") / F.lit(mass)).alias("rank"))


def true_residual(state: DataFrame, edges: DataFrame, n: int, alpha: float, dangling: float) -> DataFrame:
    """L1 distance of a state to its own next step, without normalisation."""
    return candidate(state, edges, n, alpha, dangling).agg(F.sum(F.abs(F.col("candidate") - F.col("rank"))).alias("residual_l1"))


def rank_domain_check(state: DataFrame) -> DataFrame:
    """invalid: ranks that are null, not finite or negative."""
    r = F.col("rank")
    bad = F.coalesce(F.isnan(r) | (F.abs(r) == float("inf")) | (r < 0), F.lit(True))
    return state.agg(F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias("invalid"))


def decode_vertex_ids(state: DataFrame, vertices: DataFrame) -> DataFrame:
    return state.join(vertices, "idx").select(F.col("vid").alias("vertex"), "rank")


def top_k_ranks(ranks: DataFrame, k: int) -> DataFrame:
    """An extension: the k largest ranks, ties by vertex."""
    return ranks.orderBy(F.desc("rank"), "vertex").limit(k)
