"""The work partition: hub slices and greedy packing of the other destinations, as tables.

Boundaries depend on degrees and limits alone, never on the number of partitions or workers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TASKS
from .graph import dense_index

ORDINARY, HUB = 1, 2
#: Destinations, about, that one task packs.
BLOCK_VERTICES = 1 << 20


@dataclass(frozen=True)
class TaskLimits:
    edge_slice_size: int = 8192
    max_task_edges: int = 262_144
    max_task_vertices: int = 4096

    def __post_init__(self) -> None:
        if min(self.edge_slice_size, self.max_task_edges, self.max_task_vertices) <= 0:
            raise ValueError("task limits must be positive")
        if self.edge_slice_size > self.max_task_edges:
            raise ValueError("edge_slice_size must not exceed max_task_edges")


def edge_offsets(in_degrees: DataFrame) -> DataFrame:
    """idx, degree, edge_begin: the edges before each destination in (dst, src) order.

    Sums of ranges of 2**16 destinations come first, so the windows are bounded; their own sums are few.
    """
    block = F.shiftright("idx", 16)
    placed = in_degrees.withColumn("block", block)
    sums = placed.groupBy("block").agg(F.sum("degree").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("start"))
    inside = F.sum("degree").over(Window.partitionBy("block").orderBy("idx")) - F.col("degree")
    return placed.withColumn("inside", inside).join(before, "block").select("idx", "degree", (F.col("start") + F.col("inside")).alias("edge_begin"))


def hub_slices(in_degrees: DataFrame, limits: TaskLimits) -> DataFrame:
    """Tasks of the destinations with more edges than a slice; the last slice holds the rest."""
    size = limits.edge_slice_size
    hubs = edge_offsets(in_degrees).where(F.col("degree") > size).withColumn("c", F.ceil(F.col("degree") / size))
    each = hubs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("b"))
    return each.select(
        F.lit(HUB).alias("tag"), F.col("idx").cast("long").alias("a"), "b", "c", (F.col("edge_begin") + F.col("b") * size).alias("edge_begin"), F.least(F.lit(size).cast("long"), F.col("degree") - F.col("b") * size).alias("edge_count")
    )


def ordinary_tasks(in_degrees: DataFrame, limits: TaskLimits) -> DataFrame:
    """Greedy packing: a task ends before a hub, at the vertex limit, or where the next count would pass the edge limit.

    Where a task that begins at a destination ends depends only on the next few, so blocks of destinations, each with the
    vertices of one task of the block behind it, find all ends at once.  A block tells, for each place where a task may
    first begin in it, where the first task of the next block begins.  The driver follows these maps, a few bytes for
    each place: at most 4096 blocks, since ids have 32 bits.  Then each block makes its tasks from its beginning.
    """
    reach = limits.max_task_vertices
    size = max(BLOCK_VERTICES, 16 * reach)
    rows = edge_offsets(in_degrees).select("idx", "degree", "edge_begin")
    n = (rows.agg(F.max("idx")).first()[0] or 0) + 1
    own = F.floor(F.col("idx") / size).cast("int")
    behind = (F.col("idx") % size < reach) & (F.col("idx") >= size)
    blocks = rows.withColumn("block", F.explode(F.when(behind, F.array(own, own - 1)).otherwise(F.array(own)))).groupBy("block")

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        first, ends, _, _ = _task_ends(frame, limits, size)
        last = min(size, n - first)
        to = ends
        while (to[:last] < last).any():  # a pointer jumps twice as far each time
            inside = to < last
            to = np.where(inside, to[np.minimum(to, last - 1)], to)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "exits": [(to[:reach] - last).astype(np.int32).tobytes()]})

    begins, at = [], 0
    for r in sorted(blocks.applyInPandas(exits, "block int, exits binary").collect()) if n > size else []:
        begins.append((r["block"], at))
        at = int(np.frombuffer(r["exits"], np.int32)[at])
    begin = dict(begins)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        first, ends, edges, hub = _task_ends(frame, limits, size)
        at, last, found = begin.get(int(frame["block"].iloc[0]), 0), min(size, n - first), []
        while at < last:
            if not hub[at]:
                found.append((ORDINARY, first + at, int(ends[at]) - at, 0, int(edges[at]), int(edges[ends[at]] - edges[at])))
            at = int(ends[at])
        return pd.DataFrame(found, columns=["tag", "a", "b", "c", "edge_begin", "edge_count"])

    return blocks.applyInPandas(pack, TASKS)


def _task_ends(frame: pd.DataFrame, limits: TaskLimits, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first destination, where a task ends that begins at each place, edges before each place, which are hubs) of a block."""
    frame = frame.sort_values("idx")
    degree = frame["degree"].to_numpy()
    edges = np.concatenate([frame["edge_begin"].to_numpy(), [frame["edge_begin"].iloc[-1] + degree[-1]]])
    hub = degree > limits.edge_slice_size
    place = np.arange(len(degree))
    next_hub = np.minimum.accumulate(np.where(hub, place, len(degree))[::-1])[::-1]
    full = np.searchsorted(edges, edges[:-1] + limits.max_task_edges, side="right") - 1
    ends = np.minimum(np.minimum(place + limits.max_task_vertices, next_hub), full)
    return int(frame["block"].iloc[0]) * size, np.where(hub, place + 1, ends), edges, hub


def task_partition(in_degrees: DataFrame, limits: TaskLimits) -> DataFrame:
    """All tasks in their physical form."""
    return ordinary_tasks(in_degrees, limits).unionByName(hub_slices(in_degrees, limits))


def task_summary(tasks: DataFrame) -> DataFrame:
    """tasks, ordinary, slices, destinations, edges."""
    ordinary = F.when(F.col("tag") == ORDINARY, 1).otherwise(0)
    first = F.when((F.col("tag") == HUB) & (F.col("b") == 0), 1).otherwise(0)
    return tasks.agg(
        F.count("*").alias("tasks"), F.sum(ordinary).alias("ordinary"), F.sum(1 - ordinary).alias("slices"), (F.sum(F.when(F.col("tag") == ORDINARY, F.col("b")).otherwise(0)) + F.sum(first)).alias("destinations"), F.sum("edge_count").alias("edges")
    )


def task_validation(tasks: DataFrame, in_degrees: DataFrame, limits: TaskLimits) -> DataFrame:
    """name, violations: gaps and overlaps of coverage, limits passed, and boundaries that greedy packing would not make."""
    placed = dense_index(tasks.withColumn("first", F.col("a")).withColumn("slice", F.when(F.col("tag") == HUB, F.col("b")).otherwise(0)), ["first", "slice"], "place")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("tag").alias("next_tag"), F.col("a").alias("next_a"), F.col("edge_begin").alias("next_begin"))
    degrees = in_degrees.select(F.col("idx").cast("long").alias("next_a"), F.col("degree").alias("next_degree"))
    seen = placed.join(after, "place", "left").join(degrees, "next_a", "left")
    ordinary = F.col("tag") == ORDINARY
    ends = F.when(ordinary, F.col("a") + F.col("b")).when(F.col("b") == F.col("c") - 1, F.col("a") + 1).otherwise(F.col("a"))
    early = ordinary & (F.col("next_tag") == ORDINARY) & (F.col("b") < limits.max_task_vertices) & (F.col("edge_count") + F.col("next_degree") <= limits.max_task_edges)
    over = F.when(ordinary, (F.col("b") > limits.max_task_vertices) | (F.col("edge_count") > limits.max_task_edges) & (F.col("b") > 1)).otherwise(F.col("edge_count") > limits.edge_slice_size)
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = seen.agg(
        bad(F.col("next_begin") != F.col("edge_begin") + F.col("edge_count")).alias("edge_gaps"), bad(F.col("next_a") != ends).alias("destination_gaps"), bad(early).alias("early_ends"), bad(over).alias("limits")
    )
    return sums.select(F.expr("stack(4, 'edge_gaps', edge_gaps, 'destination_gaps', destination_gaps, 'early_ends', early_ends, 'limits', limits) AS (name, violations)"))


def slice_histogram(in_degrees: DataFrame, edge_slice_size: int) -> DataFrame:
    """slices, vertices: how many vertices need so many slices."""
    return in_degrees.groupBy(F.ceil(F.col("degree") / edge_slice_size).alias("slices")).agg(F.count("*").alias("vertices"))
