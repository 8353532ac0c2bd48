"""PageRank until a separately verified residual bound holds.

Two strategies give the same ranks:

``gather``  the driver keeps the ranks as vectors of 8 bytes a vertex and sends the contributions to the executors, where
            packed edge blocks stay.  One job a pass.  Sums run in ascending order of source, hubs by slices, so the
            result does not depend on partitioning.  Taken while the vertices are at most GATHER_VERTICES and the driver's
            memory holds their vectors.
``join``    ranks and edges are tables; a pass joins them by source and sums by destination, and each state is written to
            the shared folder.  For any size.
"""

from __future__ import annotations

import itertools
import os
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceError, VertexLimitError
from ..functions.thresholds import MAX_VERTICES, RankConfig, accepts, residual_error, step_error, worth_checking
from ..operators import graph as G
from ..operators import pagerank as P
from .scratch import Scratch

#: Vertices up to which vectors are sent to the executors: 32 MB each.
GATHER_VERTICES = 4 * MAX_VERTICES
#: Bytes of a vertex on the driver: the vectors of a pass and their sums on arrival.
GATHER_BYTES = 96
#: Edges, about, in one packed block.
BLOCK_EDGES = 1 << 20


@dataclass
class Iteration:
    iteration: int
    raw_mass: float
    delta_l1: float
    true_residual_l1: float | None = None


@dataclass
class Report:
    status: str = "non_converged"  # converged, numerical_failure, non_converged
    failure: str = "none"
    iterations: int = 0
    residual_checks: int = 0
    vertex_count: int = 0
    max_mass_error: float = 0.0
    delta_l1: float | None = None
    true_residual_l1: float | None = None
    step_error_bound: float | None = None
    residual_error_bound: float | None = None
    trace: list[Iteration] = field(default_factory=list)


class _Failed(Exception):
    pass


@dataclass
class Graph:
    """A compact graph whose parts are written once."""

    vertices: DataFrame
    edges: DataFrame
    out_degrees: DataFrame
    n: int
    scratch: Scratch
    names: Iterator[int] = field(default_factory=itertools.count)
    packed: DataFrame | None = None

    @classmethod
    def build(cls, raw_edges: DataFrame) -> Graph:
        scratch = Scratch(raw_edges.sparkSession, "graph")
        distinct = scratch.write(G.distinct_edges(raw_edges), "distinct")
        vertices = scratch.write(G.compact_vertex_ids(distinct), "vertices")
        edges = scratch.write(G.compact_edges(distinct, vertices, unique=True), "edges")
        scratch.drop("distinct")
        out_degrees = scratch.write(G.out_degree(edges, vertices), "out_degrees")
        return cls(vertices, edges, out_degrees, vertices.count(), scratch)

    def in_degrees(self) -> DataFrame:
        return G.in_degree(self.edges, self.vertices)

    def blocks(self) -> DataFrame:
        """dst, counts, src: edges in order of both as packed arrays, a destination in one block; made once."""
        if self.packed is None:
            ordered = G.sorted_in_edges(self.edges).select("dst_idx", "src_idx")
            self.packed = self.scratch.write(ordered.mapInArrow(_pack, _BLOCKS), "blocks")
        return self.packed


_BLOCKS = "dst binary, counts binary, src binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def block(dst: np.ndarray, src: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(dst)]]))
        return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (dst[starts], counts, src)], names=["dst", "counts", "src"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        count += b.num_rows
        if count >= BLOCK_EDGES:  # a block ends with a destination
            dst, src = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            cut = int(np.searchsorted(dst, dst[-1]))
            if cut:
                yield block(dst[:cut], src[:cut])
            held, count = [(dst[cut:], src[cut:])], len(dst) - cut
    if count:
        yield block(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))


# --------------------------------------------------------------------------- gather


class Gather:
    """Packed edge blocks on the executors, vectors on the driver."""

    def __init__(self, graph: Graph, edge_slice_size: int = 8192):
        self.spark = graph.edges.sparkSession
        self.n, self.slice = graph.n, edge_slice_size
        table = graph.out_degrees.toArrow()  # 12 bytes a vertex, at most GATHER_VERTICES
        self.degree = np.zeros(self.n)
        self.degree[table["idx"].to_numpy()] = table["degree"].to_numpy()
        self.blocks = graph.blocks().cache()  # filled by the first pass

    def close(self) -> None:
        self.blocks.unpersist()

    def sums(self, contribution: np.ndarray) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(contribution)
        size = self.slice

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = shared.value
            for b in batches:
                for row in range(b.num_rows):
                    dst, counts, src = (np.frombuffer(c[row].as_buffer(), np.int32) for c in b.columns)
                    own = np.repeat(np.arange(len(dst)), counts)
                    sent = values[src]
                    if counts.max() > size:  # the slices of a hub are summed first, then in order
                        starts = np.cumsum(counts, dtype=np.int64) - counts
                        inside = (np.arange(len(src)) - starts[own]) // size * (counts > size)[own]
                        pieces = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])]))
                        partial = np.bincount(pieces, weights=sent)
                        first = np.flatnonzero(np.concatenate([[True], pieces[1:] != pieces[:-1]]))
                        total = np.bincount(own[first], weights=partial)
                    else:
                        total = np.bincount(own, weights=sent)  # adds in order, from 0
                    yield pa.RecordBatch.from_arrays([pa.array([dst.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["dst", "total"])

        out = np.zeros(self.n)
        found = self.blocks.mapInArrow(run, "dst binary, total binary").toArrow()
        for dst, total in zip(found["dst"], found["total"]):
            out[np.frombuffer(dst.as_buffer(), np.int32)] = np.frombuffer(total.as_buffer())
        shared.destroy()
        return out

    def start(self) -> np.ndarray:
        return np.full(self.n, 1.0 / self.n)

    def step(self, rank: np.ndarray, config: RankConfig) -> tuple[np.ndarray, float, float]:
        """(normalised candidate, raw mass, delta)."""
        _check(rank, "invalid_current_rank")
        send = self.degree > 0
        contribution = np.where(send, np.divide(rank, self.degree, out=np.zeros_like(rank), where=send), 0.0)
        _check(contribution, "invalid_transformed_rank")
        found = self._base(rank, config) + config.alpha * self.sums(contribution)
        _check(found, "invalid_candidate_rank")
        mass = _in_order(found)
        _mass_ok(mass, config)
        found /= mass
        _check(found, "invalid_normalized_rank")
        old = np.where(send, contribution * self.degree, rank)
        return found, mass, _in_order(np.abs(found - old))

    def _base(self, rank: np.ndarray, config: RankConfig) -> float:
        dangling = _in_order(rank[self.degree == 0])
        base = (1 - config.alpha) / self.n + (config.alpha * dangling) / self.n
        if not np.isfinite(base) or base < 0:
            raise _Failed("invalid_dangling_mass")
        return base

    def residual(self, rank: np.ndarray, config: RankConfig) -> float:
        send = self.degree > 0
        contribution = np.divide(rank, self.degree, out=np.zeros_like(rank), where=send)
        again = self._base(rank, config) + config.alpha * self.sums(contribution)
        return _in_order(np.abs(again - rank))

    def ranks(self, rank: np.ndarray, graph: Graph) -> DataFrame:
        """The executors look the vector up: as rows it would fill the driver's heap."""
        shared = self.spark.sparkContext.broadcast(rank)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value[b.column(1).to_numpy()])], names=["vertex", "rank"])

        return graph.vertices.select("vid", "idx").mapInArrow(run, "vertex int, rank double")


def _in_order(x: np.ndarray) -> float:
    """Sum from the first to the last; of more values than the verified domain has, pairwise, which rounds far less."""
    if len(x) > MAX_VERTICES:
        return float(np.sum(x))
    return float(np.add.accumulate(x)[-1]) if len(x) else 0.0


def _check(x: np.ndarray, failure: str) -> None:
    if not (np.isfinite(x).all() and (x >= 0).all()):
        raise _Failed(failure)


def _mass_ok(mass: float, config: RankConfig) -> None:
    if not np.isfinite(mass) or mass <= 0:
        raise _Failed("invalid_raw_mass")
    if abs(mass - 1) > config.tau_mass:
        raise _Failed("mass_tolerance_exceeded")


# --------------------------------------------------------------------------- join


class Join:
    """Ranks and edges as tables; each state is written, so lineage stays one pass long."""

    def __init__(self, graph: Graph, edge_slice_size: int = 8192):
        self.graph, self.n = graph, graph.n
        self.made: list[str] = []

    def close(self) -> None:
        pass

    def start(self) -> DataFrame:
        return P.initial_state(self.graph.out_degrees, self.n)

    def _dangling(self, state: DataFrame) -> float:
        row = state.agg(F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0)).alias("g"), F.min("rank").alias("low"), F.max("rank").alias("high")).first()
        if not (row["low"] >= 0 and row["high"] < float("inf")):
            raise _Failed("invalid_current_rank")
        return row["g"]

    def step(self, state: DataFrame, config: RankConfig) -> tuple[DataFrame, float, float]:
        name = f"step{next(self.graph.names)}"
        step = self.graph.scratch.write(P.candidate(state, self.graph.edges, self.n, config.alpha, self._dangling(state)), name)
        self.made.append(name)
        if len(self.made) > 2:
            self.graph.scratch.drop(self.made.pop(0))
        mass = P.raw_mass(step).first()[0]
        _mass_ok(mass, config)
        return P.normalised(step, mass), mass, P.delta_l1(step, mass).first()[0]

    def residual(self, state: DataFrame, config: RankConfig) -> float:
        return P.true_residual(state, self.graph.edges, self.n, config.alpha, self._dangling(state)).first()[0]

    def ranks(self, state: DataFrame, graph: Graph) -> DataFrame:
        return P.decode_vertex_ids(state, graph.vertices)


# --------------------------------------------------------------------------- loop

Observer = Callable[[Iteration], None]


def run(graph: Graph, config: RankConfig = RankConfig(), strategy: str = "auto", edge_slice_size: int = 8192, observer: Observer | None = None) -> tuple[Report, DataFrame | None]:
    """(report, ranks): ranks (vertex, rank) only of a converged run."""
    if config.max_vertices is not None and graph.n > config.max_vertices:
        raise VertexLimitError(f"vertex count {graph.n} exceeds the verified limit {config.max_vertices}")
    if not config.reachable:
        warnings.warn("no residual can be accepted with this alpha and eta", stacklevel=2)
    engine = _engine(graph, strategy, edge_slice_size)
    report = Report(vertex_count=graph.n)
    state = engine.start()
    try:
        for k in range(1, config.max_iterations + 1):
            state, mass, delta = engine.step(state, config)
            report.iterations, report.delta_l1 = k, delta
            report.max_mass_error = max(report.max_mass_error, abs(mass - 1))
            if not np.isfinite(delta) or delta < 0:
                raise _Failed("invalid_delta")
            report.step_error_bound = step_error(delta, config)
            seen = Iteration(k, mass, delta)
            if worth_checking(delta, config):
                seen.true_residual_l1 = report.true_residual_l1 = engine.residual(state, config)
                report.residual_checks += 1
                if not np.isfinite(seen.true_residual_l1) or seen.true_residual_l1 < 0:
                    raise _Failed("invalid_residual")
                report.residual_error_bound = residual_error(seen.true_residual_l1, config)
            report.trace.append(seen)
            if observer:
                observer(seen)
            if seen.true_residual_l1 is not None and accepts(seen.true_residual_l1, config):
                report.status = "converged"
                return report, engine.ranks(state, graph)
    except _Failed as e:
        report.status, report.failure = "numerical_failure", str(e)
    finally:
        engine.close()
    return report, None


def iterate(graph: Graph, steps: int, config: RankConfig = RankConfig(), strategy: str = "auto", edge_slice_size: int = 8192) -> tuple[list[Iteration], DataFrame]:
    """(trace, ranks) after a fixed number of steps, without residuals."""
    engine = _engine(graph, strategy, edge_slice_size)
    state, trace = engine.start(), []
    try:
        for k in range(1, steps + 1):
            state, mass, delta = engine.step(state, config)
            trace.append(Iteration(k, mass, delta))
        return trace, engine.ranks(state, graph)
    finally:
        engine.close()


def driver_memory() -> int:
    """Bytes that the driver's machine has free; of a container with a limit, what the limit leaves."""
    free = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    try:
        with open("/proc/meminfo") as f:
            free = max(free, next(int(x.split()[1]) << 10 for x in f if x.startswith("MemAvailable")))
        with open("/sys/fs/cgroup/memory.max") as most, open("/sys/fs/cgroup/memory.current") as now:
            free = min(free, int(most.read()) - int(now.read()))
    except (OSError, ValueError, StopIteration):  # no such files, or no limit
        pass
    return free


def _engine(graph: Graph, strategy: str, edge_slice_size: int) -> Gather | Join:
    fits = graph.n * GATHER_BYTES <= driver_memory()
    if strategy == "auto":
        strategy = "gather" if graph.n <= GATHER_VERTICES and fits else "join"
    if strategy == "gather" and graph.n > GATHER_VERTICES:
        raise ValueError(f"the gather strategy is for at most {GATHER_VERTICES} vertices")
    if strategy == "gather" and not fits:
        raise ResourceError(f"{graph.n} vertices need {graph.n * GATHER_BYTES} bytes on the driver, {driver_memory()} are free")
    return {"gather": Gather, "join": Join}[strategy](graph, edge_slice_size)


def rank(raw_edges: DataFrame, config: RankConfig = RankConfig(), strategy: str = "auto") -> tuple[Report, DataFrame | None]:
    """The whole engine on (src, dst)."""
    return run(Graph.build(raw_edges), config, strategy)
