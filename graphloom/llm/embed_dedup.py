"""Embedding near-duplicates by product quantisation.

Coarse inverted lists hold unit vectors as residual subspace codes.  A vector probes every list whose border it is
near enough to for a neighbour within the radius to lie beyond it, so the probes are sufficient by the triangle
inequality.  In a list, asymmetric table look-ups give the distance of a query to every code; since the quantisation
error of each member is stored, no link falls out there either.  What is left is ranked again by exact cosine.

Work is dealt in units of one block of members and one block of queries of one list; a unit returns sums of links and a
spanning forest, never pairs.  Equal vectors are one class first, so a large group of copies is one row.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing and are their own component; vectors of different length link with nothing; repeated rows are vectors each; a
null vec_id takes part and has the component of its links; labels of any type are compared as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, forest, hash_sample

#: Vectors, about, to which the index is fitted: the least and the most; every vector is indexed.
SAMPLE_VECTORS, SAMPLE_MOST = 8192, 65_536
#: Vectors of one length in the sample, at least, to which an index is fitted.
LEAST_VECTORS = 64
#: Members, about, of an inverted list, and vectors of the sample that fit one centre; members of a block, of which a
#: list has as many as it needs.
LIST_SIZE = 2048
FIT_SIZE = 8
BLOCK_SIZE = 1024
SUBSPACES = 8
CODES = 64
ROUNDS = 12
#: The name of a class, 128 bits in two columns; in the units a class has a number of its own, given when classes are written.
NAME = ["name", "name2"]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, a block of points at a time."""
    step, squares = max(1, (1 << 22) // len(centres)), (centres**2).sum(axis=1)
    parts = [(points[i : i + step] @ centres.T * -2 + squares).argmin(axis=1) for i in range(0, len(points), step)]
    return np.concatenate([*parts, np.zeros(0, np.int64)])


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centres and the codebooks of residuals for vectors of one length."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, points: np.ndarray, lists: int, seed: int = 5) -> Index:
        rng = np.random.default_rng(seed)
        centres = kmeans(points, lists, rng)
        rest = points - centres[nearest(points, centres)]
        parts = min(SUBSPACES, points.shape[1])
        cuts = [points.shape[1] * i // parts for i in range(parts + 1)]
        return cls(centres, [kmeans(rest[:, a:b], CODES, rng) for a, b in zip(cuts, cuts[1:])], cuts)

    def encode(self, points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the quantisation error of each point."""
        rest = points - self.centres[cells]
        codes = np.empty((len(points), len(self.books)), np.uint8)
        error = np.zeros(len(points))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            codes[:, m] = nearest(rest[:, a:b], book)
            error += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def probes(self, points: np.ndarray, cells: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray]]:
        """(list, rows) of points that a neighbour in that later list may be within ``radius`` of."""
        far = ((points[:, None, :] - self.centres[None]) ** 2).sum(axis=2) if len(self.centres) * points.size < 1 << 24 else None
        for j in range(1, len(self.centres)):
            rows = np.flatnonzero(cells < j)
            own, other = self.centres[cells[rows]], self.centres[j]
            d_own = far[rows, cells[rows]] if far is not None else ((points[rows] - own) ** 2).sum(axis=1)
            d_other = far[rows, j] if far is not None else ((points[rows] - other) ** 2).sum(axis=1)
            gap = np.sqrt(((own - other) ** 2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                border = (d_other - d_own) / (2 * gap)  # distance to the plane between the two centres
            near = rows[(border <= radius) | (gap == 0)]
            if len(near):
                yield j, near

    def distances(self, queries: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of each query to each code, from one table of each query and subspace."""
        rest, total = queries - self.centres[cell], np.zeros((len(queries), len(codes)), np.float32)
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            table = ((rest[:, None, a:b] - book[None]) ** 2).sum(axis=2).astype(np.float32)
            total += table[:, codes[:, m]]
        return total


def link_unit(frame: pd.DataFrame, indexes: dict[int, Index], least: float, kind: type = np.float32) -> tuple[pd.DataFrame, int]:
    """Sums and forest of one unit; and how many exact cosines it took."""
    members, queries = frame[~frame["query"]], frame[frame["query"]]
    out = pd.DataFrame({"cid": pd.Series([], dtype="int64"), "links": pd.Series([], dtype="int64"), "root": pd.Series([], dtype="int64")})
    if members.empty or queries.empty:
        return out, 0
    dim, cell = int(frame["dim"].iloc[0]), int(frame["cell"].iloc[0])
    x, y = (unit_vectors(np.frombuffer(b"".join(z["vec"]), kind).reshape(-1, dim)) for z in (queries, members))
    qid, mid = queries["cid"].to_numpy(), members["cid"].to_numpy()
    qmult, mmult = queries["mult"].to_numpy(), members["mult"].to_numpy()
    own = queries["own"].to_numpy()
    radius = math.sqrt(2 - 2 * least) + 1e-5
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1) if dim in indexes else None
    error = members["error"].to_numpy()
    found_q, found_m, ranked = [], [], 0
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        if codes is None:
            near = np.ones((len(part), len(y)), np.bool_)
        else:
            reach = (radius + error.astype(np.float32)) ** 2 + np.float32(1e-4)
            near = indexes[dim].distances(part, codes, cell) <= reach
        near &= ~own[at : at + step, None] | (mid[None, :] < qid[at : at + step, None])
        qi, mi = np.nonzero(near)
        ranked += len(qi)
        for k in range(0, len(qi), 1 << 16):
            q, m = qi[k : k + (1 << 16)], mi[k : k + (1 << 16)]
            good = np.einsum("ij,ij->i", part[q], y[m]) >= least
            found_q.append(q[good] + at)
            found_m.append(m[good])
    q, m = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (found_q, found_m))
    if not len(q):
        return out, ranked
    ids = np.concatenate([mid, qid])
    nodes, place = np.unique(ids, return_inverse=True)
    a, b = place[: len(mid)][m], place[len(mid) :][q]
    links = np.bincount(a, weights=qmult[q], minlength=len(nodes)) + np.bincount(b, weights=mmult[m], minlength=len(nodes))
    root = forest(len(nodes), a, b)
    used = links > 0
    return pd.DataFrame({"cid": nodes[used], "links": links[used].astype(np.int64), "root": nodes[root[used]]}), ranked


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """In double precision; scaled first, so that no square overflows."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


_ASSIGNED = "cid long, mult long, label {label}, dim int, vec binary, cell int, codes binary, error double, probes array<int>"


def find_near(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    valid = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", good) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # other numbers travel in double precision
    kind, label = np.float32 if single else np.float64, vectors.schema["label"].dataType.simpleString()
    embedding = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding"), "label").withColumn("valid", valid)
    names = {"name": F.xxhash64("label", "embedding"), "name2": F.xxhash64(F.lit("second"), "label", "embedding")}
    rows = rows.withColumns({k: F.when(F.col("valid"), name) for k, name in names.items()})
    classes = rows.where("valid").groupBy(*NAME, "label", "embedding").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"))
    classes = scratch.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    size = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    lists = max(1, math.ceil(size["n"] / (LIST_SIZE * max(1, size["labels"]))))
    wanted = min(SAMPLE_MOST, max(SAMPLE_VECTORS, FIT_SIZE * lists))
    lists = min(lists, wanted // FIT_SIZE)
    sample = hash_sample(classes.select("name", "embedding"), "name", wanted, size["n"]).toArrow().sort_by("name").column("embedding").combine_chunks()
    dims = np.diff(sample.offsets.to_numpy())
    flat, starts = sample.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)])
    indexes = {}
    for dim in np.unique(dims):
        rows_of = np.flatnonzero(dims == dim)
        if len(rows_of) >= LEAST_VECTORS:  # a rare length has one list, and every pair of it is ranked
            indexes[int(dim)] = Index.fit(unit_vectors(np.stack([flat[starts[i] : starts[i] + dim] for i in rows_of])), lists)
    radius = math.sqrt(2 - 2 * least) + 1e-6

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            vecs = b.column(3)
            dims = np.diff(vecs.offsets.to_numpy(zero_copy_only=False))
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.concatenate([[0], np.cumsum(dims)])
            cell, error = np.zeros(n, np.int32), np.zeros(n)
            codes: list = [b""] * n
            probes: list = [[] for _ in range(n)]
            for dim in np.unique(dims):
                if int(dim) not in indexes:
                    continue
                index, at = indexes[int(dim)], np.flatnonzero(dims == dim)
                points = unit_vectors(np.stack([flat[starts[i] : starts[i + 1]] for i in at]))
                cells = nearest(points, index.centres)
                code, err = index.encode(points, cells)
                cell[at], error[at] = cells, err
                for i, c in zip(at, code):
                    codes[i] = c.tobytes()
                for j, near in index.probes(points, cells, radius):
                    for i in near:
                        probes[at[i]].append(j)
            raw = [flat[a:z].tobytes() for a, z in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(cell), pa.array(codes, pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
                names=["cid", "mult", "label", "dim", "vec", "cell", "codes", "error", "probes"],
            )

    assigned = scratch.write(classes.select("cid", "mult", "label", "embedding").mapInArrow(assign, _ASSIGNED.format(label=label)), "assigned")
    blocks = assigned.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK_SIZE).cast("int").alias("blocks"))
    blocks = scratch.write(blocks, "blocks")
    block = F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    keys = ["label", "dim", "cell"]
    held = assigned.drop("probes").join(blocks, keys).withColumn("m", block)
    members = held.select(*keys, "m", every.alias("q"), "cid", "mult", "vec", "codes", "error", F.lit(False).alias("query"), F.lit(True).alias("own"))
    inside = held.select(*keys, every.alias("m"), F.col("m").alias("q"), "cid", "mult", "vec", "codes", "error", F.lit(True).alias("query"), F.lit(True).alias("own"))
    probing = assigned.select("label", "dim", F.explode("probes").alias("cell"), "cid", "mult", "vec", "codes", "error").join(blocks, keys)
    probing = probing.withColumn("q", block).select(*keys, every.alias("m"), "q", "cid", "mult", "vec", "codes", "error", F.lit(True).alias("query"), F.lit(False).alias("own"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        return link_unit(frame, indexes, least, kind)[0]

    units = members.unionByName(inside).unionByName(probing).groupBy(*keys, "m", "q")
    found = scratch.write(units.applyInPandas(link, "cid long, links long, root long"), "links")
    roots = connected_components(scratch, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = classes.select("cid", *NAME, "mult", "rep").join(links, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    linked = scratch.write(linked.withColumn("root", F.coalesce("root", "cid")), "linked")
    least_id = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = linked.join(least_id, "root").select(*NAME, (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    ok = rows.where("valid").select("vec_id", *NAME).join(per_class, NAME).select("vec_id", "n_links", "component_id")
    rest = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
