"""A generated graph as an edge CSV with a manifest of its bytes and degrees, published as one folder and checked again."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, PublicationError
from ..operators import graph as G
from ..plans.scratch import Scratch
from .edge_csv import read_edge_csv
from .generator import PROFILES, Profile, generate, verify
from .rank_csv import join_parts

EDGES, MANIFEST, HEADER = "edges.csv", "manifest.json", b"from,to\n"


def degree_counts(edges: DataFrame) -> DataFrame:
    """direction, degree, vertices: both degree histograms of distinct edges (src, dst), vertices without edges of that direction left out."""
    found = [G.degree_histogram(edges.groupBy(c).agg(F.count("*").alias("degree"))).select(F.lit(name).alias("direction"), "degree", "vertices") for name, c in (("out", "src"), ("in", "dst"))]
    return found[0].unionByName(found[1])


def _statistics(edges: DataFrame, slice_size: int) -> dict:
    """Histograms, the extremes, and how many vertices have how many slices of incoming edges; rows as distinct degrees."""
    counts = degree_counts(edges).collect()
    found: dict = {}
    for direction in ("in", "out"):
        own = sorted((r["degree"], r["vertices"]) for r in counts if r["direction"] == direction)
        found[f"{direction}_degrees"] = [{"degree": d, "vertices": n} for d, n in own]
        found[f"most_{direction}"], found[f"least_{direction}"] = own[-1][0], own[0][0]
    slices: dict[int, int] = {}
    for row in found["in_degrees"]:
        k = -(-row["degree"] // slice_size)
        slices[k] = slices.get(k, 0) + row["vertices"]
    found["in_slices"] = [{"slices": k, "vertices": n} for k, n in sorted(slices.items())]
    return found


def _encode(manifest: dict) -> str:
    return json.dumps(manifest, sort_keys=True, separators=(",", ":")) + "\n"


def _digest(path: str) -> dict:
    with open(path, "rb") as f:
        return {"sha256": hashlib.file_digest(f, "sha256").hexdigest(), "bytes": os.path.getsize(path)}


def _described(spark: SparkSession, folder: str, name: str, profile: Profile) -> dict:
    path = os.path.join(folder, EDGES)
    edges = read_edge_csv(spark, f"file://{os.path.abspath(path)}")
    return {
        "complete": True,
        "profile": name,
        "construction": {"kind": "directed-circulant", **asdict(profile)},
        "graph": {"directed": True, "unique_edges": True, "vertex_count": profile.vertices, "edge_count": profile.edges},
        "dataset": {"path": EDGES, "format": "edge-csv", "header": HEADER.decode().strip(), "line_ending": "LF", "final_newline": True, **_digest(path)},
        "statistics": _statistics(edges, profile.edge_slice_size),
    }


def write_dataset(spark: SparkSession, name: str, folder: str) -> dict:
    """Write a profile's edges, by source and then target, and the manifest; an existing folder is never replaced."""
    if os.path.lexists(folder):
        raise PublicationError(f"output exists: {folder}", "target_exists")
    profile = PROFILES[name]
    scratch = Scratch(spark, "dataset")
    staging = f"{os.path.abspath(folder)}.staging-{uuid.uuid4().hex}"
    os.mkdir(staging)
    try:
        generate(spark, profile).orderBy("src", "dst").select(F.concat_ws(",", "src", "dst").alias("line")).write.text(f"{scratch.root}/lines")
        with open(f"{staging}/{EDGES}", "xb") as out:
            out.write(HEADER)
            lines = join_parts(spark, f"{scratch.root}/lines", out)
            out.flush()
            os.fsync(out.fileno())
        if lines != profile.edges:
            raise PublicationError(f"wrote {lines} of {profile.edges} lines")
        manifest = _described(spark, staging, name, profile)
        with open(f"{staging}/{MANIFEST}", "x") as out:
            out.write(_encode(manifest))
            out.flush()
            os.fsync(out.fileno())
        try:
            os.mkdir(folder)  # takes the name, or fails if it is taken
        except FileExistsError:
            raise PublicationError(f"output exists: {folder}", "target_exists") from None
        os.rename(staging, folder)  # onto the empty folder, in one step
    finally:
        scratch.drop("lines")
        shutil.rmtree(staging, ignore_errors=True)
    return manifest


def verify_dataset(spark: SparkSession, folder: str) -> dict:
    """The manifest of a folder whose file has its bytes, its degrees, and exactly the edges of its profile; DataError otherwise."""
    try:
        with open(os.path.join(folder, MANIFEST)) as f:
            text = f.read()
        manifest = json.loads(text)
        if _encode(manifest) != text:
            raise DataError("manifest is not canonical")
        profile = PROFILES[manifest["profile"]]
    except (ValueError, KeyError, TypeError) as e:
        raise DataError(f"manifest: {e}") from None
    if _digest(os.path.join(folder, EDGES)) != {k: manifest["dataset"][k] for k in ("sha256", "bytes")}:
        raise DataError("edges differ from the manifest")
    found = json.loads(_encode(_described(spark, folder, manifest["profile"], profile)))
    if found != manifest:
        raise DataError("manifest differs from the edges")
    edges = read_edge_csv(spark, f"file://{os.path.abspath(os.path.join(folder, EDGES))}").select("src", "dst")
    if any(r["n"] for r in verify(edges, profile).collect()):
        raise DataError("edges differ from the profile")
    return manifest
