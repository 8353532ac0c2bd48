"""Dataset generator: directed circulant graphs with hub rewrites, from ranges, without randomness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    vertices: int
    base_degree: int
    hub_out_degree: int = 0  # of the last vertex; 0: no hub
    in_hubs: tuple[tuple[int, int, int], ...] = ()  # (target, first source, sources)
    edge_slice_size: int = 8192

    @property
    def edges(self) -> int:
        return self.vertices * self.base_degree


# The four profiles.
PROFILES = {
    "reduced-skew": Profile(101, 4, 25, ((0, 25, 21), (1, 46, 5), (2, 51, 5)), 4),
    "scale": Profile(1_000_000, 40),
    "skew": Profile(1_000_000, 50, 50_000, ((0, 50_000, 49_950), (1, 99_950, 16_335), (2, 116_285, 16_335))),
    "scenario-b": Profile(10_000_000, 4),
}


def generate(spark: SparkSession, profile: str | Profile) -> DataFrame:
    """src, dst of a profile.

    Source s points to (s + o) mod V for o in 1..B.  If the last vertex is a hub, the first sources give up offset B and
    it points to the vertices from B on in their place; in the block of an in-hub, offset 1 is replaced by its target.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    s, o = F.col("s"), F.col("o")
    target = (s + o) % p.vertices
    for hub, first, count in p.in_hubs:
        target = F.when((o == 1) & s.between(first, first + count - 1), F.lit(hub)).otherwise(target)
    base = spark.range(p.vertices).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(p.base_degree))).alias("o"))
    donors = p.hub_out_degree - p.base_degree
    edges = base.where(~((o == p.base_degree) & (s < max(donors, 0)))).select(s.cast("int").alias("src"), target.cast("int").alias("dst"))
    if donors > 0:
        hub = spark.range(p.base_degree, p.hub_out_degree).select(F.lit(p.vertices - 1).alias("src"), F.col("id").cast("int").alias("dst"))
        edges = edges.unionByName(hub)
    return edges


def verify(found: DataFrame, profile: str | Profile) -> DataFrame:
    """kind, n: rows missing from and surplus in a generated table, duplicates counted."""
    wanted = generate(found.sparkSession, profile)
    missing = wanted.exceptAll(found).agg(F.count("*").alias("n")).select(F.lit("missing").alias("kind"), "n")
    surplus = found.exceptAll(wanted).agg(F.count("*").alias("n")).select(F.lit("surplus").alias("kind"), "n")
    return missing.unionByName(surplus)
