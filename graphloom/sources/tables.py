"""Edge tables from Parquet and graphs derived from business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import dense_index

SUPPLIERS, PARTS = 1_000_000, 2_000_000


def read_edges(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges from a Parquet table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(src).cast("int").alias("src"), F.col(dst).cast("int").alias("dst"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier for each ordered line, supplier to part for each line; duplicates stand as in the tables."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    buys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    buys = buys.select(F.col("o_custkey").cast("int").alias("src"), (F.col("l_suppkey") + SUPPLIERS).cast("int").alias("dst"))
    makes = lines.select((F.col("l_suppkey") + SUPPLIERS).cast("int").alias("src"), (F.col("l_partkey") + PARTS).cast("int").alias("dst"))
    return buys.unionByName(makes)


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event's user to the next event's user, in order of time and event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
    placed = dense_index(events, ["ts", "event_id"], "place").select("place", "user_id")
    after = placed.select((F.col("place") - 1).alias("place"), F.col("user_id").alias("next"))
    return placed.join(after, "place").select(F.col("user_id").cast("int").alias("src"), F.col("next").cast("int").alias("dst"))


def trade_ge(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Customer nation to supplier nation where at least so many lines go."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines = table("lineitem").select("l_orderkey", "l_suppkey").join(table("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    lines = lines.join(table("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    lines = lines.join(table("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    pairs = lines.groupBy(F.col("c_nationkey").cast("int").alias("src"), F.col("s_nationkey").cast("int").alias("dst")).count()
    return pairs.where(F.col("count") >= least).select("src", "dst")
