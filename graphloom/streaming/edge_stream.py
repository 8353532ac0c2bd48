"""An extension: edges that arrive as files, taken up to now, into a table of raw edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.edge_csv import parse_lines


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst of all well-formed lines of the CSV files that come into a folder."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return parse_lines(lines).where("ok").select("src", "dst")


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to a Parquet table, each file once."""
    writer = edge_stream(spark, folder).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
