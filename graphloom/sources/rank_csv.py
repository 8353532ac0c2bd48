"""Rank CSV: ordered rows, published at once and never over an existing file."""

from __future__ import annotations

import errno
import os
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, DurabilityError, PublicationError
from ..functions.text import rank_lines
from ..plans.scratch import Scratch

# The header, and messages for bad ranks.
HEADER = "vertex,rank"
NO_ROWS = "rank CSV requires at least one row"
NOT_FINITE = "rank must be finite"
NOT_UNIQUE = "vertex IDs must be unique and strictly increasing"


def check_output(path: str, graph: str | None = None) -> None:
    """The output must not exist, its folder must be a real one, and it must lie outside the published graph."""
    parent = os.path.dirname(os.path.abspath(path))
    if os.path.lexists(path):
        raise PublicationError(f"output exists: {path}", "target_exists")
    if os.path.islink(parent) or not os.path.isdir(parent):
        raise PublicationError(f"output folder is not a directory: {parent}")
    if graph is not None:
        kept = os.path.realpath(graph.removeprefix("file://"))
        if os.path.commonpath([kept, os.path.realpath(parent)]) == kept:
            raise PublicationError(f"output lies inside the graph: {path}")


def rank_csv_lines(ranks: DataFrame) -> DataFrame:
    """line, in the order of the file without its header."""
    return rank_lines(ranks).orderBy("vertex").select("line")


def write_rank_csv(ranks: DataFrame, path: str, graph: str | None = None) -> None:
    """Ranks sorted in parallel in the shared folder, parts joined in order beside the output, counted, synced, and linked to its name.

    ``graph``: the folder of the published graph they come from, if any, which stays as it is.
    """
    check_output(path, graph)
    scratch = Scratch(ranks.sparkSession, "ranks")
    ranks = scratch.write(ranks.select("vertex", "rank"), "ranks")
    seen = ranks.agg(F.count("*").alias("n"), F.countDistinct("vertex").alias("ids"), F.count(F.when(F.isnan("rank") | (F.abs("rank") == float("inf")) | F.col("rank").isNull(), 1)).alias("bad")).first()
    if not seen["n"]:
        raise DataError(NO_ROWS)
    if seen["bad"]:
        raise DataError(NOT_FINITE)
    if seen["ids"] != seen["n"]:
        raise DataError(NOT_UNIQUE)
    parent = os.path.dirname(os.path.abspath(path))
    whole = os.path.join(parent, f".ranks-{uuid.uuid4().hex}")
    try:
        parts = f"{scratch.root}/lines"
        rank_csv_lines(ranks).write.text(parts)
        with open(whole, "xb") as out:
            out.write(f"{HEADER}\n".encode())
            lines = join_parts(ranks.sparkSession, parts, out)
            out.flush()
            os.fsync(out.fileno())
        if lines != seen["n"]:
            raise PublicationError(f"wrote {lines} of {seen['n']} lines")
        try:
            os.link(whole, path)  # fails if the name is taken
        except FileExistsError:
            raise PublicationError(f"output exists: {path}", "target_exists") from None
        except OSError as e:
            if e.errno in (errno.EPERM, errno.ENOTSUP, errno.ENOSYS):
                raise PublicationError(f"the file system cannot publish without replacing: {path}", "no_replace_unsupported") from None
            raise
    finally:
        scratch.drop("lines", "ranks")
        if os.path.exists(whole):
            os.unlink(whole)
    try:
        folder = os.open(parent, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)
    except OSError as e:
        raise DurabilityError(str(e)) from None


def join_parts(spark: SparkSession, folder: str, out: BinaryIO) -> int:
    """Append the part files of a folder in order, through the file system that Spark uses; the number of their lines."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(target) if x.getPath().getName().startswith("part-")]
    lines = 0
    for part in sorted(found, key=lambda p: int(p.getName().split("-")[1])):
        if part.toUri().getScheme() == "file":  # a folder that the driver sees itself
            with open(part.toUri().getPath(), "rb") as f:
                while block := f.read(1 << 22):
                    out.write(block)
                    lines += block.count(b"\n")
            continue
        stream, left = files.open(part), files.getFileStatus(part).getLen()
        try:
            while left:
                size = min(left, 1 << 22)
                block = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
                out.write(block)
                lines += block.count(b"\n")
                left -= size
        finally:
            stream.close()
    return lines
