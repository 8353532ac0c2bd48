"""Strict edge CSV: header ``from,to``, canonical signed 32-bit integers, LF or CRLF, nothing else.

The text source splits and parses in parallel.  Only when a row is bad are lines numbered, by counting those before the
first bad one, and only that line is diagnosed on the driver.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, EdgeCsvError
from ..operators.graph import INT_MAX, INT_MIN

# The header and the messages for malformed input, in the order in which a reader meets them.
HEADER = "from,to"
BOM = "UTF-8 BOM is not allowed"
NO_HEADER = "expected exact header from,to"
AFTER_HEADER = "unexpected byte after exact header from,to"
OPEN_HEADER = "missing or unterminated header from,to"
LONE_CR = "carriage return must be followed by line feed"
NOT_CANONICAL = "integer must use canonical decimal form"
OUT_OF_RANGE = "integer is outside signed int32 range"
BLANK = "blank data line is not allowed"
INCOMPLETE = "blank or incomplete data line"
NO_SOURCE = "missing source integer"
QUOTED = "quoted fields are not allowed"
BAD_SOURCE = "invalid source integer"
LONE_MINUS = "minus sign must be followed by a digit"
NO_FIELD = "missing destination field"
SOURCE_JUNK = "trailing junk in source field"
EXTRA = "extra CSV field"
NO_DESTINATION = "missing destination integer"
BAD_DESTINATION = "invalid destination integer"
DESTINATION_JUNK = "trailing junk in destination field"
EMPTY = "input has an empty vertex universe"
LEAST_BYTES = len(HEADER) + 1 + len("0,0")
ROW = r"\A[ \t]*(0|-?[1-9][0-9]{0,9})[ \t]*,[ \t]*(0|-?[1-9][0-9]{0,9})[ \t]*\r?\z"


def _bytes(spark: SparkSession, path: str) -> tuple[int, bytes, int]:
    """(size, first bytes, last byte) through the file system that Spark uses."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(target)
    if status.isDirectory():
        raise DataError(f"input is not a regular file: {path}")
    size, stream = status.getLen(), files.open(target)
    try:
        head = bytearray()
        while len(head) < len(HEADER) + 4 and (b := stream.read()) >= 0:
            head.append(b)
        last = -1
        if size:
            stream.seek(size - 1)
            last = stream.read()
    finally:
        stream.close()
    return size, bytes(head), last


def check_header(head: bytes, size: int) -> None:
    """Raise for a head that does not begin with the exact header line."""
    if head[:1] == b"\xef":
        raise EdgeCsvError(1, BOM)
    name = HEADER.encode()
    if head[: len(name)] != name[: len(head)] or len(head) < len(name) and size > len(head):
        raise EdgeCsvError(1, NO_HEADER)
    rest = head[len(name) :]
    if len(head) < len(name) or not rest:
        raise EdgeCsvError(1, OPEN_HEADER)
    if rest[:1] == b"\r":
        if rest[1:2] != b"\n":
            raise EdgeCsvError(1, LONE_CR)
        rest = rest[1:]
    elif rest[:1] != b"\n":
        raise EdgeCsvError(1, AFTER_HEADER)
    if len(rest) == 1 and size == len(head):
        raise EdgeCsvError(2, EMPTY)


class _Line:
    def __init__(self, text: str, ended: bool):
        self.text, self.ended, self.at = text, ended, 0

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def peek(self) -> str:
        """The next character; LF at the end of a line, empty at the end of the input."""
        return self.text[self.at] if self.at < len(self.text) else "\n" if self.ended else ""

    def integer(self, invalid: str) -> str | None:
        """What is wrong with the integer here, if anything."""
        if minus := self.peek() == "-":
            self.at += 1
            if not ("0" <= self.peek() <= "9" and self.peek()):
                return LONE_MINUS
        digits = ""
        while self.peek() and "0" <= self.peek() <= "9":
            digits += self.peek()
            if digits[0] == "0" and (minus or len(digits) > 1):
                return NOT_CANONICAL
            if not INT_MIN <= int(("-" if minus else "") + digits) <= INT_MAX:
                return OUT_OF_RANGE
            self.at += 1
        return None if digits else invalid


def diagnose(text: str, ended: bool) -> str | None:
    """What is wrong with a data line; ``ended``: a line feed follows it."""
    line = _Line(text, ended)
    line.blanks()
    c = line.peek()
    if c in ("\n", "\r"):
        return BLANK
    if c == "":
        return INCOMPLETE
    if c == ",":
        return NO_SOURCE
    if c == '"':
        return QUOTED
    if wrong := line.integer(BAD_SOURCE):
        return wrong
    line.blanks()
    c = line.peek()
    if c in ("\n", "\r", ""):
        return NO_FIELD
    if c != ",":
        return SOURCE_JUNK
    line.at += 1
    line.blanks()
    c = line.peek()
    if c == ",":
        return EXTRA
    if c in ("\n", "\r", ""):
        return NO_DESTINATION
    if c == '"':
        return QUOTED
    if wrong := line.integer(BAD_DESTINATION):
        return wrong
    line.blanks()
    c = line.peek()
    if c == ",":
        return EXTRA
    if c == "\r":
        line.at += 1
        return None if line.peek() == "\n" else LONE_CR
    return None if c in ("\n", "") else DESTINATION_JUNK


def parse_lines(lines: DataFrame) -> DataFrame:
    """src, dst, ok of text rows (value); header rows have ok null.

    Lines that two integers written out give again need no pattern; blanks and carriage returns take the long way.
    """
    plain = lambda k: F.substring_index("value", ",", k).try_cast("int")
    lines = lines.withColumn("p", plain(1)).withColumn("q", plain(-1))
    lines = lines.withColumn("exact", F.coalesce(F.concat(F.col("p").cast("string"), F.lit(","), F.col("q").cast("string")) == F.col("value"), F.lit(False)))
    part = lambda k: F.regexp_extract("value", ROW, k)
    value = lambda k, c: F.when(F.col("exact"), F.col(c).cast("long")).when(part(k) != "", part(k).cast("long"))
    parsed = lines.withColumn("s", value(1, "p")).withColumn("d", value(2, "q")).drop("p", "q", "exact")
    inside = lambda c: F.coalesce(F.col(c).between(INT_MIN, INT_MAX), F.lit(False))
    ok = F.when(F.col("value").isin(HEADER, HEADER + "\r"), F.lit(None)).otherwise(inside("s") & inside("d"))
    parsed = parsed.withColumn("ok", ok)
    return parsed.select("*", F.when(F.col("ok"), F.col("s")).cast("int").alias("src"), F.when(F.col("ok"), F.col("d")).cast("int").alias("dst"))


def read_edge_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """src, dst of an edge CSV; with ``check``, one pass first proves every line well formed."""
    size, head, last = _bytes(spark, path)
    if size < LEAST_BYTES:
        raise DataError("input is shorter than the smallest edge CSV")
    check_header(head, size)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    parsed = parse_lines(lines)
    if check:
        seen = parsed.agg(F.count(F.when(~F.col("ok"), 1)).alias("bad"), F.count(F.when(F.col("ok").isNull(), 1)).alias("headers"), F.count(F.when(F.col("ok"), 1)).alias("good")).first()
        if seen["bad"] or seen["headers"] != 1 or last == 0x0D:
            raise _first_error(parsed, last)
        if not seen["good"]:
            raise EdgeCsvError(2, EMPTY)
    return parsed.where("ok").select("src", "dst")


def _first_error(parsed: DataFrame, last: int) -> EdgeCsvError:
    order = F.struct("block", "row")
    ends = parsed.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).first()
    wrong = (~F.coalesce("ok", F.lit(False))) & (order != F.struct(F.lit(ends["first"]["block"]).alias("block"), F.lit(ends["first"]["row"]).alias("row")))
    if last == 0x0D:
        wrong = wrong | (order == F.struct(F.lit(ends["last"]["block"]).alias("block"), F.lit(ends["last"]["row"]).alias("row")))
    found = parsed.where(wrong).agg(F.min(F.struct("block", "row", "value")).alias("m")).first()["m"]
    here = F.struct(F.lit(found["block"]).alias("block"), F.lit(found["row"]).alias("row"))
    number = parsed.where(order < here).count() + 1
    ended = number < ends["n"] or last == 0x0A
    return EdgeCsvError(number, diagnose(found["value"], ended) or LONE_CR)


class InputGuard:
    """A local input file that must be regular, no link, and unchanged while it is read."""

    def __init__(self, path: str):
        self.path, self.seen = path, self._look(path)

    @staticmethod
    def _look(path: str) -> tuple[int, ...]:
        found = os.lstat(path)
        if not stat.S_ISREG(found.st_mode):
            raise DataError(f"input is not a regular file: {path}")
        return found.st_dev, found.st_ino, found.st_size, found.st_mtime_ns

    def verify(self) -> None:
        if self._look(self.path) != self.seen:
            raise DataError(f"input changed while being read: {self.path}")
