"""Pieces that the training-data operators share.

* scratch tables in the folder the cluster names in ``spark.checkpoint.dir``
* Arrow string columns seen as one byte buffer with offsets, in bounded blocks
* rolling hashes over those buffers
* connected components of a link table
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import scratch as plans

#: Bytes of text that one numpy block holds, unless one document alone is longer.
BLOCK_BYTES = 1 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of an Arrow batch: a worker holds a few of them beside what an operator needs.
BATCH_BYTES = "4m"


class Scratch(plans.Scratch):
    """Scratch tables of an operator whose Arrow batches are small, so that workers stay within an executor's memory."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        small_batches(spark)


def small_batches(spark: SparkSession) -> None:
    """Documents may be long, so batches are bounded by bytes; a setting of the session that only affects their size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    text = F.col(text) if isinstance(text, str) else text
    return F.translate(text, _UPPER, _UPPER.lower())


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    as_text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(as_text.cast("binary")) % modulus


def hash_sample(df: DataFrame, column: str, wanted: int, count: int) -> DataFrame:
    """About ``wanted`` of ``count`` rows, chosen by a hash of a column, the same in every run."""
    if count <= wanted:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(column)), F.lit(1 << 30)) < int(wanted / count * (1 << 30)))


# --------------------------------------------------------------------------- Arrow buffers


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if large else np.int32
    buffers = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_blocks(array: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    data, offsets = string_buffer(array)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# --------------------------------------------------------------------------- hashing

MULTIPLIER = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8: its powers have the longest period
_M64 = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MULTIPLIER**k and its inverse powers modulo 2**64 for k < size."""
    if "up" not in _powers or len(_powers["up"]) < size:
        size = max(size, BLOCK_BYTES + 4096)
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        for key, base in (("up", MULTIPLIER), ("down", inverse)):
            steps = np.full(size, np.uint64(base & _M64))
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:size], _powers["down"][:size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shift-free hash of codes[start:end] for each span."""
    up, down = power_table(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pack(names: np.ndarray, buckets: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, first, last, bytes) of ascending names; ``width`` bytes of each are sent."""
    bits = buckets.bit_length() - 1
    cuts = np.searchsorted(names, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.concatenate([[0], cuts, [len(names)]])
    raw = (names << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
    for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
        yield int(k), int(cuts[k]), int(cuts[k + 1]), np.ascontiguousarray(raw[cuts[k] : cuts[k + 1]]).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(raw) // width, 8), np.uint8)
    x[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return x.view(">u8").ravel().astype(np.uint64)


def class_table(kind: str) -> np.ndarray:
    """256 booleans: the bytes of words.

    ``blank``: all but 0x20 and 0x09-0x0D.  ``alnum``: 0-9, A-Z, a-z and every byte of a non-ASCII character.
    """
    codes = np.arange(256)
    if kind == "blank":
        return ~((codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D)))
    letters = ((codes | 0x20) >= 0x61) & ((codes | 0x20) <= 0x7A)
    return letters | ((codes >= 0x30) & (codes <= 0x39)) | (codes >= 0x80)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a row."""
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = table[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


#: Scripts without spaces: code points from, to.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x312F),
    (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


@functools.cache
def character_classes(table: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 0 parts words, 1 is of a word, 2 is a word of its own; and the first bytes of characters that are not 1."""
    kinds = np.ones(0x110000, np.uint8)
    if table == "alnum":
        kinds[0x80:0x20000] = [unicodedata.category(chr(c))[0] not in "PZC" for c in range(0x80, 0x20000)]
    for first, last in UNSPACED:
        kinds[first : last + 1] *= 2
    leads = np.zeros(256, np.bool_)
    leads[[chr(c).encode("utf-8", "surrogatepass")[0] for c in range(0x80, 0x110000, 0x40) if (kinds[c : c + 0x40] != 1).any()]] = True
    return kinds, leads


def unit_spans(data: np.ndarray, offsets: np.ndarray, table: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; characters of scripts without spaces are words each."""
    kinds, leads = character_classes(table)
    at = np.flatnonzero(leads[data])
    if not len(at):
        return word_spans(data, offsets, class_table(table))
    size = 2 + (data[at] >= 0xE0).astype(np.int64) + (data[at] >= 0xF0)
    code = data[at].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F
    kind, end = kinds[np.minimum(code, 0x10FFFF)], np.minimum(at + size, len(data))
    inside = np.zeros(len(data) + 2, np.bool_)
    inside[1:-1] = class_table(table)[data]
    parts = kind == 0
    for k in range(4):
        gone = at[parts] + k
        inside[gone[gone < end[parts]] + 1] = False
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = np.concatenate([edges, at[kind == 2], end[kind == 2]])
    first, last = cuts[cuts < len(data)], cuts[cuts > 0] - 1
    begins[first] = inside[1:-1][first]
    ends[last] = inside[1:-1][last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


# --------------------------------------------------------------------------- components


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes under links a-b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root[root], root):
            root = root[root]
        if np.array_equal(root, before):
            return root


def connected_components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): nodes of one component have one root.  ``edges`` has the long columns a and b.

    Contraction: every node goes to the neighbour, or itself, that comes first in a random order new in each round;
    the edges between the targets are the next round's graph.  A round shrinks it by a constant factor, so the rounds
    grow with the logarithm of the nodes.  Each is written to the shared folder.  Nothing is collected but one count a round.
    """
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.write(edges.where("a <> b").select(pair.alias("p")).select("p.*").distinct(), f"{name}-e0")
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        k = len(steps)
        order = lambda c: F.xxhash64(F.lit(k), F.col(c))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("v"))).alias("m"))
        target = F.when(F.col("m.o") < order("a"), F.col("m.v")).otherwise(F.col("a"))
        step = scratch.write(best.select(F.col("a").alias("node"), target.alias("to")), f"{name}-m{k}")
        steps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").where("a2 <> b2")
        moved = moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = scratch.write(moved, f"{name}-e{k + 1}")
        scratch.drop(f"{name}-e{k}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        found = found.join(later, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    return scratch.write(found.select("node", F.col("to").alias("root")), f"{name}-roots")
