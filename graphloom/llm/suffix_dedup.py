"""Suffix-array deduplication by a distributed difference cover.

Only the order of suffixes up to ``length`` bytes matters here: which of them share that prefix with another.  So the
difference cover has the modulus v = q*q + q + 1 for a prime q in place of 3, and names are fingerprints sorted in
buckets in place of global ranks; the steps are those of the algorithm.

1. Sampled tuples.  Positions whose residue modulo v lies in a difference cover are sampled, one in q nearly.  For any two
   positions there is a shift below v that makes both sampled, so two equal strings of ``length`` bytes hold equal tuples
   of ``length`` - v + 1 bytes at sampled places.  The tuples' names are dealt out by bucket, sorted, and equal neighbours
   marked.  Documents without a mark are finished.
2. Recursion on names.  The marked samples get longer names: all bytes within which a repeated string around them could
   lie.  Equal ones settle all v starts before them at once, so copies and the inside of long repeats end here, whatever
   their number; one of each name stands for the rest.
3. Remaining suffixes.  Only starts beside the ends of repeats are left.  They are merged with the representatives, sorted
   by the name of their ``length``-byte prefix, and compared with their neighbours.

Names go from chunks of documents to buckets as packed bytes, and single bits come back; no pair is ever written.  A name
has 64 bits and comes once from a chunk, so no bucket fills with one string.  Chunks are written to the shared folder.

Symbols are bytes, or words with ``words``: runs of non-blank characters, and each character of a script without spaces.
Then a string must stand in two documents: what one document says again and again is not a passage.  So names count once
for a document, and two documents stand for the rest of equal samples.
Passages of words go from the first word to the last, with the blanks between, however these differ.

Defined results: null text is empty; texts shorter than ``length`` keep all; repeated rows and copies are documents each, so
they lose what they share; a null doc_id is kept as it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Scratch, byte_codes, mix64, pack, power_table, span_hashes, string_buffer, unit_spans, unpack

LENGTH = 400
#: The prime of the difference cover.
PRIME = 13
#: Names, about, in one bucket; buckets are a power of two, and this many at least.
BUCKET_NAMES = 1 << 21
LEAST_BUCKETS = 256
#: Words of a passage, and the prime of their difference cover.
PASSAGE_WORDS, WORD_PRIME = 50, 5

_CODES = byte_codes(29)


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, residues): every difference modulo v = q*q + q + 1 is one of two of the q + 1 residues.

    They are the zeros of a linear recurrence of third order modulo the prime q; the first that works is taken.
    """
    v = q * q + q + 1
    for code in range(q**3):
        a, b, c = code // q // q, code // q % q, code % q
        x, zeros = [0, 0, 1], []
        for i in range(v):
            if x[0] == 0:
                zeros.append(i)
            x = [x[1], x[2], (a * x[2] + b * x[1] + c * x[0]) % q]
        if len(zeros) == q + 1 and len({(i - j) % v for i in zeros for j in zeros}) == v:
            return v, np.array(zeros)
    raise ValueError(f"{q} is not a prime")


def window_names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of data[p : p + length] for ascending places p; length is 8 at least."""
    out = np.empty(len(at), np.uint64)
    for first in range(0, len(data), BLOCK_BYTES):
        i, j = np.searchsorted(at, (first, first + BLOCK_BYTES))
        if i == j:
            continue
        x = data[first : first + BLOCK_BYTES + length].astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)  # eight bytes each
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        up, down = power_table(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        p = at[i:j] - first
        out[i:j] = mix64((sums[p + length - 7] - sums[p]) * down[p] + np.uint64(length))
    return out


def sampled(offsets: np.ndarray, v: int, cover: np.ndarray, size: int) -> np.ndarray:
    """Sampled places with ``size`` bytes of their document after them."""
    n = int(offsets[-1])
    at = (np.arange(0, n, v)[:, None] + cover[None]).ravel()
    at = at[at + size <= n]
    return at[at + size <= offsets[np.searchsorted(offsets, at, side="right")]]


def repeated(x: np.ndarray) -> np.ndarray:
    """Which values stand more than once."""
    order = np.argsort(x, kind="stable")
    same = np.zeros(len(x) + 1, np.bool_)
    same[1:-1] = x[order][1:] == x[order][:-1]
    out = np.empty(len(x), np.bool_)
    out[order] = same[1:] | same[:-1]
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


# --------------------------------------------------------------------------- chunks

_CHUNK = "chunk long, ids array<long>, keys array<long>, sizes array<long>, payload binary, places binary, open binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_CHUNK_ARROW = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()), ("places", pa.binary()), ("open", pa.binary())]
    + [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)
_NAMES = "bucket int, chunk long, names binary, more binary"
_NAMES_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("names", pa.binary()), ("more", pa.binary())])
_REPLY = "chunk long, bucket int, bits binary"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as chunks of about BLOCK_BYTES, chunks and documents named by task and order."""
    made, count, ids, sizes, parts, total = 0, 0, [], [], [], 0
    task = TaskContext.get().partitionId()

    def out() -> pa.RecordBatch:
        nonlocal made, count, ids, sizes, parts, total
        keys = [task << 40 | count + k for k in range(len(ids))]
        row = (task << 32 | made, ids, keys, sizes, b"".join(parts)) + (None,) * 7
        made, count, ids, sizes, parts, total = made + 1, count + len(ids), [], [], [], 0
        return _rows([row], _CHUNK_ARROW)

    for b in batches:
        data, offsets = string_buffer(b.column(1))
        for doc, i, j in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:]):
            if total and total + j - i > BLOCK_BYTES or len(ids) >= 20_000:
                yield out()
            ids.append(doc), sizes.append(j - i), parts.append(data[i:j].tobytes())
            total += j - i
    if ids:
        yield out()


class Repeats:
    """The three passes over chunks for one length: of bytes anywhere, or of words in two documents.

    With ``losers`` only documents that lose something have rows, without digests.
    """

    def __init__(self, length: int, prime: int, buckets: int, with_text: bool, words: bool = False, losers: bool = False):
        self.length, self.buckets, self.with_text, self.words, self.losers = length, buckets, with_text, words, losers
        while prime > 2 and prime * prime + prime + 1 > length - 8:
            prime -= 1
            while any(prime % k == 0 for k in range(2, prime)):
                prime -= 1
        self.v, self.cover = difference_cover(prime)
        self.tuple = length - self.v + 1

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """The symbols of a chunk, the n + 1 bounds of its documents, and for words where they stand."""
        if not self.words:
            return data, offsets, None
        starts, ends = unit_spans(data, offsets, "blank")
        return span_hashes(_CODES[data], starts, ends), np.searchsorted(starts, offsets), (starts, ends)

    def names(self, x: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Names of x[p : p + length] for ascending places p."""
        return span_hashes(x, at, at + length) if self.words else window_names(x, at, length)

    # -- pass 1: names of sampled tuples

    def tuples(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled places, the distinct names in order, the place of each among them, and how often each stands."""
        at = sampled(bounds, self.v, self.cover, self.tuple)
        names, place, count = np.unique(self.names(x, at, self.tuple), return_inverse=True, return_counts=True)
        return at, names, place, self.tally(bounds, at, place, count)

    def tally(self, bounds: np.ndarray, at: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often each string counts that stands ``count`` times: words by documents."""
        if not self.words or not len(at):
            return count
        owner = np.searchsorted(bounds, at, side="right") - 1
        return np.bincount(np.unique(place * len(bounds) + owner) // len(bounds), minlength=len(count))

    def send_tuples(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, offsets, data, _, _ in read_chunks(batches):
            x, bounds, _ = self.symbols(data, offsets)
            _, names, _, _ = self.tuples(x, bounds)
            yield _rows([(k, chunk, raw, None) for k, _, _, raw in pack(names, self.buckets, 6)], _NAMES_ARROW)

    def mark_tuples(self, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, 6) for x in frame["names"]]
        return reply(frame, parts, [repeated(np.concatenate(parts))])

    def keep_marked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finished documents, and chunks of the others with their marked places."""
        for chunk, ids, offsets, data, bits, _ in read_chunks(batches, reply=True):
            x, bounds, _ = self.symbols(data, offsets)
            at, names, place, count = self.tuples(x, bounds)
            marked = count > 1
            for k, first, last, _ in pack(names, self.buckets, 0):
                if k in bits:
                    marked[first:last] |= np.unpackbits(np.frombuffer(bits[k], np.uint8), count=last - first).astype(np.bool_)
            at = at[marked[place]]
            owner = np.searchsorted(bounds, at, side="right") - 1
            stay = np.zeros(len(ids), np.bool_)
            stay[owner] = True
            rows = [self.finished(ids[i], data[offsets[i] : offsets[i + 1]], None) for i in np.flatnonzero(~stay) if not self.losers]
            if stay.any():
                sizes = np.diff(offsets)[stay]
                moved = np.zeros(len(ids), np.int64)
                moved[stay] = np.concatenate([[0], np.cumsum(np.diff(bounds)[stay])[:-1]])
                payload = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in np.flatnonzero(stay))
                own, keys = zip(*(ids[i] for i in np.flatnonzero(stay)))
                rows.append((chunk, own, keys, sizes, payload, (at - bounds[owner] + moved[owner]).astype(np.int64).tobytes(), None) + (None,) * 5)
            for i in range(0, len(rows), 2000):
                yield _rows(rows[i : i + 2000], _CHUNK_ARROW)

    # -- pass 2: longer names of marked places

    def contexts(self, x: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct (tuple name, long name) in order, the first and last of each, the place of each, and how often it counts.

        A long name that would cross a document's end is 0.
        """
        owner = np.searchsorted(bounds, at, side="right") - 1
        whole = (at - self.v + 1 >= bounds[owner]) & (at + self.length <= bounds[owner + 1])
        long_ = np.zeros(len(at), np.uint64)
        long_[whole] = self.names(x, at[whole] - self.v + 1, self.length + self.v - 1) | np.uint64(1)
        pairs = np.empty(len(at), [("g", np.uint64), ("c", np.uint64)])
        pairs["g"], pairs["c"] = self.names(x, at, self.tuple), long_
        found, first, place, count = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
        last = np.zeros(len(found), np.int64)
        last[place] = np.arange(len(at))
        return found, first, last, place, self.tally(bounds, at, place, count)

    def send_contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, offsets, data, _, (at, _) in read_chunks(batches):
            x, bounds, _ = self.symbols(data, offsets)
            pairs, _, _, _, count = self.contexts(x, bounds, at)
            longs, many = pairs["c"].astype(">u8").view(np.uint8).reshape(-1, 8), (count > 1).astype(np.uint8)[:, None]
            more = np.concatenate([longs, many], axis=1)
            yield _rows([(k, chunk, raw, more[i:j].tobytes()) for k, i, j, raw in pack(pairs["g"], self.buckets, 8)], _NAMES_ARROW)

    def mark_contexts(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Of each entry: settled (its long name stands twice), open (its starts must be compared)."""
        parts = [unpack(x, 8) for x in frame["names"]]
        g = np.concatenate(parts)
        more = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 9) for x in frame["more"]])
        c, many = np.ascontiguousarray(more[:, :8]).view(">u8").ravel().astype(np.uint64), more[:, 8] > 0
        order = np.lexsort((np.arange(len(g)), c, g))
        g, c, many = g[order], c[order], many[order]
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
        in_c, in_g = np.cumsum(new_c) - 1, np.cumsum(new_g) - 1
        settled = (np.bincount(in_c, weights=1 + many)[in_c] > 1) & (c != 0)
        alone = ~settled
        asks = (np.bincount(in_g, weights=alone)[in_g] > 0) & (np.bincount(in_g, weights=1 + many)[in_g] > 1)
        for_c = new_c.copy()
        if self.words:  # two documents
            for_c[1:] |= new_c[:-1]
        opened = asks & (alone | for_c)
        masks = []
        for mask in (settled, opened):
            back = np.empty(len(g), np.bool_)
            back[order] = mask
            masks.append(back)
        return reply(frame, parts, masks)

    def settle(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with the starts that are settled and those that are open."""
        for chunk, ids, offsets, data, bits, (at, _) in read_chunks(batches, reply=True):
            x, bounds, _ = self.symbols(data, offsets)
            pairs, first, last, place, count = self.contexts(x, bounds, at)
            settled = (count > 1) & (pairs["c"] != 0)
            opened = np.zeros(len(pairs), np.bool_)
            for k, i, j, _ in pack(pairs["g"], self.buckets, 0):
                if k in bits:
                    both = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=2 * (j - i)).astype(np.bool_)
                    settled[i:j] |= both[: j - i]
                    opened[i:j] |= both[j - i :]
            ask = opened[place] & ((pairs["c"] == 0)[place] | (count == 1)[place])
            for_rest = opened & (pairs["c"] != 0) & (count > 1)
            ask[first[for_rest]] = True
            if self.words:
                ask[last[for_rest]] = True
            starts = self.before(bounds, at[settled[place]])
            asked = self.before(bounds, at[ask])
            yield _rows([(chunk, *zip(*ids), np.diff(offsets), data.tobytes(), starts.tobytes(), asked.tobytes()) + (None,) * 5], _CHUNK_ARROW)

    def before(self, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(first, last) runs of the starts within v before each place that have ``length`` symbols in the document."""
        owner = np.searchsorted(offsets, at, side="right") - 1
        low = np.maximum(at - self.v + 1, offsets[owner])
        high = np.minimum(at + 1, offsets[owner + 1] - self.length + 1)
        edge = np.zeros(int(offsets[-1]) + 2, np.int32)
        good = low < high
        np.add.at(edge, low[good], 1)
        np.add.at(edge, high[good], -1)
        return np.stack(runs(np.cumsum(edge) > 0), axis=1).astype(np.int64)

    # -- pass 3: the remaining starts

    def send_starts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, offsets, data, _, (_, opened) in read_chunks(batches):
            x, _, _ = self.symbols(data, offsets)
            names = np.unique(self.names(x, expand(opened), self.length))
            yield _rows([(k, chunk, raw, None) for k, _, _, raw in pack(names, self.buckets, 8)], _NAMES_ARROW)

    def mark_starts(self, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(x, 8) for x in frame["names"]]
        return reply(frame, parts, [repeated(np.concatenate(parts))])

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, offsets, data, bits, (settled, opened) in read_chunks(batches, reply=True):
            x, bounds, spans = self.symbols(data, offsets)
            at = expand(opened)
            names, place, count = np.unique(self.names(x, at, self.length), return_inverse=True, return_counts=True)
            twice = self.tally(bounds, at, place, count) > 1
            for k, i, j, _ in pack(names, self.buckets, 0):
                if k in bits:
                    twice[i:j] |= np.unpackbits(np.frombuffer(bits[k], np.uint8), count=j - i).astype(np.bool_)
            edge = np.zeros(len(x) + self.length + 1, np.int32)
            found = at[twice[place]]
            np.add.at(edge, found, 1)
            np.add.at(edge, found + self.length, -1)
            first, last = settled.reshape(-1, 2).T
            np.add.at(edge, first, 1)
            np.add.at(edge, last - 1 + self.length, -1)
            gone = np.cumsum(edge)[: len(x)] > 0
            if spans:
                gone = covered(len(data), *spans, bounds, gone)
            rows = [self.finished(doc, data[i:j], gone[i:j]) for doc, i, j in zip(ids, offsets[:-1], offsets[1:]) if not self.losers or gone[i:j].any()]
            for i in range(0, len(rows), 2000):
                yield _rows(rows[i : i + 2000], _CHUNK_ARROW)

    def finished(self, doc: tuple[int | None, int], data: np.ndarray, gone: np.ndarray | None) -> tuple:
        """The row of a document that is done: its id is the one id of no chunk."""
        lost = int(gone.sum()) if gone is not None else 0
        kept = (data[~gone] if lost else data).tobytes()
        spans = len(runs(gone)[0]) if lost else 0
        digest = None if self.losers else hashlib.sha256(kept).hexdigest()
        return None, [doc[0]], [doc[1]], None, None, None, None, len(data), lost, spans, digest, kept if lost and self.with_text else None


def covered(size: int, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes of words that are gone, and what stands between two of them in one document."""
    until = ends.copy()
    last = np.zeros(len(starts) + 1, np.bool_)
    last[bounds] = True
    joined = np.flatnonzero(gone[:-1] & gone[1:] & ~last[1:-1])
    until[joined] = starts[joined + 1]
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts[gone], 1)
    np.add.at(edge, until[gone], -1)
    return np.cumsum(edge)[:size] > 0


def expand(pairs: np.ndarray) -> np.ndarray:
    """All places of (first, last) runs."""
    pairs = pairs.reshape(-1, 2)
    sizes = pairs[:, 1] - pairs[:, 0]
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def read_chunks(batches: Iterator[pa.RecordBatch], reply: bool = False) -> Iterator[tuple]:
    """(chunk, ids and keys, offsets, bytes, answered bits by bucket, the two arrays of places) of each chunk."""
    for b in batches:
        names = b.schema.names
        for row in range(b.num_rows):
            get = lambda c: b.column(names.index(c))[row]  # noqa: B023, E731
            sizes = np.array(get("sizes").as_py(), np.int64)
            data = np.frombuffer(get("payload").as_buffer(), np.uint8) if len(sizes) and sizes.sum() else np.zeros(0, np.uint8)
            places = tuple(np.frombuffer(get(c).as_py() or b"", np.int64) if c in names else None for c in ("places", "open"))
            bits = {x["bucket"]: x["bits"] for x in get("answers").as_py() or []} if reply else {}
            yield get("chunk").as_py(), [*zip(get("ids").as_py(), get("keys").as_py())], np.concatenate([[0], np.cumsum(sizes)]), data, bits, places


def reply(frame: pd.DataFrame, parts: list[np.ndarray], masks: list[np.ndarray]) -> pd.DataFrame:
    """Bits for each chunk that has any: of each mask in turn."""
    at, out = 0, []
    bucket = int(frame["bucket"].iloc[0])
    for chunk, part in zip(frame["chunk"], parts):
        own = [m[at : at + len(part)] for m in masks]
        at += len(part)
        if any(m.any() for m in own):
            out.append((chunk, bucket, np.packbits(np.concatenate(own)).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])


def search(scratch: Scratch, chunks: DataFrame, of: Callable[[int], Repeats], keep: bool) -> DataFrame:
    """The rows of all documents, finished: the three passes."""
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    probe = of(LEAST_BUCKETS)
    names = total // (4 if probe.words else 1) * len(probe.cover) // probe.v
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, (names // BUCKET_NAMES).bit_length())
    work = of(buckets)
    step = "w-" if work.words else ""

    def exchange(table: DataFrame, send: Callable, mark: Callable) -> DataFrame:
        sent = table.mapInArrow(send, _NAMES)
        answers = sent.groupBy("bucket").applyInPandas(lambda frame: mark(frame), _REPLY)
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
        return table.join(answers.hint("shuffle_hash"), "chunk", "left")

    one = scratch.write(exchange(chunks, work.send_tuples, work.mark_tuples).mapInArrow(work.keep_marked, _CHUNK), f"{step}marked")
    if not keep:
        scratch.drop("chunks")
    scratch.release()
    marked = one.where("chunk is not null").select("chunk", "ids", "keys", "sizes", "payload", "places", "open")
    two = scratch.write(exchange(marked, work.send_contexts, work.mark_contexts).mapInArrow(work.settle, _CHUNK), f"{step}settled")
    scratch.release()
    settled = two.select("chunk", "ids", "keys", "sizes", "payload", "places", "open")
    three = scratch.write(exchange(settled, work.send_starts, work.mark_starts).mapInArrow(work.cut, _CHUNK), f"{step}cut")
    scratch.drop(f"{step}settled")
    scratch.release()
    return one.where("chunk is null").unionByName(three)


def _write_chunks(scratch: Scratch, docs: DataFrame) -> DataFrame:
    return scratch.write(docs.select("doc_id", "text").mapInArrow(_chunks, _CHUNK), "chunks").select("chunk", "ids", "keys", "sizes", "payload")


def remove_repeats(docs: DataFrame, length: int = LENGTH, prime: int = PRIME, with_text: bool = False, passage_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, kept: the remaining bytes where some went.

    With ``passage_words`` also n_passages, n_passage_bytes: the maximal runs in which every word belongs to so many words
    that stand in another document too, shorter than ``length`` bytes or not, and their bytes.  These are not removed.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    chunks = _write_chunks(scratch, docs)
    if passage_words:
        words = search(scratch, chunks, lambda b: Repeats(passage_words, WORD_PRIME, b, False, words=True, losers=True), keep=True)
        words = words.select(F.col("keys")[0].alias("key"), F.col("n_spans").alias("n_passages"), F.col("n_removed").alias("n_passage_bytes"))
        words = scratch.write(words, "passages")
        scratch.drop("w-marked", "w-cut")
    found = search(scratch, chunks, lambda b: Repeats(length, prime, b, with_text), keep=False)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    found = found.select(F.col("ids")[0].alias("doc_id"), *columns, F.col("keys")[0].alias("key"))
    if passage_words:
        more = ["n_passages", "n_passage_bytes"]
        found = found.join(words, "key", "left").fillna(0, more)
        columns += more
    return found.select("doc_id", *columns)


def remove_passages(docs: DataFrame, words: int = PASSAGE_WORDS, with_text: bool = False) -> DataFrame:
    """The columns of ``remove_repeats`` where each word goes that belongs to ``words`` words that stand in another document too."""
    scratch = Scratch(docs.sparkSession, "passages")
    found = search(scratch, _write_chunks(scratch, docs), lambda b: Repeats(words, WORD_PRIME, b, with_text, words=True), keep=False)
    return found.select(F.col("ids")[0].alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
