"""N-gram Jaccard join by rare-first prefix filtering.

A document is the set of its distinct word n-grams.  Two documents link when 100 |intersection| >= percent |union|.

1. Documents are written as chunks with their sets' names, of 128 bits; documents of one set are one class, so copies cost
   one row each and nothing more.  The n-grams of each chunk are dealt out by bucket as packed names and counted over all chunks; a
   level of the count, four bits for each n-gram, comes back.  So the order, rare first, is by true counts at any size.
2. Of each class the prefix of its ordered set is dealt out by n-gram, without n-grams that stand in one document: two sets
   that link share an n-gram of both prefixes.  Length, positional and suffix filters are applied to the classes that meet
   there; the suffix filter bounds the difference of two sets from below by their counts in ranges of the hash.  The pairs
   that pass are not written: an n-gram returns a spanning forest of them, so a group of any size costs one row a member.
   An n-gram that many classes share is dealt out in units of two blocks of similar sizes.
3. The components of these forests are the candidate groups: no pair in two of them can link.  Each set goes to its group,
   a group is dealt out in units of two blocks of similar sizes, and none of two whose sizes cannot link.  A unit counts
   the intersections of its pairs exactly, each pair once, and returns the number of links of each set and a spanning forest.

Defined results: null text, or text without words, has an empty set and is its own component; with fewer than n words the
whole sequence is one n-gram; repeated rows are documents each; a null doc_id takes part, and its component is the
smallest id of its group, null if there is none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_blocks, byte_codes, class_table, connected_components, forest, lower_table, mix64, pack, span_hashes, string_buffer, unpack, word_spans

#: Bits of a set's key; sets of one key and different checks, of 64 more bits, get keys of their own.
KEY_BITS = 64
#: Names, about, in one bucket of counts; buckets are a power of two, and this many at least.
BUCKET_NAMES, LEAST_BUCKETS = 1 << 21, 256
#: Bytes of a name that are sent, besides the bits of its bucket.
NAME_BYTES = 5
#: Ranges of the hash whose counts make the suffix filter.
RANGES = 64
#: Sets, and n-grams in them, that a block holds, about; a group makes EVEN_BLOCKS blocks, of LEAST_SETS at least, before they grow.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 19
EVEN_BLOCKS, LEAST_SETS = 8, 128
#: Rows of one n-gram that one task compares.
HOT_ROWS = 2048
#: Sets that may share an n-gram for it to be counted pair by pair; above, it is counted as a row of a matrix product.
SPARSE = 16

_CODES = byte_codes(11)
_WORD, _LOWER = class_table("blank"), lower_table()


def document_sets(column: pa.Array, gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    for first, last, data, offsets in byte_blocks(column):
        starts, ends = word_spans(data, offsets, _WORD)
        words = span_hashes(_CODES[_LOWER[data]], starts, ends) if len(starts) else np.zeros(0, np.uint64)
        total = words.copy()
        for k in range(1, gram):
            if len(words) > k:
                total[:-k] = total[:-k] * np.uint64(0x9E3779B97F4A7C15) + words[k:]
        total = mix64(total)
        bounds = np.searchsorted(starts, offsets)
        for i, j in zip(bounds[:-1], bounds[1:]):
            if j - i >= gram:
                yield np.unique(total[i : j - gram + 1])
            elif j > i:
                whole = words[i : i + 1]
                for k in range(i + 1, j):
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1]
                yield mix64(whole ^ np.uint64(j - i))
            else:
                yield words[:0]


def set_names(grams: np.ndarray, bits: int = KEY_BITS) -> tuple[int, int]:
    """The key and the check of a set: two 64-bit names of it, the first cut to ``bits``."""
    with np.errstate(over="ignore"):
        sums = [mix64(grams ^ np.uint64(c)).sum(dtype=np.uint64) + np.uint64(len(grams)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    key, check = mix64(np.array(sums, np.uint64)).view(np.int64)
    return int(key >> np.int64(64 - bits)), int(check)


def range_counts(grams: np.ndarray) -> bytes:
    """Counts in RANGES ranges of the hash, 255 at most: that only lowers the bound."""
    counts = np.bincount((grams >> np.uint64(65 - RANGES.bit_length())).astype(np.int64), minlength=RANGES)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def prefix_length(n: int, percent: int) -> int:
    """A set of n that links shares at least ceil(n percent / 100) n-grams."""
    return n - (-(-n * percent // 100)) + 1


def passes(nx, px, ny, py, percent: int):
    """Length and positional filters for sets of sizes nx, ny whose first common n-gram is at places px, py."""
    short, long_ = np.minimum(nx, ny), np.maximum(nx, ny)
    need = -(-(nx + ny) * percent // (100 + percent))
    return (100 * short >= percent * long_) & (1 + np.minimum(nx - px, ny - py) - 1 >= need)


_CHUNK = "chunk long, ids array<long>, keys array<long>, checks array<long>, counts array<long>, payload binary, sizes array<long>"
_CHUNK_ARROW = pa.schema([("chunk", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("ids", "keys", "checks", "counts")] + [("payload", pa.binary()), ("sizes", pa.list_(pa.int64()))])


def _chunks(gram: int, bits: int):
    """Chunks of documents with the names and sizes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, last, data, offsets in byte_blocks(b.column(1)):
                sets = list(document_sets(pa.array([data[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary()), gram))
                keys, checks = zip(*(set_names(x, bits) for x in sets))
                row = (task << 32 | made, ids[first:last], keys, checks, [len(x) for x in sets], data.tobytes(), np.diff(offsets))
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK_ARROW)], schema=_CHUNK_ARROW)

    return run


def _read_chunks(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[tuple]:
    """(chunk, keys with their checks, sets, texts, the distinct n-grams in order, how often each stands, answers by bucket)."""
    for b in batches:
        for row in range(b.num_rows):
            x = {name: b.column(i)[row] for i, name in enumerate(b.schema.names)}
            offsets = np.concatenate([[0], np.cumsum(np.array(x["sizes"].as_py(), np.int64))])
            data = np.frombuffer(x["payload"].as_buffer(), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
            texts = pa.array([data[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:])], pa.binary())
            sets = list(document_sets(texts, gram))
            grams, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            answers = {a["bucket"]: a["levels"] for a in x["answers"].as_py() or []} if "answers" in x else {}
            yield x["chunk"].as_py(), list(zip(x["keys"].as_py(), x["checks"].as_py())), sets, texts, grams, counts, answers


_NAMES = "bucket int, chunk long, names binary, counts binary"


def _send_names(gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, _, grams, counts, _ in _read_chunks(batches, gram):
            few = np.minimum(counts, 255).astype(np.uint8)
            rows = [(k, raw, few[i:j].tobytes()) for k, i, j, raw in pack(grams, buckets, NAME_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "chunk", "names", "counts"]
            )

    return run


def levels(totals: np.ndarray) -> np.ndarray:
    """0 for an n-gram of one document, then one more each time the count doubles, 15 at most."""
    return np.minimum(15, np.ceil(np.log2(np.maximum(totals, 1)))).astype(np.uint8)


def _count_names(frame: pd.DataFrame) -> pd.DataFrame:
    parts = [unpack(x, NAME_BYTES) for x in frame["names"]]
    names, counts = np.concatenate(parts), np.frombuffer(b"".join(frame["counts"]), np.uint8)
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    group = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    level = np.empty(len(names), np.uint8)
    level[order] = levels(np.bincount(group, weights=counts[order]))[group]
    cuts = np.cumsum([len(x) for x in parts])[:-1]
    packed = []
    for own in np.split(level, cuts):
        own = np.concatenate([own, np.zeros(len(own) % 2, np.uint8)])
        packed.append((own[::2] << 4 | own[1::2]).tobytes())
    return pd.DataFrame({"chunk": frame["chunk"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "levels": packed})


_PREFIX = "gram long, key long, check long, n int, pos int, ranges binary, text binary"
_PREFIX_ARROW = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("ranges", pa.binary()), ("text", pa.binary())])


def _prefixes(gram: int, percent: int, buckets: int):
    """Prefix n-grams that more than one document has, with their places; and, once, the text of a class that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for chunk, keys, sets, texts, grams, counts, answers in _read_chunks(batches, gram):
            level = np.zeros(len(grams), np.uint8)
            for k, i, j, _ in pack(grams, buckets, 0):
                both = np.frombuffer(answers[k], np.uint8)
                level[i:j] = np.stack([both >> 4, both & 15], axis=1).ravel()[: j - i]
            found: list[tuple] = []
            for doc, (key, own) in enumerate(zip(keys, sets)):
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                rank = level[np.searchsorted(grams, own)]
                order = np.argsort(rank, kind="stable")[: prefix_length(len(own), percent)]
                shared = np.flatnonzero(rank[order])
                if len(shared):
                    found.append((own[order[shared]], shared, key, len(own), range_counts(own), texts[doc].as_py()))
            if not found:
                continue
            times = [len(f[0]) for f in found]
            of = np.repeat(np.arange(len(found)), times)
            ranges = pa.array([f[4] for f in found], pa.binary()).take(pa.array(of))
            names = np.array([f[2] for f in found], np.int64)
            columns = [np.concatenate([f[0] for f in found]).view(np.int64), *np.repeat(names, times, axis=0).T, np.repeat([f[3] for f in found], times), np.concatenate([f[1] for f in found])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _PREFIX_ARROW)), ranges, pa.nulls(len(of), pa.binary())], schema=_PREFIX_ARROW)
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), *(pa.array(c) for c in names.T.copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([f[5] for f in found], pa.binary())], schema=_PREFIX_ARROW)

    return run


def candidate_forest(key: np.ndarray, n: np.ndarray, pos: np.ndarray, ranges: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that pass all filters, among classes that share one n-gram; of different sides, if given."""
    _, once = np.unique(key, return_index=True)  # a class may come from several tasks
    order = once[np.argsort(n[once], kind="stable")]  # sets that pass the length filter are neighbours
    key, n, pos, ranges = key[order], n[order].astype(np.int64), pos[order].astype(np.int64), ranges[order].astype(np.int16)
    side = side[order] if side is not None else None
    stop = np.searchsorted(n, 100 * n // percent, side="right")
    part, left, edges = np.arange(len(key)), len(key), []
    for i in range(len(key) - 1):
        j = np.arange(i + 1, stop[i])
        if side is not None:
            j = j[side[j] != side[i]]
        j = j[(part[j] != part[i]) & passes(n[i], pos[i], n[j], pos[j], percent)]
        if not len(j):
            continue
        need = -(-(n[i] + n[j]) * percent // (100 + percent))
        j = j[np.abs(ranges[j] - ranges[i]).sum(axis=1) <= n[i] + n[j] - 2 * need]
        while len(j):
            edges.append((int(key[i]), int(key[j[0]])))
            part[part == part[j[0]]] = part[i]
            j = j[part[j] != part[i]]
            left -= 1
        if left == 1:
            break
    return edges


def _forests(percent: int):
    """Of rows ordered by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        edges: set[tuple[int, int]] = set()

        def close() -> None:
            if held and sum(len(h[0]) for h in held) > 1:
                edges.update(candidate_forest(*(np.concatenate([h[i] for h in held]) for i in range(1, 5)), percent))
            held.clear()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])
            edges.clear()
            return found

        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[:4]] + [string_buffer(b.column(4))[0].reshape(-1, RANGES)]
            cuts = np.concatenate([[0], np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1, [b.num_rows]])
            for i, j in zip(cuts[:-1], cuts[1:]):
                if held and held[0][0][0] != columns[0][i]:
                    close()
                held.append([c[i:j] for c in columns])
            if len(edges) > 100_000:
                yield out()
        close()
        yield out()

    return run


def _hot_unit(percent: int):
    """candidate_forest of two blocks of the rows of one n-gram."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        ranges = np.frombuffer(b"".join(frame["ranges"]), np.uint8).reshape(-1, RANGES)
        side = frame["block"].to_numpy() if first != second else None
        edges = candidate_forest(*(frame[c].to_numpy() for c in ("key", "n", "pos")), ranges, percent, side)
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    grams = np.concatenate([*sets, *others])
    owner = np.concatenate([np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.repeat(np.arange(len(others)) + len(sets), [len(x) for x in others])])
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(grams)]]))
    total = np.zeros(len(sets) * len(others), np.int64)
    size_of = np.repeat(sizes, sizes)
    for gap in range(1, min(SPARSE, int(sizes.max(initial=1)))):  # few sets have it: pair by pair
        at = np.flatnonzero((grams[gap:] == grams[:-gap]) & (size_of[gap:] <= SPARSE))
        a, b = owner[at], owner[at + gap]
        good = (a < len(sets)) & (b >= len(sets))
        total += np.bincount(a[good] * len(others) + b[good] - len(sets), minlength=len(total))
    total = total.reshape(len(sets), len(others)).astype(np.float32)
    dense = np.flatnonzero(sizes > SPARSE)
    for k in range(0, len(dense), 2048):  # many sets have it: a matrix product, exact below 2**24
        own = dense[k : k + 2048]
        column = np.repeat(np.arange(len(own)), sizes[own])
        rows = owner[np.repeat(starts[own] - np.concatenate([[0], np.cumsum(sizes[own])[:-1]]), sizes[own]) + np.arange(sizes[own].sum())]
        table = np.zeros((len(sets) + len(others), len(own)), np.float32)
        table[rows, column] = 1
        total += table[: len(sets)] @ table[len(sets) :].T
    return total.astype(np.int64)


_LINKS = "key long, root long, links long"


def _link_unit(percent: int):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        left = frame[frame["block"] == first]
        right = frame[frame["block"] == second]
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("key", "root", "links")})
        x, y = ([np.frombuffer(g, np.uint64) for g in f["grams"]] for f in (left, right))
        both = overlaps(x, y)
        nx, ny = np.array([len(g) for g in x]), np.array([len(g) for g in y])
        good = 100 * both >= percent * (nx[:, None] + ny[None] - both)
        kx, ky = left["key"].to_numpy(), right["key"].to_numpy()
        if first == second:
            good &= kx[:, None] < ky[None]
        a, b = np.nonzero(good)
        keys, place = np.unique(np.concatenate([kx, ky]), return_inverse=True)
        a, b, ma, mb = place[: len(kx)][a], place[len(kx) :][b], left["mult"].to_numpy()[a], right["mult"].to_numpy()[b]
        links = np.bincount(a, weights=mb, minlength=len(keys)) + np.bincount(b, weights=ma, minlength=len(keys))
        used = np.flatnonzero(links)
        return pd.DataFrame({"key": keys[used], "root": keys[forest(len(keys), a, b)[used]], "links": links[used].astype(np.int64)})

    return link


def _in_blocks(scratch: Scratch, members: DataFrame, percent: int, blocks: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(group, key, block) of members (group, key, n) in order of n, and (group, block, other): the blocks that each must meet.

    ``blocks`` is the number of blocks of a group, from its ``members`` and ``grams``.  Order comes from counts by size.
    """
    sizes = members.groupBy("group", "n").agg(F.count("*").alias("own"))
    by_size = Window.partitionBy("group").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group")
    sizes = sizes.select("group", "n", "own", F.coalesce(F.sum("own").over(by_size), F.lit(0)).alias("before"), F.sum("own").over(whole).alias("members"), F.sum(F.col("own") * F.col("n")).over(whole).alias("grams"))
    sizes = scratch.write(sizes.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("long")), f"{name}-sizes")
    place = F.col("before") + F.pmod(F.xxhash64("key"), F.col("own"))
    dealt = members.join(sizes, ["group", "n"]).withColumn("place", place)
    dealt = dealt.select("group", "key", "n", F.expr("place * blocks div members").cast("int").alias("block"))
    dealt = scratch.write(dealt, f"{name}-dealt")
    ends = dealt.groupBy("group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = ends.select("group", F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meet = F.least("high", "high2") * 100 >= F.greatest("low", "low2") * percent
    return dealt, ends.join(other, "group").where(meet).select("group", "block", "other")


def _own_sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [x.tobytes() for x in document_sets(b.column(1), gram)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["key", "grams"])

    return run


def ngram_join(docs: DataFrame, gram: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents linked directly) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    chunks = scratch.write(docs.select("doc_id", "text").mapInArrow(_chunks(gram, KEY_BITS), _CHUNK), "chunks")
    zipped = chunks.select(F.explode(F.arrays_zip("ids", "keys", "checks", "counts")).alias("x"))
    sets = scratch.write(zipped.select(F.col("x.ids").alias("doc_id"), F.col("x.keys").alias("key"), F.col("x.checks").alias("check"), F.col("x.counts").alias("n")), "sets")
    clashes = sets.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("key")
    clashes = scratch.write(clashes, "clashes")
    clash = clashes.limit(1).count() > 0
    sets = _apart(sets, clashes, clash)
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, (total // BUCKET_NAMES).bit_length())

    texts = chunks.select("chunk", "keys", "checks", "payload", "sizes")
    names = texts.mapInArrow(_send_names(gram, buckets), _NAMES)
    answers = scratch.write(names.groupBy("bucket").applyInPandas(_count_names, "chunk long, bucket int, levels binary"), "levels")
    scratch.release()
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "levels")).alias("answers"))
    found = texts.join(answers.hint("shuffle_hash"), "chunk", "left").mapInArrow(_prefixes(gram, percent, buckets), _PREFIX)
    found = _apart(scratch.write(found, "prefixes"), clashes, clash)
    scratch.drop("chunks", "levels")
    scratch.release()

    rows = found.where("gram is not null").select("gram", "key", "n", "pos", "ranges")
    pairs = _candidates(scratch, rows, percent)
    groups = connected_components(scratch, pairs, "groups").select(F.col("node").alias("key"), F.col("root").alias("group"))
    own = found.where("text is not null").select("key", "text")
    found = scratch.write(_links(scratch, own, groups, sets, gram, percent), "links")
    roots = connected_components(scratch, found.select(F.col("key").alias("a"), F.col("root").alias("b")), "linked")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    scratch.drop("prefixes")

    classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"))
    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = named.join(links, "key", "left").withColumn("n_links", F.col("mult") - 1 + F.coalesce("links", F.lit(0))).drop("links", "mult")
    named = scratch.write(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    per_class = named.join(least, "root").select("key", "component_id", "n_links")
    linked = sets.where("n > 0").join(per_class, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def _apart(df: DataFrame, clashes: DataFrame, clash: bool) -> DataFrame:
    """``df`` with a key of its own for each check where several sets have one key."""
    if not clash:
        return df.drop("check")
    marked = df.join(clashes.withColumn("clash", F.lit(True)), "key", "left")
    return marked.withColumn("key", F.when(F.col("clash"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("check", "clash")


def _candidates(scratch: Scratch, rows: DataFrame, percent: int) -> DataFrame:
    """Forests (a, b) of the pairs that pass the filters, of each n-gram in one task or, above HOT_ROWS rows, in units."""
    hot = scratch.write(rows.groupBy("gram").count().where(F.col("count") > HOT_ROWS).select("gram"), "hot")
    many = hot.count()
    if not many:
        return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_forests(percent), "a long, b long")
    hot = F.broadcast(hot) if many <= 10_000 else hot
    cold = rows.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(_forests(percent), "a long, b long")
    own = rows.join(hot, "gram").withColumnRenamed("gram", "group")
    own = scratch.write(own.groupBy("group", "key").agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("ranges").alias("ranges")), "hot-rows")
    dealt, units = _in_blocks(scratch, own.select("group", "key", "n"), percent, F.ceil(F.col("members") / (HOT_ROWS // 2)), "hot")
    own = own.join(dealt.drop("n"), ["group", "key"]).join(units, ["group", "block"])
    own = own.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "pos", "ranges")
    return cold.unionByName(own.groupBy("group", "i", "j").applyInPandas(_hot_unit(percent), "a long, b long"))


def _links(scratch: Scratch, texts: DataFrame, groups: DataFrame, sets: DataFrame, gram: int, percent: int) -> DataFrame:
    """Links inside candidate groups (key, group), from sets made again of one text of each class: (key, root, links) of units."""
    sizes = sets.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("mult"))
    members = scratch.write(groups.join(sizes, "key"), "members")
    m = F.col("members")
    blocks = F.greatest(F.ceil(m / BLOCK_SETS), F.least(F.lit(EVEN_BLOCKS), F.ceil(m / LEAST_SETS)), F.ceil(F.col("grams") / BLOCK_GRAMS))
    dealt, units = _in_blocks(scratch, members.select("group", "key", "n"), percent, blocks, "members")
    dealt = dealt.select("group", "key", "block").join(members.select("key", "mult"), "key")
    own = texts.join(members.select("key"), "key").dropDuplicates(["key"]).mapInArrow(_own_sets(gram), "key long, grams binary")
    own = own.join(dealt, "key").join(units, ["group", "block"])
    own = own.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "mult", "grams")
    return own.groupBy("group", "i", "j").applyInPandas(_link_unit(percent), _LINKS)
