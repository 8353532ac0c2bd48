"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are words (lower-case A-Z; runs of digits, letters, marks and symbols; characters of scripts without spaces, such
as Chinese, Japanese and Thai, are words each; spaces and punctuation part words).  The CGK embedding walks over a string with a random bit for
each step and symbol: it writes the symbol it stands on and goes on if the bit is one.  Strings of small edit distance get
back into step, so edit distance becomes Hamming distance, and a few sampled steps make a hash that survives edits.  Each
repetition has its own walk and its own sampled steps.  Walks begin at every word of a document, and at every few words
of an item, and are 14 steps long, so an edit at one place spoils only some of them; regions of an item's size are verified.
Walks over a whole item would be the plainer form, but with a fifth of the words edited they get out of step: at 2 n steps
they agree in 0.36 (50 words) to 0.50 (15 words) of them, and five sampled steps would need 136 to 36 repetitions for
a recall of 0.995, a pass for each length in each, in place of three in all.  As many repetitions are made as reach
the target recall in each class of items (by the edits they may have), on all items with random edits at the limit.
Candidates are verified by exact edit distance over words (bit-parallel, the item against any stretch of the region).

Items of fewer than 15 words, and classes that miss the target after all repetitions, are found exactly: of k + 1 pieces
of an item with k edits one stands in the text as it is (pigeonhole), and all places of all pieces are verified.

An item is found where its edit distance to some stretch of words is at most a fifth of its words.

Defined results: null or wordless texts have no hit; null ids are kept; items with fewer than five words are found where
they stand without an edit, by chance too; null and wordless items are not searched; repeated items are found each; an empty benchmark finds nothing;
repeated rows are searched each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_blocks, byte_codes, lower_table, mix64, span_hashes, string_buffer, unit_spans

#: Edits for each word of an item that still count.
EDIT_SHARE = 0.2
#: Items with fewer words have no edits, for a fifth of their words is less than one.
LEAST_WORDS = 5
#: Items with fewer words are found by their pieces, without loss.
LEAST_WALK_WORDS = 15
STEPS, SAMPLED, ANCHOR_STRIDE = 14, 5, 2
TARGET_RECALL, MAX_REPETITIONS = 0.995, 32
#: Edited copies of each class of items, at least, that tuning looks at.
CLASS_COPIES = 300
#: Places of one item that are verified at once.
PLACES = 4096
#: Words of regions that are looked up at once.
REGION_WORDS = 1 << 20
#: Items that one pass over the documents searches for.
ITEMS_PER_PASS = 20_000

_CODES, _LOWER = byte_codes(17), lower_table()
_TABLE_BITS, _MEMBER_BITS = 18, 22


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the n + 1 bounds of the rows' words."""
    starts, ends = unit_spans(data, offsets, "alnum")
    words = span_hashes(_CODES[_LOWER[data]], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return words, np.searchsorted(starts, offsets)


def edit_distance_within(pattern: np.ndarray, masks: dict[int, int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, where the first such stretch ends)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for at, symbol in enumerate(text):
        equal = masks.get(symbol, 0)
        across = equal | minus
        down = (((equal & plus) + plus) ^ plus) | equal
        up, low = minus | ~(down | plus) & full, plus & down
        if up & top:
            score += 1
        elif low & top:
            score -= 1
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | ~(across | up) & full, up & across
        if score < best:
            best, end = score, at + 1
    return best, end


def edit_distances(pattern: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edit_distance_within of one short pattern and each row of regions."""
    steps = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), len(steps)), np.int64)
    for symbol in pattern:
        best = row + 1
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (regions != symbol))
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


class Pieces:
    """Places of the pieces of items: an item with k edits has one of its k + 1 pieces as it is."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], which: list[int], share: float):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in which:
            words = items[k][1]
            cuts = np.linspace(0, len(words), int(share * len(words)) + 2).astype(np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                key = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    key = self.grow(key, w)
                found.setdefault(b - a, []).append((int(key[0]), k, a))
        for size, rows in found.items():
            keys = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << _TABLE_BITS, np.bool_)
            bits[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.tables[size] = bits, keys[order], np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.int64)[order]

    @staticmethod
    def grow(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
        return mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ words)

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (row, item, word at which the item would begin), as three columns."""
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys, found = np.zeros(len(words), np.uint64), [np.zeros((0, 3), np.int64)]
        for size in range(1, max(self.tables, default=0) + 1):
            keys = self.grow(keys[: max(len(words) - size + 1, 0)], words[size - 1 :])
            if size not in self.tables or not len(keys):
                continue
            bits, entries, item, anchor = self.tables[size]
            left = np.flatnonzero(bits[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            left = left[row[left] == row[left + size - 1]]
            window, entry = collisions(left, keys[left], entries)
            found.append(np.stack([row[window], item[entry], window - anchor[entry]], axis=1))
        return distinct(np.concatenate(found))


def collisions(windows: np.ndarray, keys: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (window, place among the sorted entries) with equal keys."""
    i, j = np.searchsorted(entries, keys, side="left"), np.searchsorted(entries, keys, side="right")
    many = j - i
    first = np.cumsum(many) - many
    return np.repeat(windows, many), np.repeat(i - first, many) + np.arange(many.sum())


def distinct(rows: np.ndarray) -> np.ndarray:
    """Distinct rows of three columns, in order."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


class Searcher:
    """Finds items among the words of many documents.  ``tuned`` is what another searcher of the same items found by tuning."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], tuned: tuple[int, frozenset[int]] | None = None, share: float = EDIT_SHARE, seed: int = 23):
        self.items, self.share = items, share
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 1 << 63, (MAX_REPETITIONS, STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = [np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(MAX_REPETITIONS)]
        self.masks: list[dict[int, int]] = []
        for _, words in items:
            masks: dict[int, int] = {}
            for i, w in enumerate(words.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
        walked = [k for k, (_, words) in enumerate(items) if len(words) >= LEAST_WALK_WORDS]
        self.tables: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
        self.index(walked)
        self.repetitions, self.missed = tuned if tuned is not None else self.tune(rng, walked)
        if self.missed:
            self.tables = []
            self.index([k for k in walked if self.edits(k) not in self.missed])
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.different = np.array([len(np.unique(w)) for _, w in items], np.int64)
        owner = np.repeat(np.arange(len(items)), [len(w) for _, w in items])
        self.members = np.zeros(1 << _MEMBER_BITS, np.bool_)
        self.members[self.member_slots(owner, np.concatenate([w for _, w in items] + [np.zeros(0, np.uint64)]))] = True
        self.pieces = Pieces(items, [k for k, (_, words) in enumerate(items) if len(words) < LEAST_WALK_WORDS or self.edits(k) in self.missed], share)

    def edits(self, item: int) -> int:
        return int(self.share * len(self.items[item][1]))

    def index(self, walked: list[int]) -> None:
        """Where the walks over these items begin."""
        starts = [(k, a) for k in walked for a in range(0, len(self.items[k][1]) - STEPS // 2 + 1, ANCHOR_STRIDE)]
        self.entry_item = np.array([k for k, _ in starts], np.int64)
        self.entry_anchor = np.array([a for _, a in starts], np.int64)

    def table(self, r: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of repetition r: which keys there are after each sampled step, the last keys in order, and their entries."""
        while len(self.tables) <= r:
            joined = np.concatenate([w for _, w in self.items] + [np.zeros(0, np.uint64)])
            bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in self.items])]).astype(np.int64)
            begin = bounds[self.entry_item] + self.entry_anchor
            depths, keys = [], np.zeros(0, np.uint64)
            for _, keys, _ in self.walk(joined, begin, bounds[self.entry_item + 1], len(self.tables)):
                table = np.zeros(1 << _TABLE_BITS, np.bool_)
                table[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
                depths.append(table)
            order = np.argsort(keys, kind="stable")
            self.tables.append((depths, keys[order], order))
        return self.tables[r]

    def walk(self, words: np.ndarray, begin: np.ndarray, stop: np.ndarray, r: int, tables: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """After each sampled step: (which windows are left, their keys, where they stand).  A window past its end reads symbol 0."""
        left, at = np.arange(len(begin)), begin.copy()
        keys = np.full(len(begin), np.uint64(r + 1))
        padded = np.concatenate([words, np.zeros(1, np.uint64)])
        last, depth = self.steps[r][-1], 0
        for j in range(int(last) + 1):
            symbol = padded[np.minimum(at, len(words))]
            ended = at >= stop[left]
            if ended.any():
                symbol[ended] = 0
            if j == self.steps[r][depth]:
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ symbol)
                if tables is not None:
                    good = tables[depth][(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
                    left, at, keys, symbol = left[good], at[good], keys[good], symbol[good]
                yield left, keys, at
                depth += 1
            at = at + (((symbol ^ (symbol >> np.uint64(31))) * self.seeds[r, j]) >> np.uint64(63)).astype(np.int64)

    def candidates(self, words: np.ndarray, bounds: np.ndarray, repetitions: int, first: int = 0) -> np.ndarray:
        """Distinct (row, item, word at which the item would begin) where a window and an entry collide, as three columns."""
        begin = np.arange(len(words))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        stop = bounds[1:][row]
        found = [np.zeros((0, 3), np.int64)]
        for r in range(first, repetitions):
            depths, entries, order = self.table(r)
            left = keys = None
            for left, keys, _ in self.walk(words, begin, stop, r, depths):
                pass
            if left is None or not len(left) or not len(entries):
                continue
            window, entry = collisions(left, keys, entries)
            entry = order[entry]
            found.append(np.stack([row[window], self.entry_item[entry], window - self.entry_anchor[entry]], axis=1))
        return distinct(np.concatenate(found))

    def tune(self, rng: np.random.Generator, walked: list[int]) -> tuple[int, frozenset[int]]:
        """The fewest repetitions that find the target share of every class's items with random edits at the limit; the classes that miss it."""
        members: dict[int, list[int]] = {}
        for k in walked:
            members.setdefault(self.edits(k), []).append(k)
        copies, owners, classes = [], [], []
        for edits, own in sorted(members.items()):
            for k in own * -(-CLASS_COPIES // len(own)):
                words = self.items[k][1].tolist()
                for _ in range(edits):
                    at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                    fresh = [int(rng.integers(1, 1 << 62))]
                    words[at : at + (kind != 1)] = fresh if kind != 2 else []
                around = rng.integers(1, 1 << 62, (2, 3 * STEPS)).tolist()
                copies.append(np.array(around[0] + words + around[1], np.uint64))
                owners.append(k)
                classes.append(edits)
        if not copies:
            return 0, frozenset()
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in copies])])
        joined, owner, kind = np.concatenate(copies), np.array(owners), np.array(classes)
        found, wanted = np.zeros(len(copies), np.bool_), np.bincount(kind)
        for r in range(MAX_REPETITIONS):
            got = self.candidates(joined, bounds, r + 1, r)
            found[got[owner[got[:, 0]] == got[:, 1], 0]] = True
            missed = np.flatnonzero(np.bincount(kind[found], minlength=len(wanted)) < TARGET_RECALL * wanted)
            if not len(missed):
                return r + 1, frozenset()
        return MAX_REPETITIONS, frozenset(missed.tolist())

    def verify_pieces(self, words: np.ndarray, bounds: np.ndarray, out: dict[int, dict[int, tuple[int, int]]]) -> None:
        """Adds the items that pieces find, at their best."""
        found = self.pieces.candidates(words, bounds)
        found = found[np.argsort(found[:, 1], kind="stable")]
        padded = np.concatenate([words, np.zeros(1, np.uint64)])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(found[:, 1])) + 1, [len(found)]]) if len(found) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            item = int(found[i, 1])
            pattern, limit = self.items[item][1], self.edits(item)
            for k in range(i, j, PLACES):
                rows, starts = found[k : min(j, k + PLACES), 0], found[k : min(j, k + PLACES), 2]
                low = np.maximum(bounds[rows], starts - limit)
                place = low[:, None] + np.arange(len(pattern) + 2 * limit)
                inside = place < np.minimum(bounds[rows + 1], starts + len(pattern) + limit)[:, None]
                distance, end = edit_distances(pattern, np.where(inside, padded[np.where(inside, place, len(words))], 0))
                for at in np.flatnonzero(distance <= limit).tolist():
                    own = out.setdefault(int(rows[at]), {})
                    if item not in own or distance[at] < own[item][0]:
                        own[item] = (int(distance[at]), int(low[at] - bounds[rows[at]] + end[at]))

    @staticmethod
    def member_slots(items: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where ``members`` says whether an item has a word; two of them may share a place."""
        return ((words ^ (items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - _MEMBER_BITS)).astype(np.int64)

    def likely(self, found: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The candidates whose region has as many words of the item as a hit needs; a few others stay too."""
        size = self.sizes[found[:, 1]]
        limit = (self.share * size).astype(np.int64)
        low, high = np.maximum(bounds[found[:, 0]], found[:, 2] - limit), np.minimum(bounds[found[:, 0] + 1], found[:, 2] + size + limit)
        count = np.maximum(high - low, 0)
        good, first = np.zeros(len(found), np.bool_), 0
        ends = np.cumsum(count)
        while first < len(found):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + REGION_WORDS, side="right")))
            own = count[first:last]
            before = np.cumsum(own) - own
            place = np.repeat(low[first:last] - before, own) + np.arange(own.sum())
            inside = np.concatenate([[0], np.cumsum(self.members[self.member_slots(np.repeat(found[first:last, 1], own), words[place])])])
            good[first:last] = inside[before + own] - inside[before] >= size[first:last] - limit[first:last]
            first = last
        return self.varied(found[good], words, low[good], count[good])

    def varied(self, found: np.ndarray, words: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Those whose region has as many different words of the item as a hit needs: an edit takes one at most."""
        good, first = np.zeros(len(found), np.bool_), 0
        ends = np.cumsum(count)
        needed = self.different[found[:, 1]] - (self.share * self.sizes[found[:, 1]]).astype(np.int64)
        while first < len(found):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + REGION_WORDS, side="right")))
            own = count[first:last]
            before = np.cumsum(own) - own
            owner = np.repeat(np.arange(last - first), own)
            word = words[np.repeat(low[first:last] - before, own) + np.arange(own.sum())]
            of_item = self.members[self.member_slots(found[first:last, 1][owner], word)]
            owner, word = owner[of_item], word[of_item]
            order = np.lexsort((word, owner))
            owner, word = owner[order], word[order]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])[: len(owner)]
            good[first:last] = np.bincount(owner[new], minlength=last - first) >= needed[first:last]
            first = last
        return found[good]

    def search(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
        """For each row with hits: (item, distance, words of the item, word after the stretch) of each item, at its best."""
        out: dict[int, dict[int, tuple[int, int]]] = {}
        self.verify_pieces(words, bounds, out)
        for row, item, at in self.likely(self.candidates(words, bounds, self.repetitions), words, bounds).tolist():
            pattern = self.items[item][1]
            limit = int(self.share * len(pattern))
            best = out.get(row, {}).get(item)
            if best and best[0] == 0:
                continue
            low, high = max(bounds[row], at - limit), min(bounds[row + 1], at + len(pattern) + limit)
            masks = self.masks[item]
            region = words[low:high].tolist()
            if sum(w in masks for w in region) < len(pattern) - limit:
                continue
            distance, end = edit_distance_within(pattern, masks, region)
            if distance <= limit and (not best or distance < best[0]):
                out.setdefault(row, {})[item] = (distance, low - bounds[row] + end)
        return {row: [(k, d, len(self.items[k][1]), int(e)) for k, (d, e) in sorted(found.items())] for row, found in out.items()}


_HIT = "array<struct<item_id:long,distance:int,n_words:int,end_word:long>>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("end_word", pa.int64())]))


def find_items(docs: DataFrame, benchmark: DataFrame, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, hits of every whole text of (doc_id, text); hits has item_id, distance, n_words, end_word of each item found.

    Items of (item_id, text) go to the executors, ``items_per_pass`` of them, about, in each pass.  No shuffle.
    """
    passes = max(1, -(-benchmark.count() // items_per_pass))
    rows = docs.select("doc_id", "text", F.lit(None).cast(_HIT).alias("hits"))
    for k in range(passes):
        block = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", "text").collect()
        items = []
        for r in sorted(block, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or "")):
            words, _ = word_hashes(*string_buffer(pa.array([r["text"] or ""], pa.string())))
            if len(words):
                items.append((r["item_id"], words))
        searcher = Searcher(items)
        tuned = searcher.repetitions, searcher.missed

        def run(batches: Iterator[pa.RecordBatch], items=items, tuned=tuned) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(items, tuned)
            for b in batches:
                hits = b.column(2).to_pylist()
                for first, _, data, offsets in byte_blocks(b.column(1)):
                    words, bounds = word_hashes(data, offsets)
                    for row, found in searcher.search(words, bounds).items():
                        more = [{"item_id": items[i][0], "distance": d, "n_words": n, "end_word": e} for i, d, n, e in found]
                        hits[first + row] = (hits[first + row] or []) + more
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, _HIT_ARROW)], names=["doc_id", "text", "hits"])

        rows = rows.mapInArrow(run, f"doc_id long, text string, hits {_HIT}")
    return rows.select("doc_id", F.coalesce("hits", F.array().cast(_HIT)).alias("hits"))
