"""License scans: fuzzy search for short notices.

Texts become lower-case words joined by one space.  A notice of at most k edits is split into k + 1 pieces; by the
pigeonhole principle one piece stands unchanged in every occurrence.  One Aho-Corasick pass finds the pieces, and in
the window around each the ``regex`` library matches the whole notice with at most k errors and reports the span.
Spans begin and end at words.  The library inserts no letters before the first of a pattern, so those that a word has too
many at its beginning are asked for by patterns of their own, with fewer errors left.

Defined results: null or wordless text has no word and no hit (score 0); every repeated row is scanned; overlapping
places all count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import class_table, lower_table, string_buffer

# The base phrases with their labels, and further short notices with the edits they may have.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("licensed under the mit license", "mit", 2),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("bsd 2 clause license", "bsd", 1),
    ("bsd 3 clause license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("licensed under cc by", "cc-by", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by nd", "cc-by-nd", 1),
    ("released into the public domain", "public-domain", 2),
    ("cc0 1 0 universal", "cc0", 1),
    ("all rights reserved", "proprietary", 1),
)
#: A base phrase may differ so much and still give its label; only exact places are counted as base.
BASE_EDITS = 1


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    base: bool


NOTICE_LIST = tuple(Notice(t, x, BASE_EDITS, True) for t, x in BASE) + tuple(Notice(t, x, k, False) for t, x, k in NOTICES)


def split_pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces that cover a notice, as even as can be, with their places."""
    n, count = len(text), edits + 1
    cuts = [n * i // count for i in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICE_LIST):
        self.notices = notices
        self.patterns = [[regex.compile(rf"(?<![^ ])[^ ]{{{more}}}(?:{regex.escape(x.text)}){{e<={x.edits - more}}}(?![^ ])") for more in range(x.edits + 1)] for x in notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, x in enumerate(notices):
            for at, piece in split_pieces(x.text, x.edits):
                found.setdefault(piece, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in found.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.table = bytes(b if keep else 0x20 for b, keep in zip(lower_table(), class_table("alnum")))

    def normalise(self, data: bytes) -> tuple[str, int]:
        """Lower-case words joined by one space, and how many there are."""
        words = data.translate(self.table).split()
        return b" ".join(words).decode("utf-8", "replace"), len(words)

    def candidates(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice, windows in which one of its pieces stands; overlapping windows are joined."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.seeds.iter(text):
            for i, at in places:
                x = self.notices[i]
                start = end + 1 - length - at
                a, b = max(0, start - x.edits - 1), min(len(text), start + len(x.text) + x.edits + 1)
                own = windows.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(b, own[-1][1])
                else:
                    own.append([a, b])
        return windows

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of every hit in normalised text, in order; hits of one notice may overlap."""
        hits: list[tuple[int, int, int, int]] = []
        for i, windows in self.candidates(text).items():
            x = self.notices[i]
            for a, b in windows:
                if x.base:  # every exact place
                    at = text.find(x.text, a, b)
                    while at >= 0:
                        stop = at + len(x.text)
                        if (at == 0 or text[at - 1] == " ") and (stop == len(text) or text[stop] == " "):
                            hits.append((at, stop, i, 0))
                        at = text.find(x.text, at + 1, b)
                for more, pattern in enumerate(self.patterns[i]):
                    for m in pattern.finditer(text, a, b, overlapped=False):
                        edits = sum(m.fuzzy_counts) + more
                        if m.start() < m.end() and not (x.base and edits == 0):
                            hits.append((m.start(), m.end(), i, edits))
        return sorted(set(hits))


def drop_covered(hits: list[tuple[int, int, int, int]], notices: tuple[Notice, ...]) -> list[tuple[int, int, int, int]]:
    """Without hits that another one covers with fewer errors, or covers as a longer notice of the same label.

    Exact base places stay.  ``hits`` are in order and no longer than the longest notice and its errors, so only near neighbours are compared.
    """
    reach = max(len(x.text) + x.edits for x in notices)
    kept = []
    for i, h in enumerate(hits):
        covered = False
        if not (notices[h[2]].base and h[3] == 0):
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(hits) and abs(hits[j][0] - h[0]) <= reach and not covered:
                    g = hits[j]
                    longer = g[1] - g[0] > h[1] - h[0] and g[3] <= h[3] and notices[g[2]].label == notices[h[2]].label
                    covered = g[0] <= h[0] and h[1] <= g[1] and (g[3] < h[3] or longer)
                    j += step
        if not covered:
            kept.append(h)
    return kept


OUTPUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string,edits:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32())]))
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)]
)


def scan_document(scanner: Scanner, data: bytes) -> tuple:
    text, n_words = scanner.normalise(data)
    hits = scanner.scan(text)
    if not hits:
        return n_words, 0, None, None, "", "", 0.0, []
    hits = drop_covered(hits, scanner.notices)
    words, at, count = [], 0, 0
    for start, *_ in hits:  # hits are in order, so the spaces are counted once
        count += text.count(" ", at, start)
        at = start
        words.append(count)
    base = [w for w, h in zip(words, hits) if scanner.notices[h[2]].base and h[3] == 0]
    base_labels = {scanner.notices[h[2]].label for h in hits if scanner.notices[h[2]].base and h[3] == 0}
    labels = base_labels | {scanner.notices[h[2]].label for h in hits}
    score = max(1 - h[3] / len(scanner.notices[h[2]].text) for h in hits)
    spans = [{"start": w, "end": w + text.count(" ", h[0], h[1]) + 1, "label": scanner.notices[h[2]].label, "edits": h[3]} for w, h in zip(words, hits)]
    return n_words, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICE_LIST) -> DataFrame:
    """Hits of notices in every whole text of (doc_id, text); spans are in words from 0.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for b in batches:
            data, offsets = string_buffer(b.column(1))
            rows = [scan_document(scanner, data[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            columns = [pa.array(x, f.type) for x, f in zip(zip(*rows), list(_ARROW)[1:])] if rows else [pa.array([], f.type) for f in list(_ARROW)[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns], schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, OUTPUT)
