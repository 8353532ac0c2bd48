"""HTML main text by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative, with weights learned from labelled
pages: those that mark their article by an ``article`` or ``main`` element.  A linear scan finds the contiguous region
with the best total.  Subtrees that are never content (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) count as one tag and give no text.

A page is read in one forward scan, whatever its markup: what is known of the rest (no further ``>``, no end of an
element) is never looked for again.  Text of a page that marks an article counts as outside where the mark does not
hold it, also before the article in ``main``.

Defined results: null, empty or tag-only html gives the empty text; unclosed and truncated markup is read as far as it
goes; in a tie the earlier region wins; repeated rows are pages each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: Pages, about, from which weights are learned; those among them that mark their article count.
SAMPLE_PAGES = 500
#: What a tag inside a marked article costs, in words, at most.
INSIDE_TAG = -0.2

# Element names, roles and class words that mark what is not content.
DROPPED_TAGS = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu title audio video".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies respond discussion disqus "
    "pagination pager widget toolbar copyright skip hidden form search".split()
)
#: Words for what stands beside an article if links hold half of its words, or it has fewer than these.
LINKED_LEAST = 10
LINKED_WORDS = frozenset("share sharing social related recommended recommendations".split())
#: Of these elements only whole class names count, and only names for what stands beside an article.
WHOLE_TAGS = frozenset("html body article main".split())
WHOLE_NAMES = frozenset("comment comments reply respond teaser related promo ad advert sponsored".split())
#: A class that begins so tells of an element's surroundings, not of itself.
ABOUT_OTHERS = frozenset("has no not with without is".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^\"']|\"[^\"]*\"|'[^']*')*")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")


def _dropped(tag: str, attributes: str) -> bool | None:
    """Whether an element is never content, by its name and attributes; None if that depends on its links."""
    if tag in DROPPED_TAGS:
        return True
    if not attributes.strip():
        return False
    linked = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for own in value.split():
                words = _NAME.findall(own)
                if tag in WHOLE_TAGS and own in WHOLE_NAMES:
                    return True
                if tag not in WHOLE_TAGS and words and words[0] not in ABOUT_OTHERS:
                    if not DROPPED_WORDS.isdisjoint(words):
                        return True
                    linked = linked or not LINKED_WORDS.isdisjoint(words)
        elif tag in ("html", "body"):
            continue
        elif name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return None if linked else False


class _TagEnds:
    """Where tags end whose quotes do not close inside them: each quote of a page is looked at twice at most."""

    def __init__(self, page: str):
        self.page = page
        self.at = [m.start() for m in re.finditer("[>\"']", page)]
        self.following, last = [-1] * len(self.at), {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.following[i] = last.get(c, -1)
            last[c] = i
        self.dead: set[int] = set()

    def find(self, start: int) -> int:
        """The place of the first ``>`` outside quotes; else of the first; -1 if there is none."""
        first = i = bisect_left(self.at, start)
        path = []
        while i < len(self.at) and i not in self.dead:
            path.append(i)
            if self.page[self.at[i]] == ">":
                return self.at[i]
            i = max(i, self.following[i]) + 1
        self.dead.update(path)
        return self.page.find(">", start) if first < len(self.at) else -1


def _scan(page: str) -> list[tuple[str | None, str, bool]]:
    """Texts as (None, text, False) and tags as (name, attributes, closing); the content of raw text elements is left out."""
    out: list[tuple[str | None, str, bool]] = []
    at, end, last, ends = 0, len(page), page.rfind(">"), None
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            out.append((None, page[at:stop], False))
            at = stop
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
        else:
            m = _TAG.match(page, at)
            if m and (("\"" not in m[3] and "'" not in m[3]) or _QUOTED.fullmatch(m[3])):
                closing, tag, attributes, at = m[1] == "/", m[2].lower(), m[3], m.end()
            else:
                m = _TAG_NAME.match(page, at) if at < last else None
                if m:
                    ends = ends or _TagEnds(page)
                    stop = ends.find(m.end())
                    closing, tag, attributes, at = m[1] == "/", m[2].lower(), page[m.end() : stop], stop + 1
                else:
                    out.append((None, "<", False))
                    at += 1
                    continue
            out.append((tag, attributes, closing))
            if tag in RAW_TAGS and not closing and not attributes.endswith("/"):
                m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                stop = page.find(">", m.end()) if m else -1
                at = end if stop < 0 else stop + 1
                out.append((tag, "", True))
    return out


def _matches(found: list[tuple[str | None, str, bool]]) -> dict[int, int]:
    """The closing tag of each element that ends."""
    stacks: dict[str, list[int]] = {}
    pairs: dict[int, int] = {}
    for i, (tag, attributes, closing) in enumerate(found):
        if tag is None or tag in VOID_TAGS:
            continue
        if closing:
            if stacks.get(tag):
                pairs[stacks[tag].pop()] = i
        elif not attributes.endswith("/"):
            stacks.setdefault(tag, []).append(i)
    return pairs


def _linked(found: list[tuple[str | None, str, bool]]) -> tuple[list[int], list[int]]:
    """Words, and words in links, before each token."""
    words, linked, inside = [0], [0], False
    for tag, value, closing in found:
        n = len(value.split()) if tag is None else 0
        inside = not closing if tag == "a" else inside
        words.append(words[-1] + n)
        linked.append(linked[-1] + n * inside)
    return words, linked


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """("text", text, in article) and ("tag", name, in article) in order; a dropped subtree is the tag ``-``."""
    found = _scan(page)
    pairs = _matches(found)
    out: list[tuple[str, str, bool]] = []
    i, article, links = 0, 0, None
    marks = "article" if any(tag == "article" and not closing for tag, _, closing in found) else "main"
    while i < len(found):
        tag, value, closing = found[i]
        if tag is None:
            out.append(("text", value, article > 0))
            i += 1
            continue
        if not closing and i in pairs:
            gone = _dropped(tag, value)
            if gone is None:
                links = links or _linked(found)
                words, linked = (x[pairs[i]] - x[i] for x in links)
                gone = 2 * linked >= words or words < LINKED_LEAST
            if gone:
                out.append(("tag", "-", article > 0))
                i = pairs[i] + 1
                continue
        if tag == marks:
            article += -1 if closing and article else 0 if closing else 1
        out.append(("tag", tag, article > 0))
        i += 1
    return out


def count_features(page: str) -> tuple[Counter, float | None]:
    """(feature, in article) counts of a page that marks its article, and the most a tag may cost for that to stay whole."""
    found = tokens(page)
    counts: Counter = Counter()
    if not any(inside for _, _, inside in found):
        return counts, None
    for kind, value, inside in found:
        counts[("word" if kind == "text" else value, inside)] += len(value.split()) if kind == "text" else 1
    own = [len(value.split()) if kind == "text" else -1 for kind, value, inside in found if inside]
    return counts, min(_least_ratio(own), _least_ratio(own[::-1]))


def _least_ratio(own: list[int]) -> float:
    """The least share of words to tags, over the beginnings that hold words: of -1 for a tag, else words."""
    words = tags = 0
    least = math.inf
    for x in own:
        tags += x < 0
        words += max(x, 0)
        if x < 0 and words:
            least = min(least, words / tags)
    return least


def learn_weights(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights of words and tags from labelled pages.

    A word inside a marked article gains one; a word outside one, on a page that has one, loses its log odds.  A tag inside
    a marked article costs a fifth of what would still leave the articles of all labelled pages whole, a fifth of a word
    at most.  Elsewhere a tag costs from that to five times as much: the more of its uses are outside articles, the more.
    """
    some = hash_sample(pages.select("page_id", "html"), "page_id", sample, pages.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        ratios: list[float] = []
        for b in batches:
            for page in b.column(1).to_pylist():
                counts, ratio = count_features(page or "")
                total.update(counts)
                if ratio is not None and math.isfinite(ratio):
                    ratios.append(ratio)
        rows = [(f, i, n, None) for (f, i), n in total.items()] + [(None, None, 1, r) for r in ratios]
        kinds = (("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.int64()), ("ratio", pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    counts = some.mapInArrow(run, "feature string, inside boolean, n long, ratio double").groupBy("feature", "inside", "ratio").agg(F.sum("n").alias("n")).collect()
    table = {(r["feature"], r["inside"]): r["n"] for r in counts if r["feature"] is not None}
    ratios = sorted(r["ratio"] for r in counts if r["ratio"] is not None)
    tag = max(INSIDE_TAG, INSIDE_TAG * ratios[0]) if ratios else INSIDE_TAG
    weights = {"word": 1.0, "outside": -max(1.0, math.log((table.get(("word", True), 0) + 1) / (table.get(("word", False), 0) + 1))), "inside tag": tag}
    for name in sorted({f for f, _ in table} - {"word"}):
        out = table.get((name, False), 0) / (table.get((name, False), 0) + table.get((name, True), 0))
        weights[name] = tag * (1 + 4 * out) if name not in ("article", "main") else tag
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the best positive total, the earliest of those; empty if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best contiguous region of a page."""
    found = tokens(page)
    marked = any(inside for _, _, inside in found)
    word, outside, tag = weights["word"], weights["outside"] if marked else weights["word"], weights.get("inside tag", INSIDE_TAG)
    scores = [len(value.split()) * (word if inside else outside) if kind == "text" else tag if inside else weights.get(value, -1.0) for kind, value, inside in found]
    first, last = best_region(scores)
    parts: list[str] = []
    for kind, value, _ in found[first:last]:
        if kind == "text":
            parts.append(entities.unescape(value) if "&" in value else value)
        elif value not in INLINE_TAGS:
            parts.append(" ")
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    weights = learn_weights(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
