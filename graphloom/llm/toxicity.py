"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

Terms are learned from labelled texts: word beginnings that stand in toxic texts and not in clean ones, and whole words
where they are shorter than a beginning.  All that the sample supports are taken.  They make a
trie.  The product of the trie with Levenshtein automata is determinised lazily, so each word of a text is read once,
letter by letter, until no term can match.  A term found weighs its log odds among labelled texts at that number of
edits; words around it tell quotation (less) from address (more).  A logistic function of the total gives the score.

Defined results: null or wordless text has no hit and gets the score of a text without hits; null labels are no labels;
labels that contradict each other count each; repeated rows are scored each; with no toxic label known all scores are 0;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, class_table, mix64, string_buffer

#: Labelled texts, about, of each class from which terms and weights are learned.
SAMPLE_PER_CLASS = 3000
#: Letters of a beginning; shorter words count whole.
SHORTEST, LONGEST = 4, 16
#: Texts of the sample, at least, that a term needs, as a share of the toxic ones, and never fewer than three.
SUPPORT = 0.005
#: Clean texts for each toxic one that a term may stand in.
IMPURITY = 0.02
WINDOW = 6
THRESHOLD = 0.7

# Words that report speech and words that address someone.
REPORTING = frozenset("said says say wrote writes quoted quote quotes quoting called calls claimed reported dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre yourself u ur tu te toi vous du dich dir ihr tú ti usted ustedes".split())
QUOTED, ADDRESSED = 0.4, 1.3
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TABLE = bytes(b if keep else 0x20 for b, keep in zip(range(256), class_table("alnum")))


def folded_words(data: bytes) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, all in lower case."""
    return data.decode("utf-8", "replace").lower().encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool  # whether more letters may follow


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The product of a trie of terms and Levenshtein automata, determinised as words are read.

    A state is the set of (trie node, edits) that are alive; a letter outside the terms' alphabet counts as one symbol.
    ``match`` gives (edits, term) of the best term, fewest edits first and then the term first in order.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room: list[int] = [0]  # most edits that a term below a node allows
        for k, term in enumerate(terms):
            node = 0
            edits = allowed_edits(len(term.text))
            self.room[0] = max(self.room[0], edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], edits)
            self.ends[node].append(k)
        self.alphabet = {c for d in self.children for c in d}
        self.sets: list[frozenset] = []
        self.names: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._name(self._close({(0, 0)}))

    def _close(self, alive: set) -> frozenset:
        todo = list(alive)
        while todo:  # a letter of the term is missing from the word
            node, e = todo.pop()
            if node >= 0:
                for child in self.children[node].values():
                    if e < self.room[child] and (child, e + 1) not in alive:
                        alive.add((child, e + 1))
                        todo.append((child, e + 1))
        best: dict[int, int] = {}
        for node, e in alive:
            best[node] = min(e, best.get(node, 99))
        for node, e in list(best.items()):
            if node >= 0:
                for k in self.ends[node]:
                    if self.terms[k].prefix and e <= allowed_edits(len(self.terms[k].text)):
                        best[-1 - k] = min(e, best.get(-1 - k, 99))  # any letters may follow
        return frozenset(best.items())

    def _name(self, alive: frozenset) -> int:
        if alive not in self.names:
            self.names[alive] = len(self.sets)
            self.sets.append(alive)
            self.moves.append({})
            found = [(e, -1 - node) for node, e in alive if node < 0]
            found += [(e, k) for node, e in alive if node >= 0 for k in self.ends[node] if e <= allowed_edits(len(self.terms[k].text))]
            self.accepts.append(min(found, default=None))
        return self.names[alive]

    def _move(self, state: int, letter: str) -> int:
        alive: set = set()
        for node, e in self.sets[state]:
            if node < 0:
                alive.add((node, e))
                continue
            child = self.children[node].get(letter)
            if child is not None:
                alive.add((child, e))
            for other in self.children[node].values():
                if e < self.room[other]:
                    alive.add((other, e + 1))  # another letter
            if e < self.room[node]:
                alive.add((node, e + 1))  # a letter too many
        return self._name(self._close(alive)) if alive else -1

    def match(self, word: str) -> tuple[int, int] | None:
        state, moves, alphabet = self.start, self.moves, self.alphabet
        for c in word:
            if c not in alphabet:
                c = ""
            to = moves[state].get(c)
            if to is None:
                to = moves[state][c] = self._move(state, c)
            if to < 0:
                return None
            state = to
        return self.accepts[state]


@dataclass
class Model:
    terms: list[Term]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # by (term, edits)
    slope: float = 1.0
    offset: float = -50.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.terms)
        self.cache: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
            hit = self.automaton.match(word.decode("utf-8", "replace")) if self.model.terms else None
            found = 0.0 if hit is None else max(0.0, self.model.weights.get((hit[1], hit[0]), 0.0))
            self.cache[word] = found
        return found

    def total(self, data: bytes) -> tuple[float, int]:
        """The weight of all terms in a text, with their contexts, and their number."""
        cache, weight = self.cache, self.weight
        hits = set()
        for w in set(folded_words(data)):
            x = cache.get(w)
            if x if x is not None else weight(w):
                hits.add(w)
        if not hits:
            return 0.0, 0
        text = data.decode("utf-8", "replace").lower()
        words = list(_WORD.finditer(text))
        quotes = [m.start() for m in re.finditer('["“”«»]', text)]
        at, opened, sum_, n = 0, 0, 0.0, 0
        for i, m in enumerate(words):
            w = m[0].encode()
            if w not in hits:
                continue
            while at < len(quotes) and quotes[at] < m.start():
                at, opened = at + 1, opened + 1
            near = {x[0] for x in words[max(0, i - WINDOW) : i + WINDOW + 1]}
            factor = 1.0
            if opened % 2 and at < len(quotes) or not near.isdisjoint(REPORTING):
                factor = QUOTED
            elif not near.isdisjoint(ADDRESS):
                factor = ADDRESSED
            sum_ += weight(w) * factor
            n += 1
        return sum_, n

    def score(self, data: bytes) -> tuple[float, int]:
        if not self.model.terms:
            return 0.0, 0
        total, n = self.total(data)
        z = self.model.slope * math.log1p(total) + self.model.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0, n


def choose_terms(prefixes: list[tuple[str, int, int, int]]) -> list[Term]:
    """(beginning, toxic texts, of these with nothing following, clean texts), all pure enough -> the terms.

    The shortest pure beginnings count, each lengthened as long as all its texts have the longer one too.  What is
    shorter than a beginning is a whole word, and a term as it is.
    """
    support = {p: (t, x) for p, t, x, _ in prefixes if len(p) >= SHORTEST}
    longer: dict[str, str] = {}
    for p, (t, _) in support.items():
        if p[:-1] in support and support[p[:-1]][0] == t:
            longer[p[:-1]] = p
    roots = [p for p in sorted(support) if p[:-1] not in support]
    terms = [Term(p, False) for p, *_ in prefixes if len(p) < SHORTEST]
    for p in roots:
        while p in longer:
            p = longer[p]
        t, exact = support[p]
        terms.append(Term(p, exact < 0.9 * t))
    return sorted(terms, key=lambda x: x.text)


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """toxic, text of labelled texts; of near copies, nearly always one."""
    labels = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(0.0)
    for value in (0, 1):
        keep = F.when(F.col("toxic") == value, min(1.0, per_class / max(1, counts.get(value, 0)))).otherwise(keep)
    chosen = labels.where(draw < keep)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("toxic", "text")


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = string_buffer(b.column(1))
        keys = []
        for i, j in zip(offsets[:-1], offsets[1:]):
            words = np.array([hash_word(w) for w in folded_words(data[i:j].tobytes())], np.uint64)
            grams = words
            for k in range(1, min(4, len(words))):
                grams = grams[:-1] * np.uint64(31) + words[k:]
            keys.append([int(mix64(grams ^ np.uint64(s)).min() >> np.uint64(1)) if len(grams) else 0 for s in (1, 2)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["toxic", "text", "k1", "k2"])


def hash_word(word: bytes) -> int:
    value = 0xCBF29CE484222325
    for b in word:
        value = (value ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return value


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        words = list(set(counts[0]) | set(counts[1]))
        found = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (counts[1], counts[0]))], names=["word", "toxic", "clean"])
        counts[0].clear(), counts[1].clear()
        return found

    for b in batches:
        data, offsets = string_buffer(b.column(1))
        for y, i, j in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:]):
            counts[y].update(set(folded_words(data[i:j].tobytes())))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield rows()
    yield rows()


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Terms, weights and score function from (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample = sample_labelled(docs, labels, per_class).mapInArrow(_sketch_rows, "toxic int, text string, k1 long, k2 long")
    sample = scratch.write(sample.dropDuplicates(["toxic", "k1"]).dropDuplicates(["toxic", "k2"]).select("toxic", "text"), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Model([])
    words = scratch.write(sample.mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    first = F.least(F.length("word"), F.lit(SHORTEST))
    cuts = words.where("word <> ''").select(F.explode(F.sequence(first, F.least(F.length("word"), F.lit(LONGEST)))).alias("n"), "*")
    exact = F.when(F.length("word") == F.col("n"), F.col("toxic")).otherwise(0)
    prefixes = cuts.groupBy(F.expr("substring(word, 1, n)").alias("p")).agg(F.sum("toxic").alias("t"), F.sum(exact).alias("x"), F.sum("clean").alias("c"))
    least, impurity = max(3, math.ceil(SUPPORT * toxic)), IMPURITY * max(1.0, clean / toxic)
    pure = prefixes.where((F.col("t") >= least) & (F.col("c") <= impurity * F.col("t"))).collect()
    model = Model(choose_terms([(r["p"], r["t"], r["x"], r["c"]) for r in pure]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rows = Automaton(model.terms), Counter()
        for b in batches:
            for w, t, c in zip(*(x.to_pylist() for x in b.columns)):
                if hit := automaton.match(w):
                    rows[hit, 1] += t
                    rows[hit, 0] += c
        keys = sorted({h for h, _ in rows})
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([k for _, k in keys], [e for e, _ in keys], [rows[h, 1] for h in keys], [rows[h, 0] for h in keys])], names=["term", "edits", "toxic", "clean"])

    sums = words.mapInArrow(found, "term long, edits long, toxic long, clean long").groupBy("term", "edits").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    seen = {(r["term"], r["edits"]): (r["toxic"], r["clean"]) for r in sums}
    for k, term in enumerate(model.terms):
        for e in range(allowed_edits(len(term.text)) + 1):
            t, c = seen.get((k, e), (0, 0))
            prior = 1.0 if e == 0 else 0.7
            model.weights[k, e] = max(-3.0, min(6.0, math.log((t + prior) / (c * toxic / max(clean, 1) + 0.35))))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            data, offsets = string_buffer(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.total(data[i:j].tobytes())[0] for i, j in zip(offsets[:-1], offsets[1:])], pa.float64())], names=["toxic", "total"])

    points = sample.mapInArrow(totals, "toxic int, total double").collect()
    counts = {r["toxic"]: r["count"] for r in labels.where("toxic is not null").groupBy("toxic").count().collect()}
    x = np.log1p(np.array([r["total"] for r in points]))
    y = np.array([float(r["toxic"] == 1) for r in points])
    share = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    weight = np.where(y == 1, share / max(toxic, 1), (1 - share) / max(clean, 1))
    model.slope, model.offset = fit_logistic(x, y, weight / weight.sum())
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge; the slope is not negative."""
    design = np.column_stack([x, np.ones_like(x)])
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    return max(0.0, float(theta[0])), float(theta[1])


SCORED = "doc_id long, score double, n_hits long"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_hits of every whole text of (doc_id, text).  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            data, offsets = string_buffer(b.column(1))
            rows = [scorer.score(data[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "score", "n_hits"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)
