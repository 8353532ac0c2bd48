"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte 2- to 4-grams (lower-case letters, everything else a blank).
Embeddings and the softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled texts;
a temperature and two rejection thresholds are then fitted on texts of the sample that training has not seen: one on the
probability, one on how usual the text's grams are in the predicted language (mean log frequency, standardised for the
length), which also tells texts of languages that were never learned, however sure the softmax is.

Defined results: null or letterless text is ``und`` with score 0 and rejected; a null lang is no label; without any
label every text is ``und``; ties go to the label first in order; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_buffer

UNKNOWN = "und"
#: Labelled texts, about, of each language that training may see.
SAMPLE_PER_LANGUAGE = 700
#: Labelled texts, about, that training may see; with many languages each has fewer.
SAMPLE = 200 * SAMPLE_PER_LANGUAGE
BUCKET_BITS = 15
DIMENSIONS = 16
EPOCHS = 6
SEGMENT = 1 << 18
#: Share of the texts of known language, unseen in training, that the thresholds, half each, may reject.
REJECTED_SHARE = 0.002
#: Unseen texts from which their own least quantiles count; of fewer, an exponential tail is carried on.
ENOUGH = 200
#: Parts of a small sample; each is unseen by the frequencies of the others.
FOLDS = 4
#: What a gram never seen in a language counts for, beside the 1000 of all grams.
UNSEEN = 0.05


def _fold_table() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_FOLD = _fold_table()


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all 2-, 3- and 4-grams of one text, in segments of bounded size."""
    for at in range(0, max(len(data), 1), SEGMENT):
        raw = data[at : at + SEGMENT + 3]
        text = np.full(len(raw) + 5, 0x20, np.uint8)
        text[1 : len(raw) + 1] = _FOLD[raw]
        upper = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)) + 1
        text[upper] += 0x20  # capitals with an accent
        b = text.astype(np.uint32)
        pair = b[:-1] | b[1:] << np.uint32(8)
        four = pair[:-2] | pair[2:] << np.uint32(16)
        n = min(len(raw), SEGMENT) + 1 if at == 0 else min(len(raw), SEGMENT)
        first = 0 if at == 0 else 1
        four = four[first : first + n]
        shift = np.uint32(32 - BUCKET_BITS)
        yield np.concatenate(
            [
                ((four & np.uint32(0xFFFF)) * np.uint32(0x9E3779B1) + np.uint32(0x2545F491)) >> shift,
                ((four & np.uint32(0xFFFFFF)) * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)) >> shift,
                (four * np.uint32(0xC2B2AE3D)) >> shift,
            ]
        )


def has_letter(data: np.ndarray) -> bool:
    lower = data | 0x20
    if ((lower >= 0x61) & (lower <= 0x7A)).any():
        return True
    return bool((data >= 0x80).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


@dataclass
class Model:
    labels: list[str]
    both: np.ndarray  # bucket x label: embedding times softmax weights; then log frequency in the language
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: np.ndarray  # mean log frequency of the texts of each label
    spread: tuple[float, float]  # variance around it: a constant, and one over the number of grams
    least: float  # least standardised log frequency

    @property
    def table(self) -> np.ndarray:
        return self.both[:, : len(self.labels)]

    def judge(self, data: np.ndarray) -> tuple[str, float, bool]:
        """(label, probability, rejected)."""
        if not self.labels or not has_letter(data):
            return UNKNOWN, 0.0, True
        total, count = np.zeros(self.both.shape[1]), 0
        for idx in grams(data):
            total += self.both[idx].sum(axis=0, dtype=np.float64)
            count += len(idx)
        total /= max(count, 1)
        p = softmax((total[: len(self.labels)] + self.bias) / self.temperature)
        best = int(p.argmax())
        away = (total[len(self.labels) + best] - self.usual[best]) / math.sqrt(self.spread[0] + self.spread[1] / max(count, 1))
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold or away < self.least)


def low_quantile(values: np.ndarray, share: float) -> float:
    """The quantile of a small share; of few values the smaller one of it and an exponential tail's below the lowest tenth."""
    low = float(np.quantile(values, share))
    if len(values) >= ENOUGH:
        return low
    tenth = float(np.quantile(values, 0.1))
    return min(low, tenth - float(np.mean(tenth - values[values <= tenth])) * math.log(0.1 / share))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    """rows: (label, buckets, share of each) of each text."""
    labels = sorted({r[0] for r in rows})
    size = 1 << BUCKET_BITS
    if not labels:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0, 1.0, np.zeros(0), (1.0, 0.0), 0.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = rows[: len(rows) // 8]
    train = rows[len(held) :]
    place = {x: i for i, x in enumerate(labels)}
    vectors = rng.normal(0, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    freq = np.bincount([place[r[0]] for r in train], minlength=len(labels))
    scale = np.minimum(3.0, len(train) / (len(labels) * np.maximum(freq, 1)))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            label, idx, share = train[i]
            y = place[label]
            rate = np.float32(scale[y] * 0.5 * (1 - done / steps) + 0.01)
            x = share @ vectors[idx]
            g = softmax(x @ weights + bias).astype(np.float32)
            g[y] -= 1
            back = weights @ g
            weights -= rate * np.outer(x, g)
            bias -= rate * np.float32(0.1) * g
            # a bucket's step grows with its share of the text; texts have hundreds of them
            vectors[idx] -= (rate * np.float32(20.0)) * np.outer(share, back)
            done += 1
    table = (vectors @ weights).astype(np.float32)
    logits = np.array([r[2] @ table[r[1]] + bias for r in held]) if held else np.zeros((0, len(labels)))
    truth = np.array([place[r[0]] for r in held], dtype=int)
    best, temperature = math.inf, 1.0
    for t in np.geomspace(0.05, 10, 40):
        if len(held):
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            loss = float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth])) + 1e-4 / t
            if loss < best:
                best, temperature = loss, float(t)
    log = log_frequencies(train, place)
    both = np.concatenate([table, log], axis=1)
    if not held:
        return Model(labels, both, bias, temperature, 0.0, np.zeros(len(labels)), (1.0, 0.0), -math.inf)
    p = np.array([softmax(z / temperature) for z in logits])
    odds = np.log(np.maximum(p.max(axis=1), 1e-12) / np.maximum(1 - p.max(axis=1), 1e-12))
    folds = [(train, held)] if len(held) >= ENOUGH else [([r for i, r in enumerate(rows) if i % FOLDS != k], rows[k::FOLDS]) for k in range(FOLDS)]
    unseen = [(place[r[0]], r[2] @ t[r[1], place[r[0]]], r[2].min()) for others, few in folds for t in [log_frequencies(others, place)] for r in few]
    truth = np.array([u[0] for u in unseen])
    own, one_over = np.array([float(u[1]) for u in unseen]), np.array([float(u[2]) for u in unseen])  # some gram stands once
    usual = np.array([own[truth == k].mean() if (truth == k).any() else own.mean() for k in range(len(labels))])
    spread = variance(one_over, (own - usual[truth]) ** 2)
    away = (own - usual[truth]) / np.sqrt(spread[0] + spread[1] * one_over)
    threshold = 1 / (1 + math.exp(-low_quantile(odds, REJECTED_SHARE / 2)))
    return Model(labels, both, bias, temperature, threshold, usual, spread, low_quantile(away, REJECTED_SHARE / 2))


def log_frequencies(rows: list[tuple[str, np.ndarray, np.ndarray]], place: dict[str, int]) -> np.ndarray:
    """bucket x label: log frequency in the texts of the label, each text counting the same."""
    freq = np.bincount([place[r[0]] for r in rows], minlength=len(place))
    seen = np.zeros((1 << BUCKET_BITS, len(place)))
    for label, idx, share in rows:
        seen[idx, place[label]] += share * (1000 / freq[place[label]])
    return np.log((seen + UNSEEN) / (seen.sum(axis=0) + UNSEEN * len(seen))).astype(np.float32)


def variance(one_over: np.ndarray, squares: np.ndarray) -> tuple[float, float]:
    """a and b, not negative, so that a + b / length is about the square."""
    a, b = np.linalg.lstsq(np.stack([np.ones(len(one_over)), one_over], axis=1), squares, rcond=None)[0]
    if b <= 0:
        a, b = squares.mean(), 0.0
    if a <= 0:
        a, b = 0.0, squares.sum() / one_over.sum()
    return float(a) + 1e-4, float(b)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of (doc_id, text, lang).  The driver gets bucket counts of about ``per_language`` texts of each language."""
    counts = labelled.where("lang is not null").groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return fit([])
    per_language = min(per_language, SAMPLE / len(counts))
    keep = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(draw < keep[F.col("lang")]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffer(b.column(1))
            idx, share = [], []
            for i, j in zip(offsets[:-1], offsets[1:]):
                if not has_letter(data[i:j]):
                    idx.append(None), share.append(None)
                    continue
                total = np.zeros(1 << BUCKET_BITS, np.int64)
                for g in grams(data[i:j]):
                    total += np.bincount(g, minlength=1 << BUCKET_BITS)
                used = np.flatnonzero(total)
                idx.append(used.astype(np.uint16).tobytes())
                share.append((total[used] / total.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx, pa.binary()), pa.array(share, pa.binary())], names=["lang", "idx", "share"])

    found = sample.mapInArrow(run, "lang string, idx binary, share binary").where("idx is not null").collect()
    rows = sorted((r["lang"], bytes(r["idx"]), bytes(r["share"])) for r in found)
    return fit([(lang, np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(s, np.float32)) for lang, i, s in rows])


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns named in ``keep``, and lang_pred, score, rejected of every whole text; their names begin with ``prefix``."""
    names = [prefix + c for c in ("lang_pred", "score", "rejected")]
    found = [T.StructField(c, t) for c, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    rows = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = string_buffer(b.column(b.num_columns - 1))
            judged = [model.judge(data[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            labels = pa.array([x for x, _, _ in judged], pa.string())
            scores = pa.array([p for _, p, _ in judged], pa.float64())
            rejected = pa.array([r for _, _, r in judged], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], labels, scores, rejected], names=[*b.schema.names[:-1], *names])

    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + found))
