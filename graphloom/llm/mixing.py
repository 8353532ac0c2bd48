"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words.  Whole passes over the source come first; the words still missing are
fitted by choosing documents: they are counted by exact length, a bounded-knapsack dynamic program says how many
documents of each length come once more, and those are the first of a seeded order.

Defined results: null text has size 0; size-0 documents take 0; a null source is a source of its own, last in order;
repeated rows count as documents each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Budget in words up to which the dynamic program runs exactly; greedy choice brings the rest below it.
EXACT_BUDGET = 1 << 16
#: Parts of the seeded order of the documents of one source and length.
ORDER_PARTS = 256


def word_count(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], most: float = MAX_COPIES) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in set(open_))
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        open_ = [i for i in open_ if i not in over]
    return targets


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, proportional shares first, so that the words come nearest to ``budget``.

    The program runs over the spare documents of all lengths.
    """
    order = np.argsort(lengths)
    length, count = lengths[order].astype(object), counts[order].astype(object)
    total = int(sum(length * count))
    take = np.array([int(c) * budget // total if total else 0 for c in count], dtype=object)
    left = budget - int(sum(length * take))
    for i in range(len(length) - 1, -1, -1):
        if left <= EXACT_BUDGET:
            break
        more = min(count[i] - take[i], (left - EXACT_BUDGET // 2) // length[i])
        if more > 0:
            take[i] += more
            left -= more * length[i]
    if left > 2 * EXACT_BUDGET:  # every spare document is longer than what the loop left room for: one more, or none
        spare = [i for i in range(len(length)) if count[i] > take[i]]
        one = min(spare, key=lambda i: (abs(length[i] - left), length[i]), default=None)
        if one is not None and abs(length[one] - left) < left:
            take[one] += 1
            left -= length[one]
    if 0 < left <= 2 * EXACT_BUDGET:
        for i, n in choose_parts(length, count - take, int(left)):
            take[i] += n
    out = np.zeros(len(lengths), np.int64)
    out[order] = take.astype(np.int64)
    return out


def choose_parts(length: np.ndarray, spare: np.ndarray, left: int) -> list[tuple[int, int]]:
    """(place, how many) of the spare documents, in parts, whose words come nearest to ``left``; fewer words in a tie."""
    parts = []  # the spare documents of each length in parts of 1, 2, 4, ...
    for i in range(len(length)):
        rest, size = min(spare[i], 2 * left // max(length[i], 1)) if length[i] else 0, 1
        while rest > 0:
            n = int(min(size, rest))
            parts.append((i, n))
            rest, size = rest - n, 2 * size
    step = math.gcd(*(int(length[i]) for i, _ in parts)) if parts else 1
    least = min(left % step, -left % step)
    reach, low, goal = 1, (1 << (2 * left + 1)) - 1, 0
    first = np.full(2 * left + 1, -1, np.int64)  # the part that reached a sum first
    for k, (i, n) in enumerate(parts):
        new = reach << int(length[i]) * n & low & ~reach
        if new:
            reach |= new
            raw = new.to_bytes(2 * left // 8 + 1, "little")
            first[np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))] = k
            goal = nearest_bit(reach, left)
            if abs(goal - left) <= least:
                break
    chosen = []
    while goal:
        i, n = parts[first[goal]]
        chosen.append((i, n))
        goal -= int(length[i]) * n
    return chosen


def nearest_bit(bits: int, at: int) -> int:
    """The set bit nearest to ``at``; the lower one in a tie."""
    low = (bits & ((1 << (at + 1)) - 1)).bit_length() - 1
    above = bits >> (at + 1)
    high = at + (above & -above).bit_length() if above else None
    return high if high is not None and high - at < at - low else low


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of documents (doc_id, text, source).

    Driver memory is one row a source; the program's input is one row for each length that a source has.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.write(docs.select("doc_id", "source", word_count().alias("size")), "sized")
    totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    names = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    sizes = [int(totals[s]) for s in names]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    full = [min(MAX_COPIES, int(t // s)) if s else 0 for t, s in zip(targets, sizes)]
    rest = [min(s, round(t - f * s)) if f < MAX_COPIES else 0 for t, s, f in zip(targets, sizes, full)]
    plan = spark.createDataFrame(
        pd.DataFrame({"sid": pd.Series(range(len(names)), dtype="int64"), "name": pd.Series(names, dtype="object"), "source_size": pd.Series(sizes, dtype="int64"), "target": pd.Series(targets, dtype="float64"), "full": pd.Series(full, dtype="int64"), "rest": pd.Series(rest, dtype="int64")}),
        "sid long, name string, source_size long, target double, full long, rest long",
    )
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("name")))
    rows = rows.withColumn("o", order).withColumn("part", F.shiftrightunsigned("o", 64 - ORDER_PARTS.bit_length() + 1))

    counts = rows.where("rest > 0 and size > 0").groupBy("sid", "size", "part", "rest").agg(F.count("*").alias("n"))
    counts = scratch.write(counts, "counts")

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = fit_budget(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["rest"].iloc[0]))
        return pd.DataFrame({"sid": key[0], "size": frame["size"], "want": n})

    lengths = counts.groupBy("sid", "size", "rest").agg(F.sum("n").alias("n"))
    wants = lengths.groupBy("sid").applyInPandas(choose, "sid long, size long, want long")
    before = F.sum("n").over(Window.partitionBy("sid", "size").orderBy("part")) - F.col("n")
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("want") - F.col("before")))
    # both tables grow with the lengths of documents, and Spark would judge them by their small files
    quotas = counts.withColumn("before", before).join(wants.hint("merge"), ["sid", "size"]).select("sid", "size", "part", quota.alias("quota"))
    quotas = scratch.write(quotas.where("quota > 0"), "quotas")

    ranked = rows.join(quotas.hint("merge"), ["sid", "size", "part"], "left")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("o", "doc_id"))
    copies = F.col("full") + F.when(rank <= F.coalesce("quota", F.lit(0)), 1).otherwise(0)
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
