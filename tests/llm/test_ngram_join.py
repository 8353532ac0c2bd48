import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import ngram_join as module
from graphloom.llm.ngram_join import candidate_forest, levels, ngram_join, overlaps, passes, prefix_length

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, gram):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < gram:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + gram]) for i in range(len(found) - gram + 1))


def brute(rows, gram, percent):
    sets = [shingles(r[1], gram) for r in rows]
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            having[g].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in having[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), r[0] if not sets[i] else min(least[find(i)], default=None), links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("gram,percent", [(4, 85), (5, 80)])
def test_odd_rows(odd, gram, percent):
    rows, docs = odd
    assert Counter(map(tuple, ngram_join(docs, gram, percent).collect())) == brute(rows, gram, percent)


def test_groups_of_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"w{rng.randrange(900)}" for _ in range(150)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 % 241, " ".join(own)))
    for family in range(40):  # one n-gram that many share who are no near copies, of all sizes
        rows.append((len(rows) * 3, "a very common phrase " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60)))))
    monkeypatch.setattr(module, "BLOCK_SETS", 16)
    monkeypatch.setattr(module, "LEAST_SETS", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = brute(rows, 4, 85)
    for hot in (2048, 12):
        monkeypatch.setattr(module, "HOT_ROWS", hot)
        assert Counter(map(tuple, ngram_join(docs, 4, 85).collect())) == wanted


def test_sets_of_one_key(spark, monkeypatch):
    """Keys of three bits: sets of one key are told apart by their checks."""
    rng = random.Random(12)
    rows = []
    for family in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 60))]
        for copy in range(rng.randrange(1, 4)):
            own = list(base)
            if copy == 2:
                own[rng.randrange(len(own))] = "other"
            rows.append((len(rows), " ".join(own)))
    monkeypatch.setattr(module, "KEY_BITS", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_join(docs, 4, 85).collect())) == brute(rows, 4, 85)


def test_empty(empty):
    assert ngram_join(empty).count() == 0


def test_filters_lose_nothing():
    rng = random.Random(2)
    for _ in range(400):
        percent = rng.choice([80, 85, 95])
        x = set(rng.sample(range(60), rng.randrange(1, 40)))
        y = set(x)
        for _ in range(rng.randrange(0, 6)):
            y ^= {rng.randrange(60)}
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        a, b = sorted(x), sorted(y)
        first = min(x & y)
        i, j = a.index(first), b.index(first)
        assert i < prefix_length(len(a), percent) and j < prefix_length(len(b), percent)
        assert passes(len(a), i, len(b), j, percent)


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(module, "SPARSE", 3)
    x = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 30, 50, 20)]
    y = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (40, 2, 30)]
    assert (overlaps(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_forest_spans_and_levels():
    rng = np.random.default_rng(4)
    n = rng.integers(80, 120, 50)
    pos = rng.integers(0, 12, 50)
    ranges = rng.integers(0, 3, (50, 64)).astype(np.uint8)
    edges = candidate_forest(np.arange(50), n, pos, ranges, 80)
    assert len(edges) == len(set(edges)) < 50
    assert levels(np.array([1, 2, 3, 4, 5, 8, 9, 10**9])).tolist() == [0, 1, 2, 2, 3, 3, 4, 15]
