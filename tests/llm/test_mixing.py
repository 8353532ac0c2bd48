import random
import re
from collections import Counter

import numpy as np

from graphloom.llm.mixing import fill_targets, fit_budget, mix, nearest_bit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert fill_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert fill_targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert fill_targets([0, 0], [5, 2]) == [0.0, 0.0]
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 9)
        sizes = [rng.randrange(0, 1000) for _ in range(n)]
        found = fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)])
        assert abs(sum(found) - sum(sizes)) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in zip(found, sizes))


def best(lengths, counts, budget):
    reach = {0}
    for length, n in zip(lengths, counts):
        reach = {r + k * length for r in reach for k in range(n + 1)}
    return min(abs(r - budget) for r in reach)


def test_budget():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 6)
        lengths = np.array(sorted(rng.sample(range(1, 60), n)))
        counts = np.array([rng.randrange(1, 6) for _ in range(n)])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 1)
        take = fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        # proportional shares come first, so a small case may miss the optimum by less than its largest length
        assert abs(int((take * lengths).sum()) - budget) <= best(lengths, counts, budget) + int(lengths.max())
    lengths = np.arange(1, 3000)
    counts = np.full(len(lengths), 50)
    for budget in (1, 77, 1_000_003, 150_000_001):
        assert int((fit_budget(lengths, counts, budget) * lengths).sum()) == budget
    assert nearest_bit(0b1001, 2) == 3 and nearest_bit(0b1001, 1) == 0


def check(rows, found):
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((r[0], r[3], size(r[1])) for r in rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in names]
    targets = dict(zip(names, fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    for s, total in zip(names, sizes):
        own = [r for r in found if r["source"] == s]
        assert all(r["source_size"] == total and abs(r["target"] - targets[s]) < 1e-6 for r in own)
        assert all(r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"] for r in own)
        longest = max((r["size"] for r in own), default=0)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= longest


def test_table(odd, empty):
    rows, docs = odd
    found = mix(docs).collect()
    check(rows, found)
    assert Counter(map(tuple, found)) == Counter(map(tuple, mix(docs.repartition(2)).collect()))
    assert mix(empty).count() == 0


def test_driver_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    check([tuple(r) for r in docs.collect()], mix(docs).collect())


def miss(lengths, counts, budget):
    lengths, counts = np.array(lengths), np.array(counts)
    take = fit_budget(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    return abs(int((take * lengths).sum()) - budget)


def test_budget_of_many_and_of_long_lengths():
    rng = np.random.default_rng(5)
    for n, share in ((1000, 0.8), (1000, 0.95), (3000, 0.95)):
        lengths, counts = np.unique(np.maximum(1, rng.lognormal(5.2, 1.0, n)).astype(np.int64), return_counts=True)
        assert miss(lengths, counts, int(share * (lengths * counts).sum())) == 0
    assert miss(range(1, 601), [1] * 600, 60000) == 0
    assert miss([300001, 300002, 300003, 300004, 300005], [1] * 5, 500000) < 100100
    assert miss([300000], [5], 500000) == 100000
    assert miss([200000], [3], 390000) == 10000
    assert miss([200001, 200002, 200003], [1] * 3, 390000) < 11000
    assert miss([40000, 60000], [30, 30], 1_500_001) == 1
    assert miss(range(20, 6001, 20), [1] * 300, 100_013) == 7
