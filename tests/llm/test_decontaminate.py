import random

import numpy as np
import pytest

from graphloom.llm import decontaminate
from graphloom.llm.decontaminate import EDIT_SHARE, LEAST_WORDS, edit_distance_within, find_items


def brute(pattern, text):
    """Least edit distance of the pattern to any stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p != t)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        assert edit_distance_within(np.array(pattern), masks, text)[0] == brute(pattern, text)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 50)))) for i in range(40)] + [(100, None), (101, "too short"), (None, "")]
    docs = []
    for d in range(200):
        around = [word() for _ in range(120)]
        if d % 2:
            own = items[d % 40][1].split()
            for _ in range(int(EDIT_SHARE * len(own) * (d % 8) / 8)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            around[40:40] = own
        docs.append((d, ", ".join(around).upper() if d % 3 else " ".join(around)))
    return items, docs


def test_against_brute_force(spark, planted):
    items, docs = planted
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], h["item_id"]): h["distance"] for r in found.collect() for h in r["hits"]}
    want = {}
    for d, text in docs:
        own = text.lower().replace(",", "").split()
        for i, t in items:
            if t and len(t.split()) >= LEAST_WORDS and (k := brute(t.split(), own)) <= int(EDIT_SHARE * len(t.split())):
                want[d, i] = k
    assert len(want) >= 95
    assert set(got) <= set(want)
    assert sum(k in got for k in want) >= 0.98 * len(want)
    assert all(want[k] == got[k] for k in got if want[k] == 0)


def test_odd_rows(spark, odd, empty):
    rows, docs = odd
    bench = spark.createDataFrame([(7, rows[30][1]), (8, "no words of this item stand in any text"), (7, None)], "item_id long, text string")
    found = find_items(docs, bench).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"] for r in found if r["hits"]} >= {rows[30][0]}
    assert not any(r["hits"] for r in find_items(docs, bench.limit(0)).collect())
    assert find_items(empty, bench).count() == 0


def test_blocks_of_items(spark, planted):
    items, docs = planted
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    exact = lambda df: {(r["doc_id"], h["item_id"]) for r in df.collect() for h in r["hits"] if h["distance"] == 0}
    assert exact(find_items(docs, bench)) == exact(find_items(docs, bench, items_per_pass=10))


def found_share(items, lengths, edits, searcher, rng, copies=200):
    """Of copies with random edits between words of their own, how many of the items of these lengths are found."""
    hit = total = 0
    for k, (_, words) in enumerate(items):
        if len(words) not in lengths:
            continue
        for _ in range(copies):
            own = words.tolist()
            for _ in range(min(edits, int(EDIT_SHARE * len(words)))):
                own[rng.randrange(len(own))] = rng.randrange(1, 1 << 62)
            text = [rng.randrange(1, 1 << 62) for _ in range(20)] + own + [rng.randrange(1, 1 << 62) for _ in range(20)]
            hit += k in {i for i, *_ in searcher.search(np.array(text, np.uint64), np.array([0, len(text)])).get(0, [])}
            total += 1
    return hit / total


def test_short_items_among_long_ones():
    rng = random.Random(8)
    lengths = [5, 6, 8, 10, 12, 14] + [40] * 120
    items = [(i, np.array([rng.randrange(1, 1 << 62) for _ in range(n)], np.uint64)) for i, n in enumerate(lengths)]
    searcher = decontaminate.Searcher(items)
    for edits in (0, 1, 2):
        assert found_share(items, {5, 6, 8, 10, 12, 14}, edits, searcher, rng) == 1
    assert found_share(items[:20], {40}, 8, searcher, rng, 20) >= 0.98


def test_classes_that_miss_the_target_are_found_by_pieces(monkeypatch):
    rng = random.Random(6)
    items = [(i, np.array([rng.randrange(1, 1 << 62) for _ in range(n)], np.uint64)) for i, n in enumerate([16, 18, 40])]
    monkeypatch.setattr(decontaminate, "TARGET_RECALL", 1.1)
    searcher = decontaminate.Searcher(items)
    assert searcher.missed == {3, 8}
    for k, (_, words) in enumerate(items):
        if searcher.edits(k) in searcher.missed:
            assert found_share(items, {len(words)}, 8, searcher, rng, 100) == 1


def test_distances_of_many_regions():
    rng = random.Random(5)
    for _ in range(100):
        pattern = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 14))], np.uint64)
        regions = np.array([[rng.randrange(1, 5) for _ in range(17)] for _ in range(5)], np.uint64)
        masks = {}
        for i, w in enumerate(pattern.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        want = [edit_distance_within(pattern, masks, r.tolist()) for r in regions]
        assert list(zip(*(x.tolist() for x in decontaminate.edit_distances(pattern, regions)))) == want


def test_few_words_and_scripts_without_spaces(spark):
    items = [(0, "Yes"), (1, "forty two"), (2, "What is it?"), (3, "她昨天在图书馆借了三本关于历史的书"), (4, "東京の天気は?"), (5, "เมื่อวานนี้ฉันไปตลาด"), (6, "“Déjà vu”"), (7, "。"), (8, None)]
    docs = [
        (0, "He said: YES, forty-two!"), (1, "So what is it, then; forty and two"), (2, "昨天我听说，她昨天在图书馆借了三本关于历史的书。然后回家了"),
        (3, "昨天我听说，她昨天在图书馆借了两本关于历史的书。然后回家了"), (4, "質問：東京の天気は？晴れです"), (5, "ฉันบอกว่าเมื่อวานนี้ฉันไปตลาดกับแม่"), (6, "c'est du Déjà vu, dit-elle"), (7, "nothing here 。 yesterday"),
        (8, "昨天我们去了北京"), (None, "yes"),
    ]
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits"]] for r in found}
    assert got == {0: [(0, 0), (1, 0)], 1: [(2, 0)], 2: [(3, 0)], 3: [(3, 1)], 4: [(4, 0)], 5: [(5, 0)], 6: [(6, 0)], 7: [], 8: [], None: [(0, 0)]}
