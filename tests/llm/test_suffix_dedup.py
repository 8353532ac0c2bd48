import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm.suffix_dedup import difference_cover, remove_passages, remove_repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        end = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[max(i, end) : i + length] = True
                end = i + length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = int((np.diff(gone.astype(int)) == -1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_against_brute_force(odd, length):
    rows, docs = odd
    rows = [r for r in rows if r[1] is None or len(r[1]) < 100_000]
    small = docs.where("text is null or length(text) < 100000")
    got = Counter(tuple(r) for r in remove_repeats(small, length).collect())
    assert got == Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], length)))


def brute_words(texts, length):
    """(bytes, removed, runs, digest) where words go that belong to ``length`` words standing in two documents."""
    spans = [[m.span() for m in re.finditer(r"[\u4e00-\u9fff]|[^\x20\x09-\x0D\u4e00-\u9fff]+", t or "")] for t in texts]
    words = [tuple((t or "")[i:j] for i, j in s) for t, s in zip(texts, spans)]
    seen = Counter(x for w in words for x in {w[i : i + length] for i in range(len(w) - length + 1)})
    out = []
    for t, s, w in zip(texts, spans, words):
        gone = [False] * (len(t or "") + 1)
        for i in range(len(w) - length + 1):
            if seen[w[i : i + length]] > 1:
                gone[s[i][0] : s[i + length - 1][1]] = [True] * (s[i + length - 1][1] - s[i][0])
        for i in range(len(s) - 1):  # blanks between two words that go
            if gone[s[i][0]] and gone[s[i + 1][0]]:
                gone[s[i][1] : s[i + 1][0]] = [True] * (s[i + 1][0] - s[i][1])
        kept = "".join(c for c, g in zip(t or "", gone) if not g).encode()
        runs = sum(gone[i] and not gone[i + 1] for i in range(len(gone) - 1))
        out.append((len((t or "").encode()), len((t or "").encode()) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [50, 12])
def test_passages_against_brute_force(spark, odd, length):
    rows, docs = odd
    small = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 50_000]
    passage = "Ünï " + "中文字" * 17 + " «que» tail"
    small += [(900, f"a b {passage} c"), (901, f"x\u00a0y {passage.replace(' ', chr(10) * 2)} z"), (902, passage)]
    loop = "la li lu le lo " * 60
    small += [(903, loop), (904, loop + "once more"), (905, "do re mi fa so " * 60), (906, "do re mi fa so " * 3), (907, passage + " " + loop + passage)]
    got = Counter(tuple(r) for r in remove_passages(spark.createDataFrame(small, "doc_id long, text string").repartition(3), length).collect())
    want = Counter((r[0], *b) for r, b in zip(small, brute_words([r[1] for r in small], length)))
    assert got == want and sum(r[3] > 0 for r in want) > 10
    both = remove_repeats(spark.createDataFrame(small, "doc_id long, text string"), 60, passage_words=length).collect()
    assert Counter((r["doc_id"], r["n_passage_bytes"], r["n_passages"]) for r in both) == Counter((r[0], r[2], r[3]) for r in want.elements())
    assert Counter(tuple(r)[:5] for r in both) == Counter((r[0], *b) for r, b in zip(small, brute([r[1] for r in small], 60)))


def test_long_repetition_and_text(spark, odd):
    _, docs = odd
    found = remove_repeats(docs.where("length(text) > 10000"), with_text=True).collect()
    assert len(found) == 2 and all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 and bytes(r["kept"]) == b"" for r in found)


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11, 13])
def test_cover(q):
    v, cover = difference_cover(q)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) == q + 1


def test_many_short_texts_of_few_words(spark):
    """Overlapping copies within and across documents, chunks of one document and of many."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(300):
        t = " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 40)).tolist())
        texts.append(t if rng.random() < 0.7 or not texts else texts[rng.integers(0, len(texts))] + " " + t)
    rows = list(enumerate(texts))
    for parts in (1, 7, 300):
        got = Counter(tuple(r) for r in remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 11).collect())
        assert got == Counter((i, *b) for (i, _), b in zip(rows, brute_words(texts, 11)))
