import random

from graphloom.llm.common import id_remainder
from graphloom.llm.toxicity import THRESHOLD, Automaton, Model, Scorer, Term, allowed_edits, choose_terms, score_texts, train


def distance(a, b, prefix):
    """Edit distance of term a to word b, or to its nearest beginning."""
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before) if prefix else before[-1]


def test_automaton_against_brute_force():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    for _ in range(40):
        terms = [Term(word(rng.randrange(3, 11)), rng.random() < 0.4) for _ in range(5)]
        automaton = Automaton(terms)
        for _ in range(60):
            w = word(rng.randrange(1, 12)) if rng.random() < 0.5 else rng.choice(terms).text[: rng.randrange(2, 12)] + word(rng.randrange(0, 3))
            w = w.replace("a", "é") if rng.random() < 0.1 else w
            found = [(d, k) for k, t in enumerate(terms) if (d := distance(t.text, w, t.prefix)) <= allowed_edits(len(t.text))]
            assert automaton.match(w) == min(found, default=None), (terms, w)


def test_context():
    model = Model([Term("idiot", False)], {(0, 0): 4.0, (0, 1): 2.0}, 2.0, -2.0)
    look = lambda t: Scorer(model).total(t.encode())
    plain = look("what an idiot that was")
    assert plain == (4.0, 1) and look("an idi0t idoit walks")[1] == 1 and look("nothing here") == (0.0, 0)
    assert look('they "what an idiot that was" heard')[0] < plain[0] < look("you idiot")[0]
    assert look("he said idiot once")[0] < plain[0] and look("IDIOT!!")[0] == 4.0


def test_terms():
    found = choose_terms([("idio", 9, 0, 0), ("idiot", 9, 9, 0), ("vequ", 20, 0, 0), ("vequa", 5, 1, 0), ("vequb", 15, 2, 0)])
    assert found == [Term("idiot", False), Term("vequ", True)]


def test_all_supported_terms_are_learned(spark):
    """More than two thousand terms, short words among them; none goes by its place in the alphabet."""
    rng = random.Random(2)
    bad = [f"{a}{b}{c}{d}x" for a in "abcdefgz" for b in "aeiou" for c in "klmnpqrst" for d in "uvwxyz"] + ["qx", "zzz", "毒"]
    clean = [f"good{i}" for i in range(300)] + ["qxa", "be", "zza"]
    rows = [(" ".join(rng.sample(clean, 8) + part), 1) for k in range(4) for order in [rng.sample(bad, len(bad))] for part in (order[i::40] for i in range(40))] + [(" ".join(rng.sample(clean, 8)), 0) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    scorer = Scorer(model)
    assert len(bad) > 2000 and all(scorer.total(w.encode())[1] == 1 for w in bad) and not any(scorer.total(w.encode())[1] for w in clean)


def test_held_out(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        return
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = id_remainder("doc_id", 3) == 1
    model = train(docs, labels.where(~held))
    rows = score_texts(docs, model).join(labels, "doc_id").where(held).collect()
    toxic = [r["score"] >= THRESHOLD for r in rows if r["toxic"] == 1]
    clean = [r["score"] >= THRESHOLD for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_odd_rows(spark, odd, empty):
    rows, docs = odd
    labels = spark.createDataFrame([(r[0], (0, 1, None)[i % 3]) for i, r in enumerate(rows)], "doc_id long, toxic int")
    model = train(docs, labels)
    found = score_texts(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    none = train(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in score_texts(docs, none).collect()} == {0.0}
    assert score_texts(empty, model).count() == 0
    assert not train(empty, labels).terms
