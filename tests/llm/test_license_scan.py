import random
import re

from graphloom.llm.license_scan import BASE, NOTICE_LIST, Scanner, scan_document, scan_licenses, split_pieces

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    found = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in BASE:
        own = phrase.split()
        at = [i for i in range(len(found) - len(own) + 1) if found[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Released under the MIT License.", "mit-license MIT LICENSE, mit licenses", "the Apache License; Version 2", "GNU General Public License", "general public\nlicense general public license", "summit license", "mité license", None, "", "mit license " * 400, "MIT mit license license",
]


def test_base_places():
    scanner = Scanner()
    for text in TEXTS:
        assert scan_document(scanner, (text or "").encode())[:5] == brute(text), text


def test_fuzzy_notices():
    scanner = Scanner()
    look = lambda t: scan_document(scanner, t.encode())
    assert look("Licensed under teh Apache Lisense, version 2.0")[5] == "apache"
    assert look("mit licence")[4:6] == ("", "mit")
    assert look("Licensed under CC BY-NC 4.0.")[5] == "cc-by,cc-by-nc" or "cc-by-nc" in look("Licensed under CC BY-NC 4.0.")[5]
    assert look("redistribution and use in sorce and binary forms are permitted")[5] == "bsd"
    assert look("a plain text about the weather in general and its use")[5:7] == ("", 0.0)
    span = look("one two all rights reserved three")[7]
    assert span == [{"start": 2, "end": 5, "label": "proprietary", "edits": 0}]


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (c != d)))
        before = now
    return before[-1]


def test_notices_against_brute_force():
    """A notice is found exactly where some stretch of whole words is within its edits."""
    rng, scanner = random.Random(12), Scanner()
    some = "the software of use code by in cc license general and mit all right".split()
    found = []
    for trial in range(150):
        x = rng.choice(NOTICE_LIST)
        letters = list(x.text)
        for _ in range(rng.randrange(0, x.edits + 3)):
            at, kind = rng.randrange(len(letters)), rng.randrange(3)
            letters[at : at + (kind != 1)] = [rng.choice("abcdefghijklmnopqrstuvwxyz ")] if kind != 2 else []
        text, _ = scanner.normalise(" ".join([*rng.choices(some, k=rng.randrange(4)), "".join(letters), *rng.choices(some, k=rng.randrange(4))]).encode())
        words = text.split()
        stretches = [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        wanted = {k for k, y in enumerate(NOTICE_LIST) if any(abs(len(t) - len(y.text)) <= y.edits and distance(t, y.text) <= y.edits for t in stretches)}
        hits = scanner.scan(text)
        assert {k for _, _, k, _ in hits} == wanted, text
        for a, b, k, edits in hits:  # spans of whole words, with the edits told or fewer
            assert (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ") and distance(text[a:b], NOTICE_LIST[k].text) <= edits <= NOTICE_LIST[k].edits
        found.append(len(hits) > 0)
    assert 40 < sum(found) < 150


def test_pieces_cover():
    for edits in range(5):
        pieces = split_pieces("general public license", edits)
        assert len(pieces) == edits + 1 and "".join(p for _, p in pieces) == "general public license"


def test_table(odd, empty):
    rows, docs = odd
    got = sorted((tuple(r)[:6] for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert scan_licenses(empty).count() == 0
