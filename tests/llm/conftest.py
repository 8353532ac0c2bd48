import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ["key", "n", "size", "chunk", "bucket", "root", "part", "hits", "score", "label", "group", "gram", "ids", "kept", "rejected", "o", "total", "idx"]


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    found = text.split()
    for i in range(len(found)):
        if rng.random() < share:
            found[i] = f"x{rng.randrange(10**6)}"
    return " ".join(found)


def odd_rows():
    """Copies, near copies, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(4)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", None, "a", 4), (None, "A null id and some words here", "en", "b", 5), (None, None, None, None, None), (3, "one", "en", None, 3), (4, "ONE", "fr", "", 3)]
    base = [words(rng, n) for n in (3, 4, 5, 40, 120, 300, 700)]
    k = 10
    for text in base:
        for share in (0, 0, 0.01, 0.03, 0.08, 0.3):
            rows.append((k, edited(rng, text, share), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "srcé"]), len(text)))
            k += 1
    shared = words(rng, 110)
    for _ in range(6):
        rows.append((k, f"{words(rng, 30)} {shared} {words(rng, 25)}", "en", "a", 1))
        k += 1
    rows.append((k, "loñg 中文 " * 30_000, "es", "b", 1))
    rows.append((k + 1, "same " * 3000, "en", "b", 1))
    rows += [rows[12], rows[12], rows[20]]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of documents, and the frame of them with further columns."""
    rows = odd_rows()
    schema = SCHEMA + "".join(f", {c} string" for c in CLASHING)
    return rows, spark.createDataFrame([(*r, *["clash"] * len(CLASHING)) for r in rows], schema).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
