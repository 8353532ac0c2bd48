import math

import numpy as np

from graphloom.llm.embed_dedup import Index, find_near, nearest, unit_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, links string, root string, cell string"


def brute(rows, least):
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = [[] for _ in range(n)]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i != j and a is not None and a == b and good(v) and good(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    link[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), root, rows[i][0] == root))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            base = rng.normal(size=24)
            for noise in (0, 0, 0.01, 0.05, 0.15, 0.2, 0.25)[: rng.integers(1, 8)]:
                rows.append((k, [float(np.float32(x)) for x in base + noise * rng.normal(size=24)], label))
                k += 1
    odd = [None, [], [0.0] * 24, [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")], [None] * 24, [1.0] * 8, [2.0] * 8, [3e38] * 24, [1e38] * 24, [1e-40] * 24]
    rows += [(k + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[3][1], rows[3][2]), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(6)
    assert sorted(map(tuple, find_near(df).collect()), key=str) == brute(rows, 0.98)
    assert find_near(df.limit(0)).count() == 0


def test_doubles_and_text_labels(spark):
    """Cosines that a cast to single precision would move over the bound, numbers beyond its range, labels of text."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        x, y = rng.normal(size=6), rng.normal(size=6)
        x /= math.sqrt(x @ x)
        y -= (y @ x) * x
        y /= math.sqrt(y @ y)
        z = 0.98 * x + math.sqrt(1 - 0.98**2) * y + (1e-12, -1e-12)[i % 2] * x
        rows += [(2 * i, x.tolist(), f"l{i % 7}"), (2 * i + 1, z.tolist(), f"l{i % 7}")]
    rows += [(900, [1e100, 2e100], "é"), (901, [1e-100, 2e-100], "é"), (902, [1.0, 2.0], ""), (903, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    assert sorted(map(tuple, find_near(df).collect()), key=str) == brute(rows, 0.98)


def test_many_lists_and_blocks_lose_nothing(spark, monkeypatch):
    import graphloom.llm.embed_dedup as e

    monkeypatch.setattr(e, "LIST_SIZE", 60)
    monkeypatch.setattr(e, "BLOCK_SIZE", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 16))
    rows = [(i, [float(np.float32(x)) for x in base[i % 150] + (0.12 if i >= 150 else 0) * rng.normal(size=16)], 1) for i in range(600)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, find_near(df).collect()), key=str) == brute(rows, 0.98)


def test_index_bounds():
    rng = np.random.default_rng(7)
    x = unit_vectors(rng.normal(size=(500, 32)))
    index = Index.fit(x, 8)
    cells = nearest(x, index.centres)
    codes, error = index.encode(x, cells)
    for cell in range(len(index.centres)):
        own = np.flatnonzero(cells == cell)
        table = np.sqrt(index.distances(x[:50], codes[own], cell))
        true = np.sqrt(((x[:50, None] - x[own][None]) ** 2).sum(axis=2))
        assert (table - error[own][None] <= true + 1e-3).all()
    probed = {(j, int(i)) for j, rows in index.probes(x, cells, 0.5) for i in rows}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    for a, b in zip(*np.nonzero(near)):
        if cells[a] < cells[b]:
            assert (int(cells[b]), int(a)) in probed
