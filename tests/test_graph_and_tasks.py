import pytest

from graphloom.operators import graph as G
from graphloom.operators import tasks as T
from graphloom.plans.pagerank import Graph
from graphloom.sources.generator import generate, verify

SMALL = T.TaskLimits(4, 16, 8)


def histogram(df):
    return {r["degree"]: r["vertices"] for r in G.degree_histogram(df).collect()}


def test_reduced_skew_profile(spark):
    edges = generate(spark, "reduced-skew")
    assert edges.count() == G.distinct_edges(edges).count() == 404
    g = Graph.build(edges)
    assert histogram(g.in_degrees()) == {3: 31, 4: 67, 9: 2, 25: 1}
    assert histogram(g.out_degrees) == {3: 21, 4: 79, 25: 1}
    assert {r["idx"]: r["degree"] for r in G.hub_vertices(g.in_degrees(), 4).collect()} == {0: 25, 1: 9, 2: 9}
    assert {r["name"]: r["violations"] for r in G.graph_invariants(g.vertices, g.edges, g.in_degrees(), g.out_degrees).collect()} == dict.fromkeys(
        ["ids_ascending", "ids_dense", "edge_ends_in_range", "edges_unique", "in_degree_range", "out_degree_range", "in_degree_sum", "out_degree_sum"], 0
    )
    assert G.out_degree_audit(g.edges, g.out_degrees).count() == 0
    assert {r["kind"]: r["n"] for r in verify(edges, "reduced-skew").collect()} == {"missing": 0, "surplus": 0}
    text = G.encode_manifest(G.graph_manifest(g.vertices, g.edges, 4, 16, 8).first())
    assert G.parse_manifest(text)["edge_count"] == 404
    with pytest.raises(ValueError):
        G.parse_manifest(text.replace(",", ", "))


def test_tasks(spark):
    degrees = Graph.build(generate(spark, "reduced-skew")).in_degrees()
    tasks = T.task_partition(degrees, SMALL)
    rows = sorted((tuple(r) for r in tasks.collect()), key=lambda r: (r[4], r[2]))
    assert len(rows) == 36 and sum(r[0] == 2 for r in rows) == 13
    assert rows[:3] == [(2, 0, i, 7, 4 * i, 4) for i in range(3)]
    assert rows[-1] == (1, 97, 4, 0, 388, 16)
    assert {r["violations"] for r in T.task_validation(tasks, degrees, SMALL).collect()} == {0}
    bad = tasks.where("not (tag = 1 and a = 97)")
    assert T.task_validation(bad.selectExpr("tag", "a", "if(tag = 1, b + 1, b) as b", "c", "edge_begin", "edge_count"), degrees, SMALL).where("violations > 0").count() > 0
    assert [tuple(r) for r in T.task_partition(degrees, T.TaskLimits()).collect()] == [(1, 0, 101, 0, 0, 404)]
    for limits in ((0, 1, 1), (5, 4, 1)):
        with pytest.raises(ValueError):
            T.TaskLimits(*limits)


def test_packing_in_many_blocks(spark, monkeypatch):
    """The tasks of blocks of few destinations against one walk over all of them."""
    import random

    rng = random.Random(11)
    monkeypatch.setattr(T, "BLOCK_VERTICES", 32)
    for trial in range(6):
        limits = T.TaskLimits(rng.randrange(2, 9), rng.randrange(9, 30), rng.randrange(1, 9))
        degrees = [rng.choice([0, 1, 2, rng.randrange(12), 40]) if trial else 0 for _ in range(rng.randrange(300, 900))]
        wanted, task, begin = [], None, 0
        for i, d in enumerate(degrees):
            hub = d > limits.edge_slice_size
            if task and (hub or task[1] == limits.max_task_vertices or task[3] + d > limits.max_task_edges):
                wanted.append((1, task[0], task[1], 0, task[2], task[3]))
                task = None
            if not hub:
                task = [task[0], task[1] + 1, task[2], task[3] + d] if task else [i, 1, begin, d]
            begin += d
        wanted += [(1, task[0], task[1], 0, task[2], task[3])] if task else []
        df = spark.createDataFrame(list(enumerate(degrees)), "idx int, degree long").repartition(5)
        assert sorted(map(tuple, T.ordinary_tasks(df, limits).collect())) == wanted
    assert T.ordinary_tasks(df.limit(0), limits).count() == 0


def test_dense_index_of_many_partitions(spark):
    df = spark.range(5000).selectExpr("cast(pmod(id * 7919, 5000) as int) as vid").repartition(9)
    assert all(r["vid"] == r["idx"] for r in G.dense_index(df, ["vid"]).collect())
    assert G.dense_index(df.limit(0), ["vid"]).count() == 0


def test_empty_graph_and_duplicates(spark):
    empty = spark.createDataFrame([], "src int, dst int")
    assert tuple(G.duplicate_summary(empty).first()) == (0, 0, 0)
    some = spark.createDataFrame([(1, 2), (1, 2), (3, 3)], "src int, dst int")
    assert tuple(G.duplicate_summary(some).first()) == (3, 2, 1)
    assert [tuple(r) for r in G.self_loops(some).collect()] == [(3, 3)]
