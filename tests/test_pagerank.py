import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.errors import VertexLimitError
from graphloom.functions.thresholds import RankConfig, accepts, worth_checking
from graphloom.plans.pagerank import Graph, iterate, rank, run
from graphloom.sources.generator import Profile, generate

# name: edges, iterations, residual checks, ranks as they print in 17 digits
GOLDEN = {
    "cycle": ([(1, 2), (2, 3), (3, 1), (4, 1)], 126, 7, {1: "0.33260447025394224", 2: "0.32021379971585084", 3: "0.30968173003020694", 4: "0.037500000000000006"}),
    "self_loop": ([(1, 1)], 1, 1, {1: "1"}),
    "dangling": ([(0, 1)], 24, 1, {0: "0.35087719316229288", 1: "0.64912280683770718"}),
    "two_cycle": ([(0, 1), (1, 0)], 1, 1, {0: "0.5", 1: "0.5"}),
    "dup_star": ([(1, 0), (2, 0), (2, 0), (3, 0), (0, 0)], 2, 1, {0: "0.88750000000000007", 1: "0.037500000000000012", 2: "0.037500000000000012", 3: "0.037500000000000012"}),
}
EXTREMES = [(-2147483648, 2147483647), (2147483647, -2147483648), (-1, -2147483648)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src int, dst int")


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    edges, k, c, ranks = GOLDEN[name]
    report, found = rank(frame(spark, edges))
    assert (report.status, report.iterations, report.residual_checks) == ("converged", k, c)
    assert {r["vertex"]: f"{r['rank']:.17g}" for r in found.collect()} == ranks


def test_extreme_ids(spark):
    report, found = rank(frame(spark, EXTREMES))
    assert (report.iterations, report.residual_checks) == (128, 7)
    assert [(r["vertex"], f"{r['rank']:.17g}") for r in found.orderBy("vertex").collect()] == [(-2147483648, "0.48648648634498903"), (-1, "0.05000000000000001"), (2147483647, "0.46351351365501092")]


def test_reduced_skew_and_limits(spark):
    g = Graph.build(generate(spark, "reduced-skew"))
    report, found = run(g)
    assert (report.iterations, report.residual_checks) == (92, 5)
    assert f"{report.delta_l1:.4e} {report.true_residual_l1:.4e}" == "6.4639e-10 5.2438e-10"
    ranks = {r["vertex"]: f"{r['rank']:.17g}" for r in found.collect()}
    assert [ranks[i] for i in (0, 1, 2, 100)] == ["0.03599222383511036", "0.020655119751069498", "0.0243578774691929", "0.0095793125941659486"]
    report, found = run(g, RankConfig(alpha=0.5))
    assert (report.iterations, report.residual_checks) == (23, 1)
    with pytest.warns(UserWarning):
        report, found = run(g, RankConfig(eta=6.2e-9, max_iterations=130))
    assert report.status == "non_converged" and found is None
    with pytest.raises(VertexLimitError):
        run(g, RankConfig(max_vertices=100))


def test_partitioning_does_not_matter(spark):
    edges = generate(spark, "reduced-skew")
    one = iterate(Graph.build(edges), 10, edge_slice_size=4)[1].orderBy("vertex").collect()
    again = edges.unionByName(edges.limit(50)).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        two = iterate(Graph.build(again), 10, edge_slice_size=4)[1].orderBy("vertex").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two


def test_strategies_and_direct_solution(spark):
    rng = np.random.default_rng(1)
    n = 60
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (150, 2))]
    g = Graph.build(frame(spark, edges))
    report, gathered = run(g)
    got = {r["vertex"]: r["rank"] for r in gathered.collect()}
    _, joined = iterate(g, 5, strategy="join")
    _, five = iterate(g, 5)
    near = {r["vertex"]: r["rank"] for r in five.collect()}
    assert max(abs(near[r["vertex"]] - r["rank"]) for r in joined.collect()) < 1e-15
    ids = sorted(got)
    place = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for a, b in set(edges):
        m[place[b], place[a]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(ids))
    r = np.linalg.solve(np.eye(len(ids)) - 0.85 * m, np.full(len(ids), 0.15 / len(ids)))
    assert np.abs(r - np.array([got[v] for v in ids])).sum() <= 1e-8


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1e-7), st.floats(0.01, 0.99), st.floats(1e-12, 1e-3))
def test_thresholds_are_exact(x, alpha, eta):
    from fractions import Fraction as Q

    c = RankConfig(alpha=alpha, eta=eta)
    assert worth_checking(x, c) == (Q(alpha) * Q(x) <= Q(eta) - Q(alpha) * Q(eta))
    assert accepts(x, c) == (Q(x) <= Q(eta) * (1 - Q(alpha)) - Q(1, 1 << 30))


def test_circulant(spark):
    report, found = rank(generate(spark, Profile(1000, 40)))
    assert (report.status, report.iterations, report.residual_checks, report.true_residual_l1) == ("converged", 1, 1, 0.0)
    for bad in ({"alpha": 0.0}, {"alpha": 1.0}, {"eta": 0.0}, {"max_iterations": 0}, {"tau_mass": -1.0}, {"alpha": float("nan")}):
        with pytest.raises(ValueError):
            RankConfig(**bad)


def test_memory_of_the_driver(spark, monkeypatch):
    """Too little for the vectors: the tables are taken, and asking for vectors is a resource error."""
    from graphloom.errors import EXIT_RESOURCE, ResourceError
    from graphloom.plans import pagerank as module

    assert module.driver_memory() > 0
    graph = Graph.build(spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int"))
    monkeypatch.setattr(module, "driver_memory", lambda: 100)
    assert isinstance(module._engine(graph, "auto", 8192), module.Join)
    with pytest.raises(ResourceError) as e:
        run(graph, strategy="gather")
    assert e.value.code == EXIT_RESOURCE


def test_sums_of_many_values():
    """In order, three million equal values drift by more than the ten digits of a report."""
    from graphloom.plans.pagerank import _in_order

    for n in (3_000_000, 4_000_000):
        assert abs(_in_order(np.full(n, 1 / n)) - 1) < 1e-13
