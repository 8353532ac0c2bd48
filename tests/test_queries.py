import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import oracles, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    found = duckdb.connect()
    for name in os.listdir(sf_dir):
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return found


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = duck.execute(oracles.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == wanted


def test_entry(spark, sf_dir):
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 360
    assert set(queries.QUERIES) == set(oracles.ORACLES)


def test_traced_graphs(spark, sf_dir):
    from graphloom.plans.pagerank import rank
    from graphloom.sources import tables

    for edges, k, c in ((tables.supply(spark, sf_dir), 35, 2), (tables.hops(spark, sf_dir), 7, 1), (tables.trade_ge(spark, sf_dir, 25), 24, 2)):
        report, _ = rank(edges)
        assert (report.status, report.iterations, report.residual_checks) == ("converged", k, c)


PARTS = 1_000_100


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    """Tables of 10 customers, 100 suppliers and PARTS parts: more vertices than the command takes."""
    found = str(tmp_path_factory.mktemp("many"))
    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{found}/orders.parquet")
    spark.range(PARTS).selectExpr("id % 10 AS l_orderkey", "id % 100 AS l_suppkey", "id AS l_partkey").write.parquet(f"{found}/lineitem.parquet")
    return found


def test_converged_above_the_limit_of_the_command(spark, many_parts):
    """Customers have ten suppliers each, suppliers one customer and a hundredth of the parts, so three ranks are known."""
    share = 0.85 * (1 + 0.085) / (PARTS // 100)
    base = 1 / (10 + 100 * 1.085 + PARTS * (1 + share))
    got = queries.QUERIES["pagerank_converged"](spark, many_parts).selectExpr("vertex div 1000000 AS kind", "rank").groupBy("kind").agg({"rank": "min", "*": "count"})
    least = {r["kind"]: (r["count(1)"], r["min(rank)"]) for r in got.collect()}
    assert {k: n for k, (n, _) in least.items()} == {0: 10, 1: 100, 2: 1_000_000, 3: 100}
    for kind, wanted in ((0, base), (1, base * 1.085), (2, base * (1 + share)), (3, base * (1 + share))):
        assert abs(least[kind][1] - wanted) <= 1e-10


def test_report_above_the_limit_of_the_command(spark, many_parts):
    """Masses are summed without the drift of a million equal values."""
    (r,) = queries.QUERIES["pagerank_report"](spark, many_parts).collect()
    assert (r["status"], r["vertex_count"], r["accepted"], r["within_eta"], r["max_mass_error"]) == ("converged", PARTS + 110, True, True, 0.0)
