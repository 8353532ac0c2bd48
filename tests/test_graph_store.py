import pytest

from graphloom.errors import DataError, PublicationError
from graphloom.operators.tasks import TaskLimits
from graphloom.plans.pagerank import Graph, run
from graphloom.sources.generator import generate
from graphloom.sources.graph_store import move_to, open_graph, publish_graph, read_manifest


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    graph = Graph.build(generate(spark, "reduced-skew"))
    publish_graph(graph, path, TaskLimits(4, 16, 8))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["graph"]
    assert read_manifest(spark, path)["edge_count"] == 404
    report, ranks = run(open_graph(spark, path))
    assert (report.iterations, report.residual_checks) == (92, 5)
    assert ranks.orderBy("vertex").collect() == run(graph)[1].orderBy("vertex").collect()
    with pytest.raises(PublicationError):
        publish_graph(graph, path)


def test_changed_table_with_right_counts(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    publish_graph(Graph.build(generate(spark, "reduced-skew")), path)
    degrees = spark.read.parquet(f"{path}/out_degree").collect()
    swapped = [(r["idx"], degrees[(i + 1) % len(degrees)]["degree"]) for i, r in enumerate(degrees)]
    spark.createDataFrame(swapped, "idx int, degree long").write.mode("overwrite").parquet(f"{path}/out_degree")
    with pytest.raises(DataError):
        open_graph(spark, path, check=False)


def test_move_never_replaces(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text(name)
    with pytest.raises(PublicationError):
        move_to(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    assert [p.name for p in (tmp_path / "b").iterdir()] == ["b"]
    move_to(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b", "c"]


def test_malformed(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    publish_graph(Graph.build(generate(spark, "reduced-skew")), path)
    spark.createDataFrame([(0, 99)], "idx int, degree long").write.mode("append").parquet(f"{path}/out_degree")
    with pytest.raises(DataError):
        open_graph(spark, path)
    spark.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(f"{path}/manifest")
    with pytest.raises(DataError):
        open_graph(spark, path)
