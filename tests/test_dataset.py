import json

import pytest

from graphloom.errors import DataError, PublicationError
from graphloom.plans.overlap import measure_overlap
from graphloom.plans.pagerank import Graph
from graphloom.sources.dataset import verify_dataset, write_dataset
from graphloom.sources.edge_csv import read_edge_csv
from graphloom.sources.graph_store import publish_graph
from graphloom.sources.rank_csv import write_rank_csv


def test_written_and_verified(spark, tmp_path):
    folder = tmp_path / "data"
    manifest = write_dataset(spark, "reduced-skew", str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["edges.csv", "manifest.json"] and len(list(tmp_path.iterdir())) == 1
    assert (folder / "edges.csv").read_bytes().startswith(b"from,to\n0,1\n0,2\n0,3\n1,2\n")
    assert manifest["statistics"]["most_out"] == 25 and manifest["statistics"]["most_in"] == 25
    assert manifest["statistics"]["out_degrees"] == [{"degree": 3, "vertices": 21}, {"degree": 4, "vertices": 79}, {"degree": 25, "vertices": 1}]
    assert manifest["statistics"]["in_slices"] == [{"slices": 1, "vertices": 98}, {"slices": 3, "vertices": 2}, {"slices": 7, "vertices": 1}]
    assert verify_dataset(spark, str(folder)) == json.loads((folder / "manifest.json").read_text())
    assert read_edge_csv(spark, f"file://{folder}/edges.csv").count() == 404
    with pytest.raises(PublicationError) as e:
        write_dataset(spark, "reduced-skew", str(folder))
    assert e.value.state == "target_exists"


def test_changed_dataset(spark, tmp_path):
    folder = tmp_path / "data"
    write_dataset(spark, "reduced-skew", str(folder))
    edges, manifest = (folder / "edges.csv").read_bytes(), (folder / "manifest.json").read_text()
    (folder / "edges.csv").write_bytes(edges.replace(b"0,1\n", b"0,9\n", 1))
    with pytest.raises(DataError, match="differ"):
        verify_dataset(spark, str(folder))
    (folder / "edges.csv").write_bytes(edges)
    for text in (manifest.replace('"most_in":25', '"most_in":26'), manifest.replace(",", ", "), "{}\n", "x"):
        (folder / "manifest.json").write_text(text)
        with pytest.raises(DataError):
            verify_dataset(spark, str(folder))


def test_output_outside_the_graph(spark, tmp_path):
    graph = tmp_path / "graph"
    publish_graph(Graph.build(spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")), f"file://{graph}")
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.5)], "vertex int, rank double")
    (tmp_path / "link").symlink_to(graph / "tasks")
    for inside in (graph / "r.csv", graph / "tasks" / "r.csv"):
        with pytest.raises(PublicationError, match="inside"):
            write_rank_csv(ranks, str(inside), f"file://{graph}")
    with pytest.raises(PublicationError):
        write_rank_csv(ranks, str(tmp_path / "link" / "r.csv"), str(graph))
    write_rank_csv(ranks, str(tmp_path / "r.csv"), str(graph))
    assert (tmp_path / "r.csv").read_text() == "vertex,rank\n1,0.5\n2,0.5\n"


def test_overlap(spark):
    with measure_overlap(spark) as found:
        spark.range(0, 20_000_000, 1, 4).selectExpr("sum(hash(id))").collect()
    assert found.stages >= 1 and found.tasks >= 4 and found.cpu_s > 0 and found.run_s > 0 and found.wall_s > 0 and found.overlap > 0
