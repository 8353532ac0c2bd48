import pytest

from graphloom.errors import ConfigError, DataError, PublicationError
from graphloom.plans import scratch
from graphloom.sources import rank_csv


def test_many_parts_in_order(spark, tmp_path):
    ranks = spark.range(-3000, 3000).selectExpr("cast(id as int) as vertex", "1 / (id + 4000.0D) as rank").repartition(13)
    path = tmp_path / "ranks.csv"
    rank_csv.write_rank_csv(ranks, str(path))
    lines = path.read_bytes().decode().split("\n")
    assert lines[0] == "vertex,rank" and lines[-1] == "" and len(lines) == 6002
    assert lines[1:-1] == [f"{v},{1 / (v + 4000.0):.17g}" for v in range(-3000, 3000)]
    assert [p.name for p in tmp_path.iterdir()] == ["ranks.csv"]
    with pytest.raises(PublicationError):
        rank_csv.write_rank_csv(ranks, str(path))


def test_lost_lines_are_not_published(spark, tmp_path, monkeypatch):
    whole = rank_csv.rank_csv_lines
    monkeypatch.setattr(rank_csv, "rank_csv_lines", lambda ranks: whole(ranks).where("line not like '5,%'"))
    with pytest.raises(PublicationError, match="9 of 10"):
        rank_csv.write_rank_csv(spark.range(10).selectExpr("cast(id as int) as vertex", "0.1D as rank"), str(tmp_path / "r.csv"))
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("rows", ["where id < 0", "union all select 1, 0.1D", "union all select 99, double('NaN')"])
def test_bad_ranks(spark, tmp_path, rows):
    ranks = spark.sql(f"select cast(id as int) as vertex, 0.1D as rank from range(10) {rows}")
    with pytest.raises(DataError):
        rank_csv.write_rank_csv(ranks, str(tmp_path / "r.csv"))
    assert not list(tmp_path.iterdir())


class _Session:
    """A session of a cluster, as far as shared_dir asks."""

    def __init__(self, master, session=None, context=None, called=None):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: session or default)})
        self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: {"spark.checkpoint.dir": context}, "getCheckpointDir": lambda _: called})()


def test_shared_folder():
    assert scratch.shared_dir(_Session("spark://host:7077", session="hdfs://a/")) == "hdfs://a"
    assert scratch.shared_dir(_Session("yarn", context="hdfs://b")) == "hdfs://b"
    assert scratch.shared_dir(_Session("yarn", called="hdfs://c/1")) == "hdfs://c/1"
    assert scratch.shared_dir(_Session("local[4]")).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,2,1024]"):
        with pytest.raises(ConfigError):
            scratch.shared_dir(_Session(master))
