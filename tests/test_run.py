import os

import pytest

from graphloom import cli
from graphloom.errors import ConfigError
from graphloom.sources.config import DEFAULTS, parse_config
from graphloom.streaming.edge_stream import ingest

HEAD = b"# a comment\n\nschema=engine-run-config-v1\n"


@pytest.fixture
def here(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in.csv").write_text("from,to\n1,2\n2,3\n3,1\n4,1\n")
    return tmp_path


def test_run(spark, here):
    assert cli.main(["in.csv", "out.csv"], spark) == 0
    assert (here / "out.csv").read_text() == "vertex,rank\n1,0.33260447025394224\n2,0.32021379971585084\n3,0.30968173003020694\n4,0.037500000000000006\n"
    assert sorted(os.listdir(here)) == ["in.csv", "out.csv"]


def test_exit_codes(spark, here, capsys):
    (here / "bad.csv").write_text("from,to\n1,2\n1,x\n")
    (here / "old.csv").write_text("")
    cases = [(["--help"], 0), (["one"], 2), (["in.csv", "old.csv"], 7), (["gone.csv", "old.csv"], 7), (["gone.csv", "new.csv"], 9), ([".", "new.csv"], 3), (["bad.csv", "new.csv"], 3)]
    for argv, code in cases:
        assert cli.main(argv, spark) == code, argv
    said = capsys.readouterr().err
    assert "main: data: invalid destination integer\n" in said and "main: publication:" in said
    (here / "config").mkdir()
    (here / "config/main.conf").write_bytes(HEAD + b"pagerank.max_iterations=3\n")
    assert cli.main(["in.csv", "new.csv"], spark) == 5
    (here / "config/main.conf").write_bytes(HEAD + b"pagerank.alpha=2.0\n")
    assert cli.main(["in.csv", "new.csv"], spark) == 2
    assert not (here / "new.csv").exists()


def test_config():
    assert parse_config(HEAD).values == DEFAULTS and len(DEFAULTS) == 35
    assert parse_config(HEAD + b"pagerank.eta=1e-7\npreprocess.edge_slice_size=4\n").tasks.edge_slice_size == 4
    for text in (b"pagerank.eta=+1\n", b"pagerank.eta=.5\n", b"pagerank.eta=1e-08\n", b"pagerank.eta=1e+5\n", b"pagerank.max_iterations=01\n", b"x=1\n", b"schema=a-run-config-v1\n", b"pagerank.eta=1\npagerank.eta=1\n", b"pagerank.eta = 1\n", b"pagerank.eta=\n", b"pagerank.eta=1", b"parallel.worker_count=0\n", b"\xc3\xa9\n"):
        with pytest.raises(ConfigError):
            parse_config(HEAD + text)
    with pytest.raises(ConfigError):
        parse_config(b"pagerank.eta=1\n")
    with pytest.raises(ConfigError):
        parse_config(b"")


def test_stream(spark, tmp_path):
    folder, table, marks = (str(tmp_path / x) for x in ("in", "table", "marks"))
    os.makedirs(folder)
    for k, text in enumerate(("from,to\n1,2\nx,y\n", "from,to\n3,4\n")):
        with open(f"{folder}/{k}.csv", "w") as f:
            f.write(text)
        ingest(spark, folder, table, marks).awaitTermination()
        assert spark.read.parquet(table).count() == k + 1
