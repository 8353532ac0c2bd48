import pytest

from graphloom.errors import DataError, EdgeCsvError
from graphloom.sources.edge_csv import InputGuard, read_edge_csv

BAD = [
    (b"\xef\xbb\xbffrom,to\n1,2\n", 1, "UTF-8 BOM is not allowed"),
    (b"from, to\n1,2\n", 1, "expected exact header from,to"),
    (b"from,tox\n1,2\n", 1, "unexpected byte after exact header from,to"),
    (b"from,to\r1,2\n3,4", 1, "carriage return must be followed by line feed"),
    (b"from,to\n\n1,2\n", 2, "blank data line is not allowed"),
    (b"from,to\n01,2\n3,4\n", 2, "integer must use canonical decimal form"),
    (b"from,to\n-0,1\n", 2, "integer must use canonical decimal form"),
    (b"from,to\n+1,2\n", 2, "invalid source integer"),
    (b"from,to\n-,2\n1,2\n", 2, "minus sign must be followed by a digit"),
    (b"from,to\n,2\n1,2\n", 2, "missing source integer"),
    (b'from,to\n"1",2\n', 2, "quoted fields are not allowed"),
    (b'from,to\n1,"2"\n', 2, "quoted fields are not allowed"),
    (b"from,to\n2147483648,1\n", 2, "integer is outside signed int32 range"),
    (b"from,to\n1,-2147483649\n", 2, "integer is outside signed int32 range"),
    (b"from,to\n1\n1,2\n", 2, "missing destination field"),
    (b"from,to\n1,2\n1,\n1,2\n", 3, "missing destination integer"),
    (b"from,to\n1,2,3\n", 2, "extra CSV field"),
    (b"from,to\n1,,3\n", 2, "extra CSV field"),
    (b"from,to\n1,x\n1,2\n", 2, "invalid destination integer"),
    (b"from,to\n1,-x\n1,2\n", 2, "minus sign must be followed by a digit"),
    (b"from,to\n1 2,3\n", 2, "trailing junk in source field"),
    (b"from,to\n1,2 3\n", 2, "trailing junk in destination field"),
    (b"from,to\n1,2\r3,4\n", 2, "carriage return must be followed by line feed"),
    (b"from,to\n1,2\n3,4\r", 3, "carriage return must be followed by line feed"),
    (b"from,to\n1,2\nfrom,to\n", 3, "invalid source integer"),
    (b"from,to\r\n   \n", 2, "blank data line is not allowed"),
]
GOOD = [
    (b"from,to\n \t1 , 2\t\n", [(1, 2)]),
    (b"from,to\r\n1,2\n3,4\r\n", [(1, 2), (3, 4)]),
    (b"from,to\n1,2", [(1, 2)]),
    (b"from,to\n-2147483648,2147483647\n0,0\n", [(-2147483648, 2147483647), (0, 0)]),
]


@pytest.mark.parametrize("data,line,message", BAD)
def test_malformed(spark, tmp_path, data, line, message):
    path = tmp_path / "e.csv"
    path.write_bytes(data)
    with pytest.raises(EdgeCsvError) as e:
        read_edge_csv(spark, f"file://{path}")
    assert (e.value.line, str(e.value)) == (line, message)


@pytest.mark.parametrize("data,edges", GOOD)
def test_accepted(spark, tmp_path, data, edges):
    path = tmp_path / "e.csv"
    path.write_bytes(data)
    assert sorted(map(tuple, read_edge_csv(spark, f"file://{path}").collect())) == sorted(edges)


def test_first_bad_line_of_many(spark, tmp_path):
    path = tmp_path / "e.csv"
    rows = [f"{i},{i + 1}" for i in range(50_000)]
    rows[40_000], rows[30_001] = "x,1", "1,2,3"
    path.write_text("from,to\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        with pytest.raises(EdgeCsvError) as e:
            read_edge_csv(spark, f"file://{path}")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (e.value.line, str(e.value)) == (30_003, "extra CSV field")


def test_too_short_and_guard(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_bytes(b"from,to\n")
    with pytest.raises(DataError):
        read_edge_csv(spark, f"file://{path}")
    guard = InputGuard(str(path))
    guard.verify()
    path.write_bytes(b"from,to\n1,2\n")
    with pytest.raises(DataError):
        guard.verify()
    link = tmp_path / "l.csv"
    link.symlink_to(path)
    with pytest.raises(DataError):
        InputGuard(str(link))
