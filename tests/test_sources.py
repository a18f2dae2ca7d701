"""Sources, sinks, display and inference."""

import pytest

from rillstone.display import table_text
from rillstone.errors import CatalogError
from rillstone.sources import readers, sinks
from rillstone.sources.readers import CsvOptions

COLUMNS = [("a", "int32"), ("b", "string"), ("t", "timestamp"), ("f", "float64"), ("ok", "boolean")]
ROWS = "1,x,111,1.5,true\n3,,333,2.5,false\n5,z,,,\n"


def test_csv_file(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(ROWS)
    df = readers.from_uri(spark, f"file://{p}", COLUMNS)
    assert [f.dataType.typeName() for f in df.schema] == ["integer", "string", "timestamp", "double", "boolean"]
    got = df.orderBy("a").collect()
    assert got[0].t.timestamp() == pytest.approx(0.111) and got[2].t is None and [r.a for r in got] == [1, 3, 5]


def test_csv_options_and_errors(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("a;b\n1;x\n")
    assert readers.from_uri(spark, f"csv://{p}?delimiter=59&has_header=true", COLUMNS[:2]).first() == (1, "x")
    p.write_text("no;x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        readers.from_uri(spark, f"csv://{p}?delimiter=59", COLUMNS[:2]).collect()
    with pytest.raises(CatalogError):
        readers.from_uri(spark, f"csv://{p}?nosuch=1", COLUMNS)
    for uri in ("ftp://x/y", "http://test"):
        with pytest.raises(CatalogError, match="unsupported source"):
            readers.from_uri(spark, uri, COLUMNS)


def test_csv_in_memory(spark):
    got = readers.parse_csv(spark, ROWS.encode(), COLUMNS).orderBy("_row").collect()
    assert [r.a for r in got] == [1, 3, 5] and got[1].ok is False
    assert readers.parse_csv(spark, "h,i\n1,2\n", [("a", "int8"), ("b", "int64")], CsvOptions(has_header=True)).count() == 1


def test_inference():
    text = '1,a,1.5,true,"1",2\n2,b,3,false,"x",z\n'
    assert readers.infer_csv(text) == [("c1", "int64"), ("c2", "string"), ("c3", "float64"), ("c4", "boolean"), ("c5", "string"), ("c6", "string")]
    assert readers.infer_csv("n,m\n-1,true\n2,3\n", CsvOptions(has_header=True)) == [("n", "int64"), ("m", "string")]


def test_json_messages(spark):
    df = spark.createDataFrame([('[{"a": 1, "b": "x"}, {"a": 2}]', 7), ("[]", 8)], "value string, _offset long")
    got = readers.read_json_messages(df, [("a", "int64"), ("b", "string"), ("t", "timestamp")], keep=("_offset",)).collect()
    assert [tuple(r) for r in got] == [(7, 1, "x", None), (7, 2, None, None)]
    bad = spark.createDataFrame([('[{"a": "no"}]',)], "value string")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_json_messages(bad, [("a", "int64")]).collect()


def test_parquet_round_trip(spark, tmp_path):
    df = readers.read_rows(spark, [(1, "a"), (3, "b")], [("a", "int32"), ("b", "string")])
    sinks.from_uri(spark, f"parquet://{tmp_path}/out").send(df, 0)
    sinks.from_uri(spark, f"parquet://{tmp_path}/out").send(df, 0)
    back = readers.from_uri(spark, f"parquet://{tmp_path}/out", [("a", "int64"), ("b", "string")])
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (3, "b")]


def test_console_and_display(spark):
    out = []
    sinks.Console(write=out.append).send(spark.createDataFrame([(1, "ab", None)], "x int, name string, n string"))
    assert out[0].splitlines()[1:4] == ["│ x ┆ name ┆ n    │", "╞═══╪══════╪══════╡", "│ 1 ┆ ab   ┆ null │"]
    assert table_text(spark.range(0)) == "No data!"
    assert "00:00:00.001 UTC" in table_text(spark.range(1).selectExpr("timestamp_millis(1) as t"))
    with pytest.raises(CatalogError, match="unsupported sink"):
        sinks.from_uri(spark, "http://test")
