"""Statements, catalog and continuous queries."""

import time

import pytest
from pyspark.sql import functions as F

from rillstone import StreamFrame, Window, col
from rillstone.errors import CatalogError, ParseError
from rillstone.service import Service
from rillstone.sources.sinks import Sink
from rillstone.sql import parser as P
from rillstone.streaming import runtime

START = 1622512140000
LETTERS = ["a"] * 4 + ["b"] * 8 + ["c"] * 8 + ["d"] * 6
LINES = [f"{START + 60000 * i},{i + 1},{chr(97 + i)},{LETTERS[i]}" for i in range(26)]
DECLARE = 'create source bars (time int64, a int64, b string, c string) with "csv://{}" time by time'


class Kept(Sink):
    def __init__(self):
        self.batches = {}

    def send(self, df, batch=0):
        self.batches[batch] = [tuple(r) for r in df.select(*[F.unix_millis(c).alias(c) if k == "timestamp" else F.col(f"`{c}`") for c, k in df.dtypes]).collect()]

    @property
    def rows(self):
        return [r for b in sorted(self.batches) for r in self.batches[b]]


def test_statement_texts():
    s = P.parse_statement('create source a (a int8, b int16, t timestamp, t2 timestamp timezone "UTC") with "csv:///test" time by t')
    assert [c[1] for c in s.columns] == ["int8", "int16", "timestamp", "timestamp"] and s.columns[3][2] == "UTC" and s.time.name == "t"
    s = P.parse_statement("create stream a with select a.a, a.b from abc as a to d")
    assert s.sink == "d" and s.query.source.alias == "a" and s.text == "select a.a, a.b from abc as a"
    s = P.parse_statement('create sink a with "http://test" format json;')
    assert (s.uri, s.format) == ("http://test", "json")
    assert P.parse_statement("DELETE SOURCE a") == P.Delete("source", "a") and P.parse_statement("show streams") == P.Show("stream")
    assert P.parse_statement("restart stream x") == P.Start("x", True) and P.parse_statement("stop stream x") == P.Stop("x")
    for text, window in (("fixed(5m)", Window.fixed(300_000)), ("sliding(5 minutes, 60 seconds)", Window.sliding(300_000, 60_000)), ("week", Window.period("week"))):
        q = P.parse_select(f"select a, b from t where a>10 group by b window {window and text} watermark by time")
        assert q.window == window and q.watermark.name == "time"
    s = P.parse_statement("create source a (s string) with 'csv:///x' time by parse_timestamp(s, '%H\"%M') ;")
    assert s.time_text == "parse_timestamp(s, '%H\"%M')"
    for bad in ("create table t", "select a", "select a from t window fixed(5)", "show tables", "select a from t limit 3", "delete a"):
        with pytest.raises(ParseError):
            P.parse_statement(bad)


def test_definitions(spark, tmp_path):
    s = Service(spark, str(tmp_path / "data"))
    p = tmp_path / "bars.csv"
    p.write_text("\n".join(LINES))
    assert s.execute(DECLARE.format(p)).first() == ("create source", True)
    with pytest.raises(CatalogError, match="already exists"):
        s.execute('create sink BARS with "console://"')
    s.execute('create sink out with "console://"')
    s.execute("create stream sums with select c, sum(a) as a from bars group by c window fixed(1h) to out")
    again = Service(spark, str(tmp_path / "data"))
    assert [tuple(r) for r in again.execute("show sources").collect()] == [("bars", f"csv://{p}")]
    assert [tuple(r) for r in again.execute("show streams").collect()] == [("sums", "out", "created")]
    assert again.execute("show sinks").count() == 1
    assert again.execute("select c, sum(a) as a from bars group by c window fixed(1h)").count() == 5
    rows, m = again.query("select a from bars where a > 20")
    assert len(rows) == 6 and (m.input_rows, m.output_rows) == (26, 6) and m.end >= m.start
    assert again.execute("delete stream sums").first() == ("delete stream", True)
    for text in ("delete stream sums", "start stream sums", "stop stream sums", "delete source out", "select a from gone"):
        with pytest.raises(CatalogError):
            again.execute(text)


def _wait(check, seconds=60):
    end = time.time() + seconds
    while not check():
        assert time.time() < end, "timed out"
        time.sleep(0.2)


def test_stream_start_stop_resume(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("\n".join(LINES[:10]))
    s = Service(spark, str(tmp_path / "data"))
    s.execute(DECLARE.format(folder))
    s.execute('create sink out with "console://"')
    s.execute("create stream evens with select a, b from bars where a % 2 = 0 to out")
    kept = s.sinks["evens"] = Kept()
    s.execute("start stream evens")
    assert s.execute("show streams").first().status == "started"
    with pytest.raises(CatalogError, match="is running"):
        s.execute("start stream evens")
    _wait(lambda: len(kept.rows) == 5)
    s.execute("stop stream evens")
    assert s.execute("show streams").first().status == "stop"
    (folder / "2.csv").write_text("\n".join(LINES[10:]))
    s.execute("start stream evens")
    _wait(lambda: len(kept.rows) == 13)
    s.execute("delete stream evens")
    assert not s.running and sorted(r[0] for r in kept.rows) == list(range(2, 27, 2))


def _source(spark, folder):
    def find(name, alias):
        df = spark.readStream.schema("time long, a long, b string, c string").option("maxFilesPerTrigger", 1).csv(str(folder))
        return StreamFrame.source(df, time=col("time"), seq="time", partition_by=["c"], qualifier=alias or name)

    return find


def test_windowed_stream_equals_the_bounded_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    query = P.parse_select("select c, sum(a) as a from bars group by c window fixed(1h)")
    kept, check = Kept(), str(tmp_path / "checkpoint")
    for i, lines in enumerate((LINES[:10], LINES[10:20], LINES[20:])):
        (folder / f"{i}.csv").write_text("\n".join(lines))
        q = runtime.start(query, _source(spark, folder), kept, check, f"w{i}", once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    first = {("a", 10.0, 1622509200000), ("b", 56.0, 1622509200000)}
    assert set(kept.rows) == first
    runtime.finish(query, _source(spark, folder), kept, check)
    assert set(kept.rows) == first | {("b", 12.0, 1622512800000), ("c", 132.0, 1622512800000), ("d", 141.0, 1622512800000)} and len(kept.rows) == 5


def test_running_functions_keep_state_between_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    query = P.parse_select("select a, sum(a) as s, f.ma(a, 3) as m, f.ema(a, 2) as e from bars")
    kept = Kept()
    for i, lines in enumerate((LINES[:6], LINES[6:])):
        (folder / f"{i}.csv").write_text("\n".join(lines))
        q = runtime.start(query, _source(spark, folder), kept, str(tmp_path / "checkpoint"), f"r{i}", once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r[0]: r[1:] for r in kept.rows}
    assert len(got) == 26
    total = {}
    for i, c in enumerate(LETTERS):
        total[c] = total.get(c, 0) + i + 1
        assert got[i + 1][0] == total[c]
    assert got[12][1] == 11.0 and got[6][1] is None and got[1][2] == 1.0


def test_native_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.csv").write_text("\n".join(LINES))
    df = spark.readStream.schema("time long, a long, b string, c string").csv(str(tmp_path / "in")).withColumn("t", F.timestamp_millis("time"))
    out = runtime.native_aggregate(df, "t", Window.fixed(3600_000), ["c"], [F.sum("a").alias("a")])
    q = out.writeStream.outputMode("append").format("memory").queryName("native").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.c, r.a) for r in spark.table("native").collect()} == {("a", 10), ("b", 56)}


def test_sources_without_a_time_use_the_clock(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("1\n2\n")
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source a (x int64) with "csv://{p}"')
    before = time.time()
    rows = s.execute("select x, @time as t from a").collect()
    assert len(rows) == 2 and all(before - 60 < r.t.timestamp() < time.time() + 60 for r in rows)


def test_prompt(spark, tmp_path):
    from rillstone.cli import run

    p = tmp_path / "bars.csv"
    p.write_text("\n".join(LINES))
    s, out = Service(spark, str(tmp_path / "data")), []
    run(s, DECLARE.format(p), out.append)
    run(s, "select a from bars where a > 24", out.append)
    run(s, "select nosuch from bars", out.append)
    run(s, "select", out.append)
    assert "create source" in out[0] and "│ 25 │" in out[1] and out[2].startswith("Input 26 rows, output 2 rows, done in ")
    assert out[3] == "error: not such column: nosuch" and out[4].startswith("error: expected")


def test_whole_stream_aggregates_go_on_from_one_row(spark, tmp_path):
    """Running aggregates, also nested ones, of a stream without keys: no state store, whose one group is one task; a batch goes on from
    the row that the one before left."""
    folder, kept, check = tmp_path / "in", Kept(), tmp_path / "checkpoint"
    folder.mkdir()
    find = lambda name, alias: StreamFrame.source(
        spark.readStream.schema("time long, a long, b string, c string").csv(str(folder)), time=col("time"), seq="a", qualifier=alias or name
    )
    text = "select a, count(b) as n, sum(a) as s, avg(a) as m, max(a) as hi, min(a) as lo, first(c) as f, last(a) as l, sum(avg(a)) as deep from bars where count(a) > 1"
    for i, lines in enumerate((LINES[:1], LINES[1:20], LINES[20:])):  # the first batch has one row: its order can't be cut
        (folder / f"{i}.csv").write_text("\n".join(lines))
        runtime.start(P.parse_select(text), find, kept, str(check), f"whole{i}", once=True).awaitTermination(120)
    assert not (check / "state").exists() and sorted(x.name for x in (check / "running").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    df = spark.read.schema("time long, a long, b string, c string").csv(str(folder))
    bounded = StreamFrame.source(df, time=col("time"), seq="a")
    want = runtime.plan(P.parse_select(text), lambda name, alias: bounded.renamed(alias or name)).to_df().collect()
    assert len(kept.rows) == len(want) == 25 and sorted(kept.rows) == sorted(want)
