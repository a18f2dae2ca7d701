"""End to end: projection, filters, windows, watermarks, sub-queries and errors (FIXTURES.md A1, A2, A4, A5)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone import StreamFrame, Window, call, col, sql
from rillstone.errors import PlanError
from rillstone.operators.window import end_of, running_max, with_start

START = 1622512140000
LETTERS = ["a"] * 4 + ["b"] * 8 + ["c"] * 8 + ["d"] * 6


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(START + 60000 * i, i + 1, chr(97 + i), LETTERS[i]) for i in range(26)]
    return StreamFrame.source(spark.createDataFrame(rows, "time long, a long, b string, c string"), time=col("time"), seq="time", qualifier="t")


def ms(x: datetime) -> int:
    return round(x.timestamp() * 1000)


def utc(spark, frame):
    return frame.to_df().withColumn("@time", F.unix_millis("@time")).collect()


def test_source_adds_event_time(bars):
    rows = bars.to_df().select("time", F.unix_millis("@time")).collect()
    assert len(rows) == 26 and all(a == b for a, b in rows)


def test_projection_and_filter(bars):
    out = bars.select((col("a") + 88).alias("a")).to_df()
    assert out.columns == ["a"] and sorted(r[0] for r in out.collect()) == list(range(89, 115)) and out.dtypes == [("a", "bigint")]
    assert bars.filter((col("a") % 2).eq(0)).to_df().count() == 13


def test_aggregate(spark, bars):
    want = [("a", 10.0, 1622509200000), ("b", 56.0, 1622509200000), ("b", 12.0, 1622512800000), ("c", 132.0, 1622512800000), ("d", 141.0, 1622512800000)]
    out = bars.aggregate([col("c")], [col("c"), call("sum", col("a")).alias("a")], Window.fixed(3600_000))
    assert out.fields[-1].name == "@time" and out.to_df().dtypes[1] == ("a", "double")
    assert sorted(map(tuple, utc(spark, out))) == sorted(want)


@pytest.mark.parametrize(
    ("name", "xs", "want"),
    [
        ("avg", [1, 2, 3, 4, 5, 6], [1, 1.5, 2, 2.5, 3, 3.5]), ("sum", [1, 2, 3, 4, 5, 6], [1, 3, 6, 10, 15, 21]), ("max", [10, 5, 30, 7, 20, 35], [10, 10, 30, 30, 30, 35]),
        ("min", [10, 5, 30, 7, 3, 35], [10, 5, 5, 5, 3, 3]), ("first", [10, 5, 30, 7], [10] * 4), ("last", [10, 5, 30, 7], [10, 5, 30, 7]), ("count", [1, None, 3], [1, 1, 2]),
        ("sum", [None, 1.0], [0.0, 1.0]), ("first", [None, 4.0], [None, 4.0]),
    ],
)
def test_running(spark, name, xs, want):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i long, x double")
    rows = StreamFrame.source(df, seq="i").select(col("i"), call(name, col("x")).alias("v")).to_df().orderBy("i").collect()
    assert [r.v for r in rows] == want


@pytest.mark.parametrize(
    ("unit", "at", "start", "end"),
    [
        ("day", "2020-01-01 09:30:35", "2020-01-01", "2020-01-02"), ("week", "2020-07-01 12:30:45", "2020-06-29", "2020-07-06"),
        ("month", "2020-07-20 12:30:45", "2020-07-01", "2020-08-01"), ("year", "2020-07-20 12:30:45", "2020-01-01", "2021-01-01"),
    ],
)
def test_periods_in_a_zone(spark, unit, at, start, end):
    zone = "Asia/Shanghai"
    w = Window.period(unit, zone)
    df = spark.range(1).select(F.to_utc_timestamp(F.lit(at), zone).alias("t"))
    got = with_start(df, F.col("t"), w, "s").select(F.from_utc_timestamp("s", zone).cast("string"), F.from_utc_timestamp(end_of(F.col("s"), w), zone).cast("string")).first()
    assert got == (f"{start} 00:00:00", f"{end} 00:00:00")


def test_sliding_looks_forward(spark, bars):
    rows = utc(spark, sql("select a from t where a = 1 window sliding(30m, 10m)", {"t": bars}))
    first = START // 600_000 * 600_000
    assert sorted(r["@time"] for r in rows) == [first, first + 600_000, first + 1_200_000]


def test_late_rows_follow_the_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    rows = [(i, rnd.randrange(1_000_000), rnd.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, t long, k string")
    f = StreamFrame.source(df, time=col("t"), seq="i")
    for mark, delay in (("", 0), (" watermark by timestamp_sub(@time, 50 s)", 50_000)):
        got = {r.k: r.n for r in sql(f"select k, count(i) as n from s group by k window year{mark}", {"s": f}).to_df().collect()}
        want, wm = {}, None
        for _, t, k in rows:
            wm = max(wm if wm is not None else t - delay, t - delay)
            if t >= wm:
                want[k] = want.get(k, 0) + 1
        assert got == want


def test_running_max_matches_a_plain_scan(spark):
    rows = [(i * 7 % 1000, (i * 37) % 501) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, v long")
    got = {r.i: r.m for r in running_max(df, F.col("v"), "i", "m", buckets=16).collect()}
    top = -1
    for i, v in sorted(rows):
        top = max(top, v)
        assert got[i] == top


def test_subquery_having_alias(bars):
    text = "select h.c, max(s) as m from (select c, sum(a) as s from t group by c window fixed(10m)) as h where h.s > 5.0 group by c having m > 20.0 window day"
    sums = {}
    for i, c in enumerate(LETTERS):
        sums[c, (START + 60000 * i) // 600_000] = sums.get((c, (START + 60000 * i) // 600_000), 0) + i + 1
    best = {}
    for (c, _), v in sums.items():
        best[c] = max(v, best.get(c, 0))
    assert {r.c: r.m for r in sql(text, {"t": bars}).to_df().collect()} == {c: v for c, v in best.items() if v > 20}


def test_last_row_values_keep_nulls(spark):
    df = spark.createDataFrame([(1, "k", 5.0), (2, "k", None)], "i long, k string, x double")
    f = StreamFrame.source(df, time=col("i"), seq="i")
    row = sql("select x, k, last(x) as l, first(x) as f, sum(x) as s, avg(x) as a, count(x) as n, max(x) - min(x) as d from t window fixed(1s)", {"t": f}).to_df().first()
    assert (row.x, row.k, row.l, row.f, row.s, row.a, row.n, row.d) == (None, "k", 5.0, 5.0, 5.0, 5.0, 1, 0.0)


def test_null_keys_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "i long, k string")
    f = StreamFrame.source(df, time=col("i"), seq="i")
    assert {(r.k, r.n) for r in sql("select k, count(i) as n from t group by k window fixed(1s)", {"t": f}).to_df().collect()} == {(None, 2), ("a", 1)}


@pytest.mark.parametrize(
    "text",
    ["select a from t group by a", "select a, A from t", "select a, a + 1 as a from t", "select @time from t window day", "select a from t where a", "select z.a from t", "select a from nosuch", "select c, sum(a) as s from t group by c having sum(s) > 1.0 window day", "select x.* from t"],
)
def test_errors(bars, text):
    with pytest.raises(PlanError):
        sql(text, {"t": bars})


def test_filters_reach_the_scan(spark, data):
    f = StreamFrame.source(spark.read.parquet(f"{data}/events.parquet"), time=col("ts"), seq="event_id")
    df = sql("select event_id from e where value > 50.0 and event_type = 'click'", {"e": f}).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in plan and "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_ordered_streams_need_no_late_filter(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(50)], "t long, k string, x double")
    by_time = StreamFrame.source(df, time=col("t"), seq="t")
    query = "select K, sum(x) as s, max(x) as m from t group by k window fixed(10ms) watermark by timestamp_sub(@time, 5s)"
    plan = lambda f: sql(query, {"t": f}).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(by_time) and "SortAggregate" not in plan(by_time)
    slow = StreamFrame.source(df.withColumn("n", F.col("t")), time=col("t"), seq="n")
    assert "Window" in plan(slow)
    assert sorted(map(tuple, sql(query, {"t": by_time}).to_df().collect())) == sorted(map(tuple, sql(query, {"t": slow}).to_df().collect()))
    moved = by_time.select(col("k"), col("x"), call("timestamp_sub", col("@time"), col("t") * 2).alias("@time"))
    assert not moved._in_order and by_time.filter(col("x").gt(1.0)).select(col("k"), col("@time"))._in_order
