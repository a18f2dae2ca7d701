"""Registered queries on files and streams against DuckDB, and orders that can't be told from partitions."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rillstone import StreamFrame, call, col, queries, sql
from rillstone import stream_queries  # noqa: F401
from rillstone.errors import PlanError
from rillstone.plans.prefix import bucketed
from rillstone.service import Service
from rillstone.sources import order, readers
from rillstone.streaming import runtime


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", ["csv_folder_running_count", "json_folder_running_count", "stream_parquet_running_sum", "stream_fixed_sum", "stream_window_series", "stream_native_window", "literals"])
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    cur = duck.execute(queries.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names and got == sorted((tuple(r[have.index(c)] for c in names) for r in cur.fetchall()), key=str)


def _files(tmp_path, sizes=(40, 300, 7)):
    """CSV files whose sizes don't follow their order, with explicit modification times."""
    at = 0
    for i, n in enumerate(sizes):
        p = tmp_path / f"{'cab'[i]}.csv"
        p.write_text("\n".join(f"{k},{'x' * (k % 90)}" for k in range(at, at + n)))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
        at += n
    return at


def test_files_arrive_by_time_and_place(spark, tmp_path):
    n = _files(tmp_path)
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source f (a int64, b string) with "csv://{tmp_path}/*.csv"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", before):  # files cut into splits, and whole
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = s.execute("select a, count(a) as n, f.ref(a, 1) as p from f").collect()
            assert len(rows) == n and all(r.n == r.a + 1 and r.p == (r.a - 1 if r.a else None) for r in rows)
            df = readers.from_uri(spark, f"csv://{tmp_path}/*.csv", [("a", "int64"), ("b", "string")], place=True)
            sizes = [r["count"] for r in bucketed(df, order.PLACE, 8).groupBy("__bucket").count().collect()]
            assert 7 <= len(sizes) <= 9 or size == "1000" and len(sizes) > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streams_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    n = _files(tmp_path / "in")
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source f (a int64, b string) with "csv://{tmp_path}/in?batch_size=3000000" time by a')
    s.execute(f'create sink out with "parquet://{tmp_path}/out"')
    s.execute("create stream q with select a, count(a) as n from f to out")
    s.execute("start stream q once")
    rows = spark.read.parquet(f"{tmp_path}/out/batch=*").collect()
    assert len(rows) == n and all(r.n == r.a + 1 for r in rows)
    s.execute(f'create sink windows with "parquet://{tmp_path}/windows"')
    s.execute("create stream w with select count(a) as n from f window fixed(10ms) to windows")
    s.execute("start stream w once")
    assert s.execute("show streams").where("name = 'w'").first().status == "finish"
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/windows/batch=*").collect()) == n  # no row counts as late


def test_an_order_column_wins(spark, tmp_path):
    (tmp_path / "o.csv").write_text("3,c\n1,a\n2,b\n")
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source f (i int64, x string) with "csv://{tmp_path}/o.csv" order by i')
    assert {r.i: r.n for r in s.execute("select i, count(x) as n from f").collect()} == {1: 1, 2: 2, 3: 3}


def test_streams_without_order_refuse_state(spark):
    rate = StreamFrame.source(spark.readStream.format("rate").load())
    for use in (lambda: rate.select(call("count", col("value")).alias("n")), lambda: rate.filter(call("count", col("value")).gt(1))):
        with pytest.raises(PlanError, match="arrival order"):
            use()
    rate.select(col("value"))


def test_state_is_a_row_for_each_open_group(spark, tmp_path):
    rows = [(i, i % 3, float(i)) for i in range(900)]
    spark.createDataFrame(rows, "t long, k long, x double").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source f (t int64, k int64, x float64) with "parquet://{tmp_path}/in" time by t')
    s.execute(f'create sink out with "parquet://{tmp_path}/out"')
    s.execute("create stream q with select k, sum(x) as s, first(x) as a from f group by k window day to out")
    s.execute("start stream q once")
    held = spark.read.parquet(f"{s.catalog.checkpoint('q')}/windows/batch=0/groups/open")
    assert held.count() == 3
    got = {r.k: (r.s, r.a) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()}
    assert got == {k: (sum(x for _, j, x in rows if j == k), float(k)) for k in range(3)}


def test_nan_keys_are_one_series(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else 1.0, float(i)) for i in range(8)], "i long, k double, x double")
    rows = sql("select i, f.ema(x, 1) as e, f.filter(x > 0.0, 2) as f from t", {"t": StreamFrame.source(df, seq="i", partition_by=["k"])}).to_df().where(F.isnan("e") == False).orderBy("i").collect()  # noqa: E712
    assert [r.f for r in rows if r.i % 2] == [True, False, False, True]


def test_places_of_streams_are_no_texts(spark, tmp_path):
    """building a text of each row's place took most of a batch; batches number rows once, and only the state store needs texts."""
    (tmp_path / "in").mkdir()
    n = _files(tmp_path / "in")
    s = Service(spark, str(tmp_path / "data"))
    s.execute(f'create source f (a int64, b string) with "csv://{tmp_path}/in?batch_size=3000000" time by a')
    assert order.is_place(s.source("f", streaming=True)._df.schema["__seq"].dataType)
    s.execute(f'create sink out with "parquet://{tmp_path}/out"')
    s.execute("create stream q with select a, count(a) as n from f where a % 2 = 0 and a >= 40 to out")  # the first file has no row that stays
    s.execute(f'create sink old with "parquet://{tmp_path}/old"')
    s.execute("create stream r with select a, f.ref(a, 1) as p from f to old")  # by the state store
    for name in "qr":
        s.execute(f"start stream {name} once")
    assert sorted((r.a, r.n) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()) == [(a, i + 1) for i, a in enumerate(range(40, n, 2))]
    assert sorted((r.a, r.p) for r in spark.read.schema("a long, p long").parquet(f"{tmp_path}/old/batch=*").collect()) == [(a, a - 1 if a else None) for a in range(n)]
    batch = spark.range(100, 160).select(F.struct(F.lit(0).cast("timestamp").alias("time"), F.lit("p").alias("path"), F.col("id").alias("row")).alias("__seq"))
    made, span = runtime.numbered(batch, 2, False)
    assert span == made.agg(F.min("__seq"), F.max("__seq")).first() == (2 << 44, (2 << 44) + 59)


#: Microseconds around the borders of ten minutes: DuckDB's epoch_ms, by which the SQL cuts windows, gives the nearest millisecond.
OFFSETS = (-501, -500, -400, 0, 499, 500, 1)


@pytest.fixture(scope="module")
def borders(tmp_path_factory, data):
    path = tmp_path_factory.mktemp("borders")
    at = f"timestamp '2024-01-01' + to_microseconds((event_id * 600000000 + {list(OFFSETS)}[1 + event_id % {len(OFFSETS)}])::bigint)"
    duckdb.sql(f"copy (select event_id, {at} as ts, user_id, event_type, value, props from '{data}/events.parquet' where event_id between 1 and 90) to '{path}/events.parquet' (format parquet)")
    return str(path)


def _like_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cur = con.execute(queries.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(map(str, df.select(*have).collect())) == sorted(str(Row(**dict(zip(have, r, strict=True)))) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["window_sliding_count", "window_sliding_last", "window_sliding_uneven", "window_sliding_avg", "window_sliding_first", "window_sliding_sum", "stream_fixed_sum"])
def test_windows_go_by_the_nearest_millisecond(spark, borders, name):
    _like_sql(spark, borders, name)
