"""Registered queries over the driver's tables, most of them in this package's SQL dialect, and DuckDB SQL for each.

Doubles are rounded to six places on both sides and times leave as zone-less timestamps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import expr as E
from .operators.frame import StreamFrame
from .operators.window import Window
from .sql.parser import parse_expr
from .sql.planner import sql

#: Added before rounding on both sides: values with a 5 at the seventh place would else be rounded either way.
TIE = 1e-9
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: (time expression, arrival order, series keys) of each table used as a stream.
STREAMS = {
    "events": ("ts", "event_id", ["user_id"]),
    "orders": ("o_orderdate", "o_orderkey", ["o_custkey"]),
    "lineitem": ("l_shipdate", "l_orderkey", ["l_suppkey"]),
    "part": (None, "p_partkey", []),
    "customer": (None, "c_custkey", []),
}


def stream(spark, sf_dir: str, name: str, seq: str | None = None, keys: list[str] | None = None, add: dict | None = None, in_order: bool = False) -> StreamFrame:
    time, own_seq, own_keys = STREAMS[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if add:
        df = df.withColumns({k: F.expr(v) for k, v in add.items()})
    return StreamFrame.source(df, time=parse_expr(time) if time else None, seq=seq or own_seq, partition_by=own_keys if keys is None else keys, qualifier=name, in_order=in_order)


def finished(df: DataFrame) -> DataFrame:
    """Rounded doubles and zone-less times."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double") + TIE, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias("window_start" if f.name == "@time" else f.name))
    return df.select(*out)


def add(name: str, text: str, oracle: str, table: str = "events", **source) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return finished(sql(text, {table: stream(spark, sf_dir, table, **source)}).to_df())

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle


def r(x: str) -> str:
    return f"round({x} + {TIE}, 6)"


# -- windows and aggregates ------------------------------------------------------------------------------------------

def bucket(ts: str, ms: int) -> str:
    return f"make_timestamp(epoch_ms({ts}) // {ms} * {ms} * 1000)"


HOUR, DAY = 3_600_000, 86_400_000
AGGREGATES = {
    "avg": r("avg(value)"),
    "sum": r("sum(value)"),
    "count": "count(value)",
    "max": r("max(value)"),
    "min": r("min(value)"),
    "first": r("arg_min(value, event_id)"),
    "last": r("arg_max(value, event_id)"),
}
add(
    "fixed_window_sum",
    "select event_type, sum(value) as total from events group by event_type window fixed(60 minutes)",
    f"select event_type, {r('sum(value)')} as total, {bucket('ts', HOUR)} as window_start from events group by event_type, {bucket('ts', HOUR)}",
)
for _f, _o in AGGREGATES.items():
    add(f"window_fixed_{_f}", f"select event_type, {_f}(value) as v from events group by event_type window fixed(6h)", f"select event_type, {_o} as v, {bucket('ts', 6 * HOUR)} as window_start from events group by event_type, {bucket('ts', 6 * HOUR)}")
    add(
        f"window_sliding_{_f}",
        f"select event_type, {_f}(value) as v from events group by event_type window sliding(30m, 10m)",
        f"select event_type, {_o} as v, make_timestamp((epoch_ms(ts) // 600000 + k) * 600000000) as window_start from events, (select unnest(range(3)) as k) group by event_type, make_timestamp((epoch_ms(ts) // 600000 + k) * 600000000)",
    )
for _p in ("day", "week", "month", "year"):
    add(f"window_{_p}", f"select event_type, sum(value) as total, count(value) as n from events group by event_type window {_p}", f"select event_type, {r('sum(value)')} as total, count(value) as n, date_trunc('{_p}', ts)::timestamp as window_start from events group by event_type, date_trunc('{_p}', ts)")
add(
    "window_day_zone",
    "select event_type, count(value) as n from events group by event_type window day('Asia/Shanghai')",
    "select event_type, count(value) as n, date_trunc('day', ts + interval 8 hours)::timestamp - interval 8 hours as window_start from events group by event_type, date_trunc('day', ts + interval 8 hours)",
)
add(
    "window_sliding_uneven",
    "select event_type, count(value) as n from events group by event_type window sliding(25m, 10m)",
    "select event_type, count(value) as n, make_timestamp((epoch_ms(ts) // 600000 + k) * 600000000) as window_start from events, (select unnest(range(3)) as k) group by event_type, make_timestamp((epoch_ms(ts) // 600000 + k) * 600000000)",
)
add("window_orders_month", "select o_orderstatus, sum(o_totalprice) as total, count(o_orderkey) as n from orders group by o_orderstatus window month", f"select o_orderstatus, {r('sum(o_totalprice)')} as total, count(*) as n, date_trunc('month', o_orderdate)::timestamp as window_start from kept group by o_orderstatus, date_trunc('month', o_orderdate)", "orders", seq="arrival", add={"arrival": "unix_micros(cast(o_orderdate as timestamp))"}, in_order=True)
ORACLES["window_orders_month"] = ORACLES["window_orders_month"].replace("from kept", "from orders")
add("window_lineitem_year", "select l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_quantity) as quantity from lineitem group by l_returnflag, l_linestatus window year", f"select l_returnflag, l_linestatus, {r('sum(l_extendedprice * (1 - l_discount))')} as revenue, {r('avg(l_quantity)')} as quantity, date_trunc('year', l_shipdate)::timestamp as window_start from lineitem group by l_returnflag, l_linestatus, date_trunc('year', l_shipdate)", "lineitem", seq="arrival", add={"arrival": "unix_micros(cast(l_shipdate as timestamp))"}, in_order=True)
add("window_no_keys", "select sum(value) as total, max(event_id) as top from events window fixed(1d)", f"select {r('sum(value)')} as total, max(event_id) as top, {bucket('ts', DAY)} as window_start from events group by {bucket('ts', DAY)}")
add("window_last_row", "select event_type, user_id, value * 2 as twice, props from events group by event_type window day", f"select event_type, arg_max_null(user_id, event_id) as user_id, {r('arg_max_null(value, event_id) * 2')} as twice, arg_max_null(props, event_id) as props, date_trunc('day', ts)::timestamp as window_start from events group by event_type, date_trunc('day', ts)")
add("window_composed", "select event_type, sum(value) / count(value) + 1 as v, max(value) - min(value) as spread from events group by event_type window day", f"select event_type, {r('sum(value) / count(value) + 1')} as v, {r('max(value) - min(value)')} as spread, date_trunc('day', ts)::timestamp as window_start from events group by event_type, date_trunc('day', ts)")
add(
    "window_series",
    "select event_type, f.ma(value, 3) as m, sum(f.ref(value, 1)) as s from events group by event_type window day",
    f"select event_type, round(arg_max_null(m, event_id), 6) as m, {r('coalesce(sum(p), 0)')} as s, d::timestamp as window_start from (select *, case when count(*) over w3 = 3 then avg(value) over w3 end as m, lag(value) over w as p from (select *, date_trunc('day', ts) as d from events) window w as (partition by event_type, d order by event_id), w3 as (partition by event_type, d order by event_id rows 2 preceding)) group by event_type, d",
)
add("having", "select event_type, sum(value) as total from events group by event_type having total > 5000.0 window day", f"select event_type, {r('sum(value)')} as total, date_trunc('day', ts)::timestamp as window_start from events group by event_type, date_trunc('day', ts) having sum(value) > 5000.0")
add(
    "subquery_chain",
    "select event_type, max(total) as best from (select event_type, sum(value) as total from events group by event_type window fixed(1h)) as hourly group by event_type window day",
    f"select event_type, {r('max(total)')} as best, date_trunc('day', h)::timestamp as window_start from (select event_type, sum(value) as total, {bucket('ts', HOUR)} as h from events group by event_type, {bucket('ts', HOUR)}) group by event_type, date_trunc('day', h)",
)
LATE = "(select *, max(ts{minus}) over (order by user_id, event_id rows unbounded preceding) as wm from events)"
ARRIVAL = {"seq": "arrival", "add": {"arrival": "user_id * 1000000000 + event_id"}}
add("late_rows_default", "select event_type, count(value) as n, sum(value) as total from events group by event_type window day", f"select event_type, count(value) as n, {r('sum(value)')} as total, date_trunc('day', ts)::timestamp as window_start from {LATE.format(minus='')} where ts >= wm group by event_type, date_trunc('day', ts)", **ARRIVAL)
add("late_rows_delay", "select event_type, count(value) as n from events group by event_type window day watermark by timestamp_sub(ts, 10 days)", f"select event_type, count(value) as n, date_trunc('day', ts)::timestamp as window_start from {LATE.format(minus=' - interval 10 days')} where ts >= wm group by event_type, date_trunc('day', ts)", **ARRIVAL)

# -- projection, filters, operators ----------------------------------------------------------------------------------

add("projection", "select l_orderkey, l_linenumber, l_quantity * l_extendedprice as gross, l_orderkey + 1 as next, l_orderkey - l_partkey as gap, l_linenumber * 3 as triple from lineitem", f"select l_orderkey, l_linenumber, {r('l_quantity * l_extendedprice')} as gross, l_orderkey + 1 as next, l_orderkey - l_partkey as gap, l_linenumber::bigint * 3 as triple from lineitem", "lineitem")
add("integer_division", "select p_partkey, p_size / 7 as a, (0 - p_size) / 7 as b, p_size % 7 as c, (0 - p_size) % 7 as d from part", "select p_partkey, p_size::bigint // 7 as a, -(p_size::bigint // 7) as b, p_size::bigint % 7 as c, (-p_size::bigint) % 7 as d from part", "part")
add("float_division", "select event_id, value / 3 as a, value / (value - value) as b, -value as c from events where value > 0.0", f"select event_id, {r('value / 3')} as a, 'infinity'::double as b, {r('-value')} as c from events where value > 0")
add("comparison", "select event_id, value < 50 as lt, value <= 50 as le, value > 50 as gt, value >= 50 as ge, event_type = 'click' as eq, event_type <> 'click' as ne, event_type < 'p' as before from events", "select event_id, value < 50 as lt, value <= 50 as le, value > 50 as gt, value >= 50 as ge, event_type = 'click' as eq, event_type <> 'click' as ne, event_type < 'p' as before from events")
add(
    "strict_logic",
    "select event_id, a and b as both, a or b as either, not a as neither from events",
    "select event_id, case when a is not null and b is not null then a and b end as both, case when a is not null and b is not null then a or b end as either, not a as neither from (select *, nullif(event_type, 'click') = 'view' as a, nullif(user_id, 3) > 70 as b from events)",
    add={"a": "nullif(event_type, 'click') = 'view'", "b": "nullif(user_id, 3) > 70"},
)
add("filter", "select event_id, value from events where value > 50.0 and event_type = 'click' or user_id % 10 = 3", f"select event_id, {r('value')} as value from events where value > 50 and event_type = 'click' or user_id % 10 = 3")
add("filter_null_flag", "select event_id from events where a and not b", "select event_id from (select *, nullif(event_type, 'click') = 'view' as a, nullif(user_id, 3) > 70 as b from events) where a and not b", add={"a": "nullif(event_type, 'click') = 'view'", "b": "nullif(user_id, 3) > 70"})
add("filter_stateful", "select event_id, value from events where f.ma(value, 3) > 60.0", f"select event_id, {r('value')} as value from (select *, case when count(*) over w = 3 then avg(value) over w end as m from events window w as (partition by user_id order by event_id rows 2 preceding)) where m > 60")
add("wildcard", "select e.* from (select event_id, ts, value from events) as e", f"select event_id, ts, {r('value')} as value from events")
add("qualified", "select e.event_id, e.value as v from events as e where e.user_id = 7", f"select event_id, {r('value')} as v from events where user_id = 7")
add("negation", "select p_partkey, -p_size as a, -(p_size + 1) as b, -1 + 2 as c from part", "select p_partkey, -p_size as a, -(p_size::bigint + 1) as b, 1::bigint as c from part", "part")
add("literals", "select p_partkey, 1 as a, 300 as b, 70000 as c, 5000000000 as d, 1.5 as e, true as f, 'it''s' as g, 5m as h from part", "select p_partkey, 1::tinyint as a, 300::smallint as b, 70000::integer as c, 5000000000::bigint as d, 1.5::double as e, true as f, 'it''s' as g, 300000::integer as h from part", "part")

# -- scalar functions ------------------------------------------------------------------------------------------------

UNIT = "value / 1000"
for _f, _x, _o in [
    ("sqrt", "value", "sqrt(value)"), ("sin", "value", "sin(value)"), ("cos", "value", "cos(value)"), ("tan", UNIT, f"tan({UNIT})"),
    ("asin", UNIT, f"asin({UNIT})"), ("acos", UNIT, f"acos({UNIT})"), ("atan", "value", "atan(value)"), ("floor", "value - 50", "floor(value - 50)"),
    ("ceil", "value - 50", "ceil(value - 50)"), ("round", "value - 50", "round(value - 50)"), ("trunc", "value - 50", "trunc(value - 50)"), ("abs", "value - 50", "abs(value - 50)"),
    ("signum", "user_id - 50", "case when user_id = 50 then 1.0::double else sign(user_id - 50)::double end"), ("exp", UNIT, f"exp({UNIT})"), ("ln", "value + 1", "ln(value + 1)"), ("log2", "value + 1", "log2(value + 1)"), ("log10", "value + 1", "log10(value + 1)"),
]:
    _where = " where value <= 900.0" if _f in ("asin", "acos") else ""
    add(f"fn_{_f}", f"select event_id, {_f}({_x}) as v from events{_where}", f"select event_id, {r(_o)} as v from events{_where}")
add("fn_log_domain", "select c_custkey, ln(c_acctbal - c_acctbal) as a, c_custkey as k from customer", "select c_custkey, '-infinity'::double as a, c_custkey as k from customer", "customer")
P = ("part", "p_partkey")
for _name, _text, _o in [
    ("chr", "chr(p_size + 64) as v, chr(22909) as w, chr(0 - 1) as x", "chr(p_size + 64) as v, '好' as w, null::varchar as x"),
    ("concat", "concat(p_brand, n, p_size) as v", "concat(p_brand, n, p_size) as v"),
    ("concat_ws", "concat_ws('-', p_brand, n, p_type) as v, concat_ws('-', n, n) as w", "concat_ws('-', p_brand, n, p_type) as v, n || '-' || n as w"),
    ("encode", "encode(p_name, 'utf8', 'hex') as v, encode(encode(p_name, 'utf8', 'base64'), 'base64', 'utf8') as w", "lower(hex(p_name)) as v, p_name as w"),
    ("instr", "instr(p_name, '1') as v, instr(p_name, '1', 6) as w, instr(p_name, 'a', -1) as x", "nullif(instr(p_name, '1'), 0) - 1 as v, nullif(instr(substr(p_name, 7), '1'), 0) + 5 as w, length(p_name) - nullif(instr(reverse(p_name), 'a'), 0) as x"),
    ("lcase", "lcase(p_brand) as v", "lower(p_brand) as v"),
    ("ucase", "ucase(p_name) as v", "upper(p_name) as v"),
    ("len", "len(p_name) as v, len('好') as w", "strlen(p_name) as v, 3::bigint as w"),
    ("lpad", "lpad(p_brand, 12, '*') as v, lpad(p_brand, 3, '*') as w, lpad(p_brand, -2, '*') as x", "lpad(p_brand, 12, '*') as v, left(p_brand, 3) as w, null::varchar as x"),
    ("rpad", "rpad(p_brand, 12, '*') as v, rpad(p_brand, 3, '*') as w, rpad(p_brand, 4, '') as x", "rpad(p_brand, 12, '*') as v, left(p_brand, 3) as w, null::varchar as x"),
    ("replace", "replace(p_name, 'a', 'AA') as v", "replace(p_name, 'a', 'AA') as v"),
    ("substring", "substring(p_name, 2) as v, substring(p_name, 1, 3) as w, substring(p_name, 3, 1000) as x, substring(p_name, -1) as y", "substr(p_name, 3) as v, substr(p_name, 2, 3) as w, null::varchar as x, null::varchar as y"),
    ("trim", "trim(t) as v", "p_name as v"),
    ("coalesce", "coalesce(n, p_brand) as v, coalesce(s, p_size) as w", "coalesce(n, p_brand) as v, coalesce(s, p_size) as w"),
    ("ifnull", "ifnull(n, 'none') as v, ifnull(s, 0) as w", "ifnull(n, 'none') as v, ifnull(s, 0) as w"),
]:
    add(f"fn_{_name}", f"select p_partkey, {_text} from part", f"select p_partkey, {_o} from (select *, nullif(p_type, 'PROMO') as n, nullif(p_size, 5) as s from part)", "part", add={"n": "nullif(p_type, 'PROMO')", "s": "nullif(p_size, 5)", "t": "concat(' \t　', p_name, '\n  ')"})
add("fn_parse_timestamp", "select event_id, parse_timestamp(s, '%Y-%m-%d %H:%M:%S') as v, parse_timestamp(s, '%Y-%m-%d %H:%M:%S', 'Asia/Shanghai') as w from events", "select event_id, date_trunc('second', ts)::timestamp as v, date_trunc('second', ts)::timestamp - interval 8 hours as w from events", add={"s": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"})
add("fn_format_timestamp", "select event_id, format_timestamp(ts, '%Y/%m/%d at %H:%M') as v, format_timestamp(ts, '%d %b %Y', 'Asia/Shanghai') as w from events", "select event_id, strftime(ts, '%Y/%m/%d at %H:%M') as v, strftime(ts + interval 8 hours, '%d %b %Y') as w from events")
add("fn_timestamp_add", "select event_id, timestamp_add(t, 90s) as v from events", "select event_id, date_trunc('second', ts)::timestamp + interval 90 seconds as v from events", add={"t": "date_trunc('second', ts)"})
add("fn_timestamp_sub", "select event_id, timestamp_sub(t, 2 hours) as v from events", "select event_id, date_trunc('second', ts)::timestamp - interval 2 hours as v from events", add={"t": "date_trunc('second', ts)"})

# -- running and rolling functions -----------------------------------------------------------------------------------

ALL = "partition by user_id order by event_id rows between unbounded preceding and current row"
ROLL = "partition by user_id order by event_id rows between 3 preceding and current row"
CLICK = "(event_type = 'click')"


def series(name: str, call: str, oracle: str) -> None:
    base = f"(select *, row_number() over (partition by user_id order by event_id) as i, {CLICK} as c from events)"
    add(name, f"select event_id, {call} as v from events", f"select event_id, {oracle} as v from {base} window w as (partition by user_id order by event_id), a as ({ALL}), q as ({ROLL})")


def full(x: str) -> str:
    return f"case when count(*) over q = 4 then {x} end"


for _f, _o in {"avg": r("avg(value) over a"), "sum": r("sum(value) over a"), "count": "count(value) over a", "max": r("max(value) over a"), "min": r("min(value) over a"), "first": r("first(value) over a"), "last": r("last(value) over a")}.items():
    series(f"running_{_f}", f"{_f}(value)", _o)
series("running_nested", "sum(f.ma(value, 4)) + avg(value)", r("coalesce((select null), avg(value) over a)"))
ORACLES["running_nested"] = f"select event_id, {r('coalesce(sum(m) over a, 0) + avg(value) over a')} as v from (select *, case when count(*) over q = 4 then avg(value) over q end as m from events window q as ({ROLL})) window a as ({ALL})"
add("running_whole_stream", "select event_id, sum(value) as s, avg(value) as a, count(value) as n, max(value) as hi, min(value) as lo, first(value) as f, last(user_id) as l from events", f"select event_id, {r('sum(value) over w')} as s, {r('avg(value) over w')} as a, count(value) over w as n, {r('max(value) over w')} as hi, {r('min(value) over w')} as lo, {r('first(value) over w')} as f, user_id as l from events window w as (order by event_id rows unbounded preceding)", keys=[])
add(
    "series_whole_stream",
    f"select event_id, f.ma(value, 4) as m, f.slope(value, 4) as s, f.hhvbars(value, 0) as h, f.barslast({CLICK}) as b, f.ref(value, 7) as p, f.wma(value, 0) as w from events",
    f"select event_id, case when i >= 4 then {r('avg(value) over q')} end as m, case when i >= 4 then {r('regr_slope(value, i) over q')} end as s, i - arg_max(i, value * 100000 - i) over a as h, i - max(case when event_type = 'click' then i end) over a as b, {r('lag(value, 7) over o')} as p, {r('sum(i * value) over a / sum(i) over a')} as w from (select *, row_number() over (order by event_id) as i from events) window o as (order by event_id), q as (order by event_id rows 3 preceding), a as (order by event_id rows unbounded preceding)",
    keys=[],
)
series("f_all", f"f.all({CLICK}, 4)", full("bool_and(c) over q"))
series("f_all_running", "f.all(user_id < 100, 0)", "bool_and(user_id < 100) over a")
series("f_any", f"f.any({CLICK}, 4)", full("bool_or(c) over q"))
series("f_any_running", f"f.any({CLICK}, 0)", "bool_or(c) over a")
series("f_barslast", f"f.barslast({CLICK})", "i - max(case when c then i end) over a")
series("f_barssince", f"f.barssince({CLICK})", "i - min(case when c then i end) over a")
series("f_count", f"f.count({CLICK}, 4)", full("count(*) filter (where c) over q"))
series("f_count_running", f"f.count({CLICK}, 0)", "count(*) filter (where c) over a")
series("f_hhv", "f.hhv(value, 4)", r("max(value) over q"))
series("f_llv", "f.llv(value, 4)", r("min(value) over q"))
series("f_hhvbars", "f.hhvbars(value, 4)", "i - arg_max(i, value * 100000 - i) over q")
series("f_llvbars", "f.llvbars(value, 4)", "i - arg_min(i, value * 100000 + i) over q")
series("f_hhvbars_running", "f.hhvbars(value, 0)", "i - arg_max(i, value * 100000 - i) over a")
series("f_last", f"f.last({CLICK})", "i - coalesce(max(case when not c then i end) over a, 0)")
series("f_ma", "f.ma(value, 4)", full(r("avg(value) over q")))
series("f_ma_running", "f.ma(value, 0)", r("avg(value) over a"))
series("f_ref", "f.ref(value, 3)", r("lag(value, 3) over w"))
series("f_sum", "f.sum(value, 4)", full(r("sum(value) over q")))
series("f_wma", "f.wma(value, 4)", full(r("(sum(i * value) over q - (i - 4) * sum(value) over q) / 10")))
series("f_wma_running", "f.wma(value, 0)", r("sum(i * value) over a / sum(i) over a"))
series("f_between", "f.between(value, 80.0, 20.0)", "value > 20 and value < 80")
series("f_cross", "f.cross(value, 50.0)", "case when i > 1 then lag(value) over w < 50 and value >= 50 or lag(value) over w = 50 and value > 50 end")
series("f_longcross", "f.longcross(value, 50.0, 2)", "case when i > 2 then value >= 50 and lag(value) over w < 50 and lag(value, 2) over w < 50 end")
series("f_avedev", "f.avedev(value, 4)", full(r("list_avg(list_transform(list(value) over q, lambda v: abs(v - list_avg(list(value) over q))))")))
ORACLES["f_avedev"] = f"select event_id, case when len(l) = 4 then {r('list_avg(list_transform(l, lambda v: abs(v - list_avg(l))))')} end as v from (select event_id, list(value) over q as l from events window q as ({ROLL}))"
series("f_devsq", "f.devsq(value, 4)", full(r("var_pop(value) over q * 4")))
series("f_forcast", "f.forcast(value, 4)", full(r("regr_intercept(value, i) over q + regr_slope(value, i) over q * i")))
series("f_slope", "f.slope(value, 4)", full(r("regr_slope(value, i) over q")))
series("f_std", "f.std(value, 4)", full(r("stddev_samp(value) over q")))
series("f_stddev", "f.stddev(value, 4)", full(r("stddev_pop(value) over q")))
series("f_stdp", "f.stdp(value, 4)", full(r("stddev_pop(value) over q")))
series("f_var", "f.var(value, 4)", full(r("var_samp(value) over q")))
series("f_varp", "f.varp(value, 4)", full(r("var_pop(value) over q")))


def reduced(body: str) -> str:
    return r(f"list_reduce(l, lambda p, v: {body})")


for _f, _call, _o in [
    ("dma", "f.dma(value, 0.3)", reduced("0.3 * v + 0.7 * p")),
    ("ema", "f.ema(value, 4)", reduced("(2 * v + 3 * p) / 5")),
    ("mema", "f.mema(value, 4)", reduced("(v + 3 * p) / 4")),
    ("sma", "f.sma(value, 4, 1.5)", f"case when len(l) = 1 then 0.0 else {reduced('(1.5 * v + 2.5 * p) / 4')} end"),
]:
    add(f"f_{_f}", f"select event_id, {_call} as v from events", f"select event_id, ({_o})::double as v from (select event_id, list(value) over a as l from events window a as ({ALL}))")
add("f_filter", f"select event_id, f.filter({CLICK}, 2) as v from events", f"select event_id, list_reduce(list_prepend(0, l), lambda s, x: case when s // 2 = 0 then case when x = 1 then 5 else 0 end else 2 * (s // 2 - 1) end) % 2 = 1 as v from (select event_id, list({CLICK}::integer) over a as l from events window a as ({ALL}))")


def dsl_pipeline(spark, sf_dir: str) -> DataFrame:
    """The DSL from source to result: filter, windowed aggregate, filter, projection."""
    f = stream(spark, sf_dir, "events")
    out = f.filter(E.col("value").gt(10.0)).aggregate([E.col("event_type")], [E.col("event_type"), E.call("sum", E.col("value")).alias("total")], Window.fixed(DAY))
    return finished(out.filter(E.col("total").gt(1000.0)).select(E.col("event_type"), E.col("total") / 2, E.col("@time")).to_df().toDF("event_type", "half", "@time"))


QUERIES["dsl_pipeline"] = dsl_pipeline
ORACLES["dsl_pipeline"] = f"select event_type, {r('sum(value) / 2')} as half, {bucket('ts', DAY)} as window_start from events where value > 10 group by event_type, {bucket('ts', DAY)} having sum(value) > 1000"
