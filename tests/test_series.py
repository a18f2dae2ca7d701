"""All stateful functions: window expressions against their sequential steps on random series."""

import math
import random

import pytest

from rillstone import StreamFrame, sql
from rillstone.functions.registry import all_functions
from rillstone.functions.stepping import STEPS, step_of

CALLS = [
    *[f"f.{n}(c, {k})" for n in ("all", "any", "count", "filter") for k in (3, 1, 0)],
    *[f"f.{n}(x, {k})" for n in ("hhv", "llv", "hhvbars", "llvbars", "ma", "sum", "wma") for k in (4, 1, 0)],
    *[f"f.{n}(x, {k})" for n in ("avedev", "devsq", "forcast", "slope", "std", "stddev", "stdp", "var", "varp") for k in (4, 1)],
    *[f"f.{n}(c)" for n in ("barslast", "barssince", "last")],
    "f.ref(x, 3)", "f.ref(x, 0)", "f.dma(x, 0.3)", "f.dma(x, 1.5)", "f.ema(x, 4)", "f.ema(x, 0)", "f.mema(x, 4)", "f.mema(x, 0)", "f.sma(x, 4, 1.5)",
    "f.cross(x, y)", "f.longcross(x, y, 2)", "f.longcross(x, y, 0)",
    *[f"{n}(x)" for n in ("avg", "sum", "count", "max", "min", "first", "last")],
]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    pick = lambda: None if rnd.random() < 0.1 else float(rnd.randrange(12))
    return [(i, rnd.choice("ab"), pick(), pick(), None if rnd.random() < 0.1 else rnd.random() < 0.4) for i in range(160)]


@pytest.fixture(scope="module", params=["series", "whole"])
def got(spark, rows, request, whole_blocks):
    df = spark.createDataFrame(rows, "i long, k string, x double, y double, c boolean")
    frame = StreamFrame.source(df, seq="i", partition_by=["k"] if request.param == "series" else [])
    items = ", ".join(f"{c} as v{n}" for n, c in enumerate(CALLS))
    return request.param, {r.i: r for r in sql(f"select i, {items} from t", {"t": frame}).to_df().collect()}


@pytest.fixture(scope="module")
def whole_blocks():
    """Blocks of few rows, so that rows are lent from block to block."""
    from rillstone.plans import compile as plans

    before, plans.BLOCK_ROWS = plans.BLOCK_ROWS, 20
    yield
    plans.BLOCK_ROWS = before


@pytest.mark.parametrize("n", range(len(CALLS)))
def test_against_steps(rows, got, n):
    call = CALLS[n]
    space, name = ("f", call[2 : call.index("(")]) if call.startswith("f.") else (None, call[: call.index("(")])
    args = [a.strip() for a in call[call.index("(") + 1 : -1].split(",")]
    kind, got = got
    states = {}
    for i, k, x, y, c in rows:
        k = k if kind == "series" else None
        values = [{"x": x, "y": y, "c": c}[a] if a in ("x", "y", "c") else float(a) if "." in a else int(a) for a in args]
        zeros = tuple(None if space is None or name == "ref" else False if a == "c" else 0 for a in args)
        states[k], want = step_of(space, name, zeros, states.get(k), *values)
        have = getattr(got[i], f"v{n}")
        if isinstance(want, float) and math.isnan(want):
            assert math.isnan(have)
        elif isinstance(want, float):
            assert have == pytest.approx(want, abs=1e-9)
        else:
            assert have == want, (call, i)


def test_every_stateful_function_has_a_step():
    assert {(f.namespace, f.name) for f in all_functions() if f.kind != "scalar"} == set(STEPS)


def test_in_windows_the_last_value_counts(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i long, x double")
    frame = StreamFrame.source(df, time=None, seq="i")
    row = sql("select f.ma(x, 3) as m, f.ema(x, 2) as e, f.ma(sum(x), 2) as s, sum(f.ref(x, 1)) as r from t window year", {"t": frame}).to_df().first()
    e = 0.0
    for x in range(1, 10):
        e = (2 * x + e) / 3
    assert (row.m, row.s, row.r) == (8.0, 40.5, 36.0) and row.e == pytest.approx(e)


@pytest.mark.parametrize("order", ["i", "t", "text", "day", "exact"])
def test_whole_streams_need_no_single_task(spark, rows, order):
    df = spark.createDataFrame(rows, "i long, k string, x double, y double, c boolean").selectExpr("*", "timestamp_millis(i * 7) as t", "lpad(i, 5, '0') as text", "date_add(date'1969-12-01', cast(i as int)) as day", "cast(i / 3.0 - 20 as decimal(20, 6)) as exact")
    frame = StreamFrame.source(df, seq=order)
    names = ("avg", "sum", "count", "max", "min", "first", "last")
    out = sql("select i, " + ", ".join(f"{n}(x) as v_{n}" for n in names) + ", sum(max(y)) as nested from t", {"t": frame}).to_df()
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = {r.i: r for r in out.collect()}
    states, top, total = {}, None, 0.0
    for i, _, x, y, _ in rows:
        for n in names:
            states[n], want = step_of(None, n, (None,), states.get(n), x)
            have = getattr(got[i], f"v_{n}")
            assert have == pytest.approx(want, nan_ok=True) if want is not None else have is None
        top = y if top is None or (y is not None and y > top) else top
        total += top or 0.0
        assert got[i].nested == pytest.approx(total)


def test_recurrences_of_whole_streams_go_by_buckets(spark):
    """Several rows a bucket, parameters by row, an infinity, ties of buckets' borders, and a stream of one row."""
    rnd = random.Random(5)
    rows = [(i * rnd.choice((1, 1, 40)), None if rnd.random() < 0.1 else rnd.gauss(0, 9), rnd.random() * 1.4 - 0.2, rnd.randrange(6), rnd.choice((0.0, 1.0, 2.5))) for i in range(3000)]
    rows = sorted({r[0]: r for r in rows}.values())
    rows[2500] = (rows[2500][0], math.inf, 0.5, 3, 1.0)
    calls = {"dma": ("x", "a"), "ema": ("x", "n"), "mema": ("x", "n"), "sma": ("x", "n", "m")}
    text = "select i, " + ", ".join(f"f.{f}({', '.join(a)}) as {f}" for f, a in calls.items()) + ", f.mema(f.ema(x, 9), 5) as nested from t"
    for some in (rows, rows[:1]):
        frame = StreamFrame.source(spark.createDataFrame(some, "i long, x double, a double, n long, m double").repartition(5), seq="i")
        out = sql(text, {"t": frame}).to_df()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(some) == 1 or ("hashpartitioning(__bucket" in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0])
        got, states, inner, outer = {r.i: r for r in out.collect()}, {}, None, None
        assert len(got) == len(some)
        for row in some:
            values = dict(zip("ixanm", row, strict=True))
            for f, names in calls.items():
                states[f], want = step_of("f", f, (0.0,) * len(names), states.get(f), *[values[n] for n in names])
                assert got[row[0]][f] == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True), (f, row)
            inner, e = step_of("f", "ema", (0.0, 0), inner, values["x"], 9)
            outer, want = step_of("f", "mema", (0.0, 0), outer, e, 5)
            assert got[row[0]].nested == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True)
