"""Rolling and running functions over an ordered series, namespace ``f``.

n > 0 means the last n rows, n <= 0 all rows since the start; n must be a constant. Nulls count as 0 or false, except in
``f.ref``. Functions marked recurrence depend on their own last value and are folded over each series in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .registry import Function, anything, exact, register

I, D, B = "int64", "float64", "boolean"


class SeriesWindow:
    """The ordered series that a function runs along. ``index`` holds the row's number in its series, from 1."""

    def __init__(self, spec: WindowSpec):
        self.spec = spec

    @property
    def index(self) -> Column:
        return F.col("__rill_index")

    def last(self, n: int) -> WindowSpec:
        """The last n rows."""
        return self.back(n - 1).rowsBetween(-(n - 1), Window.currentRow)

    def back(self, n: int) -> WindowSpec:
        """The order, for functions that look at most n rows back."""
        return self.spec

    def upto(self, function: str, x: Column) -> Column:
        """An aggregate over all rows so far: sum, count, avg, max or min."""
        made = getattr(F, function)(x).over(self.spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return F.coalesce(made, F.lit(0.0)) if function == "sum" else made

    def full(self, n: int, x: Column) -> Column:
        """x once n rows are there."""
        return F.when(F.count(F.lit(1)).over(self.last(n)) >= n, x) if n > 1 else x


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def number(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _series(name: str, types: tuple, returns, running, constants: tuple = (1,)) -> None:
    register(Function(name, exact(*types), returns, "series", "f", running=running, constants=constants))


def _rolling(name: str, kind: str, returns: str, clean, over, so_far, whole: bool = True) -> None:
    """over(value, window) for n > 0, null until n rows are there if ``whole``; so_far(series, value) since the start."""

    def running(w, x, n):
        x = clean(x)
        if n <= 0:
            return so_far(w, x)
        made = over(x, w.last(n))
        return w.full(n, made) if whole else made

    _series(name, (kind, I), returns, running)


_rolling("all", B, B, flag, lambda x, q: F.bool_and(x).over(q), lambda w, x: w.upto("min", x.cast("int")) == 1)
_rolling("any", B, B, flag, lambda x, q: F.bool_or(x).over(q), lambda w, x: w.upto("max", x.cast("int")) == 1)
_rolling("count", B, I, flag, lambda x, q: F.count_if(x).over(q), lambda w, x: w.upto("count", F.when(x, 1)))
_rolling("hhv", D, D, number, lambda x, q: F.max(x).over(q), lambda w, x: w.upto("max", x), False)
_rolling("llv", D, D, number, lambda x, q: F.min(x).over(q), lambda w, x: w.upto("min", x), False)
_rolling("ma", D, D, number, lambda x, q: F.avg(x).over(q), lambda w, x: w.upto("avg", x))
_rolling("sum", D, D, number, lambda x, q: F.sum(x).over(q), lambda w, x: w.upto("sum", x))


def _barslast(w, x):
    return w.index - w.upto("max", F.when(flag(x), w.index))


def _barssince(w, x):
    return w.index - w.upto("min", F.when(flag(x), w.index))


def _run(w, x):
    return w.index - F.coalesce(w.upto("max", F.when(~flag(x), w.index)), F.lit(0).cast("long"))


def _hhvbars(w, x, n):
    """Back to the earliest greatest value: the greatest pair of value and negated row number."""
    pair = F.struct(number(x).alias("x"), (-w.index).alias("i"))
    return w.index + (F.max(pair).over(w.last(n)) if n > 0 else w.upto("max", pair))["i"]


def _llvbars(w, x, n):
    pair = F.struct(number(x).alias("x"), w.index.alias("i"))
    return w.index - (F.min(pair).over(w.last(n)) if n > 0 else w.upto("min", pair))["i"]


def _wma(w, x, n):
    """Weights 1 to n, the newest the largest; since the start the weights are the row numbers."""
    x = number(x)
    if n > 0:
        weighted, plain = F.sum(w.index * x).over(w.last(n)), F.sum(x).over(w.last(n))
        return w.full(n, (weighted - (w.index - n) * plain) / (n * (n + 1) / 2))
    return w.upto("sum", w.index * x) / w.upto("sum", w.index.cast("double"))


_series("barslast", (B,), I, _barslast, ())
_series("barssince", (B,), I, _barssince, ())
_series("last", (B,), I, _run, ())
_series("hhvbars", (D, I), I, _hhvbars)
_series("llvbars", (D, I), I, _llvbars)
_series("wma", (D, I), D, _wma)
register(Function("ref", anything(2), lambda a: a[0], "series", "f", running=lambda w, x, n: F.lag(x, n).over(w.back(n)) if n > 0 else x, constants=(1,)))


# Steps of the recurrences: step(state, *values) -> (state, value); state None before the first row.
def _dma(state, x, a):
    y = x if state is None else min(max(a, 0.0), 1.0) * x + (1 - min(max(a, 0.0), 1.0)) * state
    return y, y


def _ema(state, x, n):
    if state is None:
        return x, x
    y = (2 * x + (n - 1) * state) / (n + 1) if n else state
    return y, y


def _mema(state, x, n):
    if state is None:
        return x, x
    y = (x + (n - 1) * state) / n if n >= 1 else state
    return y, y


def _sma(state, x, n, m):
    """The first row gives 0.0 and starts from x."""
    if state is None:
        return x, 0.0
    y = (m * x + (n - m) * state) / n if n > 0 else state
    return y, y


def _filter(state, x, n):
    """A true makes the next n rows false; n <= 0: only the first true counts. state: rows still to suppress, -1 for ever."""
    left = 0 if state is None else state
    if left == 0:
        return ((n if n > 0 else -1), True) if x else (0, False)
    return (left - 1 if left > 0 else -1), False


def _whole(known, a, b):
    """a and b where known, else the map that keeps the state."""
    return np.where(known, a, 1.0), np.where(known, b, 0.0)


def _dma_map(x, a):
    a = np.clip(a, 0.0, 1.0)
    return 1 - a, a * x


#: The same recurrences as maps state -> a * state + b of all rows but a series' first, from arrays of their arguments.
MAPS = {
    "dma": _dma_map,
    "ema": lambda x, n: _whole(n != 0, (n - 1) / (n + 1), 2 * x / (n + 1)),
    "mema": lambda x, n: _whole(n >= 1, (n - 1) / n, x / n),
    "sma": lambda x, n, m: _whole(n > 0, (n - m) / n, m * x / n),
}

register(Function("dma", exact(D, D), D, "recurrence", "f"))
register(Function("ema", exact(D, I), D, "recurrence", "f"))
register(Function("mema", exact(D, I), D, "recurrence", "f"))
register(Function("sma", exact(D, I, D), D, "recurrence", "f"))
register(Function("filter", exact(B, I), B, "recurrence", "f"))
