"""Rolling statistics over the last n rows, namespace ``f``: null until n rows are there, and for n < 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Function, exact, register
from .series_ref import number


def _stat(name: str, build) -> None:
    def running(w, x, n):
        if n < 2:
            return F.lit(None).cast("double")
        return w.full(n, build(w, number(x), w.last(n), n))

    register(Function(name, exact("float64", "int64"), "float64", "series", "f", running=running, constants=(1,)))


def _avedev(w, x, over, n):
    values = F.collect_list(x).over(over)
    mean = F.avg(x).over(over)
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + F.abs(v - mean)) / n


def _slope(w, x, over, n):
    return F.regr_slope(x, w.index.cast("double")).over(over)


def _forecast(w, x, over, n):
    i = w.index.cast("double")
    return F.regr_intercept(x, i).over(over) + F.regr_slope(x, i).over(over) * i


_stat("avedev", _avedev)
_stat("devsq", lambda w, x, over, n: F.var_pop(x).over(over) * n)
_stat("forcast", _forecast)
_stat("slope", _slope)
_stat("std", lambda w, x, over, n: F.stddev_samp(x).over(over))
_stat("stddev", lambda w, x, over, n: F.stddev_pop(x).over(over))
_stat("stdp", lambda w, x, over, n: F.stddev_pop(x).over(over))
_stat("var", lambda w, x, over, n: F.var_samp(x).over(over))
_stat("varp", lambda w, x, over, n: F.var_pop(x).over(over))
