"""Aggregates. In a windowed aggregate they are ordinary grouped aggregations; elsewhere they run along the series: one value
for each row, over all rows up to it.

``sum`` and ``avg`` are float64 and give 0.0 and NaN without a value; ``max`` and ``min`` of floats ignore NaN; ``first`` and
``last`` are the first and last non-null values in arrival order; ``count`` counts non-null values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Function, anything, exact, register, uniform

NUMBERS = ("float64", "float32", "int64", "int32", "int16", "int8")


def _plain(f: Callable[[tuple, Column], Column], finish: Callable[[Column], Column] = lambda x: x) -> dict:
    return {
        "grouped": lambda types, x, seq: finish(f(types, x)),
        "running": lambda types, x, window: finish(f(types, x).over(window)),
    }


def _no_nan(types: tuple, x: Column) -> Column:
    return F.when(~F.isnan(x), x) if types[0] in ("float32", "float64") else x


register(Function("avg", exact("float64"), "float64", "aggregate", **_plain(lambda t, x: F.avg(x), lambda x: F.coalesce(x, F.lit(float("nan"))))))
register(Function("sum", exact("float64"), "float64", "aggregate", **_plain(lambda t, x: F.sum(x), lambda x: F.coalesce(x, F.lit(0.0)))))
register(Function("count", anything(1), "int64", "aggregate", **_plain(lambda t, x: F.count(x))))
register(Function("max", uniform(1, *NUMBERS), lambda a: a[0], "aggregate", **_plain(lambda t, x: F.max(_no_nan(t, x)))))
register(Function("min", uniform(1, *NUMBERS), lambda a: a[0], "aggregate", **_plain(lambda t, x: F.min(_no_nan(t, x)))))
register(
    Function(
        "first", anything(1), lambda a: a[0], "aggregate",
        grouped=lambda types, x, seq: F.min_by(x, F.when(x.isNotNull(), seq)),
        running=lambda types, x, window: F.first(x, ignorenulls=True).over(window),
    )
)
register(
    Function(
        "last", anything(1), lambda a: a[0], "aggregate",
        grouped=lambda types, x, seq: F.max_by(x, F.when(x.isNotNull(), seq)),
        running=lambda types, x, window: F.last(x, ignorenulls=True).over(window),
    )
)
