"""Seventeen math functions: null in, null out; float32 stays float32, integers become float64.

Where Spark differs from IEEE results (logarithms outside their domain, sign of zero, integer-valued rounding) a CASE
restores them; the sign of negative zero can't be told apart in SQL and counts as positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Function, register, uniform


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    nan, low = F.lit(float("nan")), F.lit(float("-inf"))
    return lambda x: F.when(x == 0, low).when((x < 0) | F.isnan(x), nan).otherwise(f(x))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding to a bigint fails for NaN, infinities and large values, which are whole already."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= float(1 << 52)), x).otherwise(f(x).cast("double"))


_BUILDERS: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "floor": _whole(F.floor),
    "ceil": _whole(F.ceil),
    "round": _whole(lambda x: F.round(x)),
    "trunc": _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "abs": F.abs,
    "signum": lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.signum(x)),
    "exp": F.exp,
    "ln": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
}


def _typed(f: Callable[[Column], Column]) -> Callable:
    return lambda types, x: f(x.cast("double")).cast("float") if types[0] == "float32" else f(x)


for _name, _f in _BUILDERS.items():
    register(Function(_name, uniform(1, "float64", "float32"), lambda a: a[0], build=_typed(_f)))
