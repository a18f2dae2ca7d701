"""Comparisons of series, namespace ``f``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Function, exact, register
from .series_ref import number

D = "float64"
#: Values closer than this count as equal.
EPSILON = 2.220446049250313e-16


def _cross(w, a, b):
    """a comes from below b to b or above; from equality it must rise above. Null on the first row."""
    a, b = number(a), number(b)
    pa, pb = F.lag(a).over(w.back(1)), F.lag(b).over(w.back(1))
    same = F.abs(pa - pb) < EPSILON
    return F.when(pa.isNotNull(), F.when(same, a > b).when(pa < pb, a >= b).otherwise(F.lit(False)))


def _longcross(w, a, b, n):
    """a reaches b after at least n consecutive rows below it; null for the first n rows and for n <= 0."""
    if n <= 0:
        return F.lit(None).cast("boolean")
    a, b = number(a), number(b)
    before = w.back(n).rowsBetween(-n, -1)
    return F.when(w.index > n, (a >= b) & F.bool_and(a < b).over(before))


register(Function("between", exact(D, D, D), "boolean", "scalar", "f", build=lambda types, a, b, c: ((a > b) & (a < c)) | ((a > c) & (a < b))))
register(Function("cross", exact(D, D), "boolean", "series", "f", running=_cross))
register(Function("longcross", exact(D, D, "int64"), "boolean", "series", "f", running=_longcross, constants=(2,)))
