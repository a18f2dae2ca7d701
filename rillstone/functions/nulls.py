"""coalesce: the first value that is not null, in the first argument's type; ifnull: the same of two."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..types import NUMERIC
from .registry import Function, exact, one_of, register, variadic_equal

register(Function("coalesce", variadic_equal(), lambda a: a[0], build=lambda types, *x: F.coalesce(*x)))
register(Function("ifnull", one_of(*[exact(t, t) for t in ("null", *NUMERIC, "boolean", "timestamp", "string")]), lambda a: a[0], build=lambda types, a, b: F.coalesce(a, b)))
