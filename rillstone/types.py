"""The closed set of data types, their Spark types, and the implicit widening lattice.

Integers widen to larger integers, then to float32 and float64; everything but null counts as castable to string by the
lattice. Timestamps are instants; a zone is metadata of a column, never part of type equality.
"""

from __future__ import annotations

from pyspark.sql import types as T

INTS = ("int8", "int16", "int32", "int64")
FLOATS = ("float32", "float64")
NUMERIC = INTS + FLOATS
SPARK = {
    "null": T.NullType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "string": T.StringType(),
}
_BY_SPARK = {type(v): k for k, v in SPARK.items()} | {T.TimestampNTZType: "timestamp", T.DateType: "timestamp", T.VarcharType: "string", T.CharType: "string", T.DecimalType: "float64"}


def name_of(spark_type: T.DataType) -> str:
    """The type's name here; ``other`` for nested and binary types, which can only be passed through."""
    return _BY_SPARK.get(type(spark_type), "other")


def can_widen(a: str, b: str) -> bool:
    """Whether an argument of type a may stand where b is wanted."""
    if a == b:
        return True
    if a in NUMERIC and b in NUMERIC:
        return NUMERIC.index(a) < NUMERIC.index(b)
    if a == "null":
        return True
    return b == "string" and a in (*NUMERIC, "boolean")


def literal_type(value) -> str:
    """The narrowest type of a literal; floats are float64 (a float32 literal would carry its rounding error along)."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        for name, bits in zip(INTS, (7, 15, 31, 63), strict=True):
            if -(1 << bits) <= value < 1 << bits:
                return name
        return "float64"
    if isinstance(value, float):
        return "float64"
    if isinstance(value, str):
        return "string"
    raise TypeError(f"no literal type for {type(value).__name__}")
