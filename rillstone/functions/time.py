"""Time functions over instants in milliseconds. Formats are strftime patterns, translated to Java's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from .registry import Function, exact, one_of, register

#: Strftime specifiers and the Java patterns of the same meaning.
SPECIFIERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "j": "DDD",
    "H": "HH", "I": "hh", "k": "H", "l": "h", "M": "mm", "S": "ss", "p": "a",
    "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "f": "SSSSSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS", ".9f": ".SSSSSSSSS", "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS",
    "z": "xx", ":z": "xxx", "Z": "zzz",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "X": "HH:mm:ss", "x": "MM/dd/yy",
    "n": "'\n'", "t": "'\t'", "%": "'%'",
}


def java_pattern(fmt: str) -> str:
    """The Java pattern of a strftime format; text between specifiers is quoted."""
    out, text, i = [], "", 0

    def flush():
        nonlocal text
        if text:
            out.append("'" + text.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in text) else text)
        text = ""

    while i < len(fmt):
        if fmt[i] != "%":
            text += fmt[i]
            i += 1
            continue
        spec = next((fmt[i + 1 : i + 1 + n] for n in (3, 2, 1) if fmt[i + 1 : i + 1 + n] in SPECIFIERS and len(fmt[i + 1 : i + 1 + n]) == n), None)
        if spec is None:
            raise PlanError(f"unsupported time format: {fmt[i : i + 2]}")
        flush()
        out.append(SPECIFIERS[spec])
        i += 1 + len(spec)
    flush()
    return "".join(out)


def _zone(tz: Column | None) -> Column:
    return F.lit("UTC") if tz is None else F.coalesce(tz, F.lit("UTC"))


def _parse(types, s: Column, fmt: str | None, tz: Column | None = None) -> Column:
    """An unparsable text is an error; a null text or format gives null, a null zone means UTC."""
    if fmt is None:
        return F.lit(None).cast("timestamp")
    local = F.to_timestamp_ntz(s, F.lit(java_pattern(fmt)))
    return F.convert_timezone(_zone(tz), F.lit("UTC"), local).cast("timestamp")


def _format(types, t: Column, fmt: str | None, tz: Column | None = None) -> Column:
    if fmt is None:
        return F.lit(None).cast("string")
    return F.date_format(F.from_utc_timestamp(t, _zone(tz)), java_pattern(fmt))


def _shift(sign: int):
    """Milliseconds added; a result outside the range is null."""

    def build(types, t: Column, ms: Column) -> Column:
        return F.timestamp_millis(F.try_add(F.unix_millis(t), ms if sign > 0 else F.try_subtract(F.lit(0).cast("long"), ms)))

    return build


register(Function("parse_timestamp", one_of(exact("string", "string"), exact("string", "string", "string")), "timestamp", build=_parse, constants=(1,)))
register(Function("format_timestamp", one_of(exact("timestamp", "string"), exact("timestamp", "string", "string")), "string", build=_format, constants=(1,)))
register(Function("timestamp_add", exact("timestamp", "int64"), "timestamp", build=_shift(1)))
register(Function("timestamp_sub", exact("timestamp", "int64"), "timestamp", build=_shift(-1)))
