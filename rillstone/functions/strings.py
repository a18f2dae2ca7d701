"""String functions. ``len`` counts bytes; other positions count characters from 0 (the same for ASCII).

Out-of-range positions give null instead of clipping; an empty search text in ``replace`` leaves the text as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Function, exact, one_of, register, variadic

S, I = "string", "int64"


def _chr(types, n: Column) -> Column:
    fits = ((n >= 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(F.when(fits, n)), 8, "0")), "UTF-32"))


def _concat(types, *x: Column) -> Column:
    return F.when(F.coalesce(*x).isNotNull(), F.concat_ws("", *x))


def _concat_ws(types, sep: Column, *x: Column) -> Column:
    if not x:
        return F.lit(None).cast("string")
    return F.when(sep.isNotNull() & F.coalesce(*x).isNotNull(), F.call_function("concat_ws", sep, *x))


def _encode(types, s: Column, source: Column, target: Column) -> Column:
    """Between hex (lower case), base64 and utf8; unknown encodings and texts that don't decode are errors."""
    a, b = F.lower(source), F.lower(target)
    bad = F.raise_error(F.concat(F.lit("unknown encoding: "), F.concat_ws("/", source, target)))
    raw = F.when(a == "hex", F.unhex(s)).when(a == "base64", F.unbase64(s)).when(a == "utf8", s.cast("binary")).otherwise(bad.cast("binary"))
    text = F.when(b == "hex", F.lower(F.hex(raw))).when(b == "base64", F.base64(raw)).when(b == "utf8", F.validate_utf8(F.decode(raw, "UTF-8"))).otherwise(bad.cast("string"))
    return F.when(s.isNotNull() & source.isNotNull() & target.isNotNull(), text)


def _found(s: Column, sub: Column, first: Column) -> Column:
    """0-based position of sub at or after the 1-based position ``first``; null if there is none."""
    at = F.call_function("locate", sub, s, first)
    return F.when(at > 0, (at - 1).cast("long"))


def _rfound(s: Column, sub: Column) -> Column:
    """0-based position of the last occurrence."""
    at = F.call_function("locate", F.reverse(sub), F.reverse(s), F.lit(1))
    return F.when(at > 0, (F.length(s) - F.length(sub) - (at - 1)).cast("long"))


def _instr(types, s: Column, sub: Column, pos: Column | None = None, nth: Column | None = None) -> Column:
    """pos < 0 searches backward in what is left of the text without its last -pos - 1 characters; nth counts occurrences,
    forward ones may overlap, backward ones may not. nth below 1 gives null."""
    if pos is None:
        return _found(s, sub, F.lit(1))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    kept = F.substring(s, F.lit(1), F.greatest(F.lit(0), F.length(s) + pos + 1).cast("int"))
    if nth is None:
        return F.when(pos < 0, _rfound(kept, sub)).otherwise(_found(s, sub, (pos + 1).cast("int")))
    forward = F.aggregate(F.sequence(one, F.greatest(nth, one)), pos - 1, lambda p, _: F.when(p.isNotNull(), _found(s, sub, (p + 2).cast("int"))))
    start = F.struct(kept.alias("rest"), F.lit(None).cast("long").alias("at"))

    def back(state, _):
        at = _rfound(state["rest"], sub)
        return F.struct(F.when(at.isNotNull(), F.substring(state["rest"], F.lit(1), F.coalesce(at, zero).cast("int"))).alias("rest"), at.alias("at"))

    backward = F.aggregate(F.sequence(one, F.greatest(nth, one)), start, back, lambda st: st["at"])
    return F.when(nth >= 1, F.when(pos < 0, backward).otherwise(forward))


def _pad(f):
    return lambda types, s, n, p: F.when((n >= 0) & (p != ""), f(s, F.when(n >= 0, n).cast("int"), p))


def _substring(types, s: Column, pos: Column, n: Column | None = None) -> Column:
    size = F.length(s)
    if n is None:
        return F.when((pos >= 0) & (pos <= size), F.substring(s, (pos + 1).cast("int"), size))
    return F.when((pos >= 0) & (n >= 0) & (pos + n <= size), F.substring(s, (pos + 1).cast("int"), n.cast("int")))


register(Function("chr", exact(I), S, build=_chr))
register(Function("concat", variadic(S), S, build=_concat))
register(Function("concat_ws", variadic(S), S, build=_concat_ws))
register(Function("encode", exact(S, S, S), S, build=_encode))
register(Function("instr", one_of(exact(S, S), exact(S, S, I), exact(S, S, I, I)), I, build=_instr))
register(Function("lcase", exact(S), S, build=lambda types, s: F.lower(s)))
register(Function("len", exact(S), I, build=lambda types, s: F.octet_length(s).cast("long")))
register(Function("lpad", exact(S, I, S), S, build=_pad(F.lpad)))
register(Function("replace", exact(S, S, S), S, build=lambda types, s, a, b: F.replace(s, a, b)))
register(Function("rpad", exact(S, I, S), S, build=_pad(F.rpad)))
register(Function("substring", one_of(exact(S, I), exact(S, I, I)), S, build=_substring))
register(Function("trim", exact(S), S, build=lambda types, s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")))
register(Function("ucase", exact(S), S, build=lambda types, s: F.upper(s)))
