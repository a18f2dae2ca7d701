"""Every stateful function as a step from row to row: step(state, *arguments) -> (state, value); state None at the start.

Streams use these with Spark's state store; bounded queries use window expressions instead. States are plain picklable values
of bounded size: at most the last n rows. ``f.*`` steps see nulls as 0 or false, except ``f.ref``; aggregates skip nulls.
"""

from __future__ import annotations

import math

from .registry import Function
from .series_logic import EPSILON
from .series_ref import _dma, _ema, _filter, _mema, _sma


def _avg(s, x):
    total, n = s or (0.0, 0)
    s = (total, n) if x is None else (total + x, n + 1)
    return s, (s[0] / s[1] if s[1] else float("nan"))


def _sum(s, x):
    s = (s or 0.0) + (0.0 if x is None else x)
    return s, s


def _count(s, x):
    s = (s or 0) + (x is not None)
    return s, s


def _pick(better):
    def step(s, x):
        if x is not None and not (isinstance(x, float) and math.isnan(x)) and (s is None or better(x, s)):
            s = x
        return s, s

    return step


def _first(s, x):
    s = (x,) if s is None and x is not None else s
    return s, s and s[0]


def _last(s, x):
    s = s if x is None else x
    return s, s


def _buffered(value, all_value, full=True):
    """value(buffer of the last n); all_value(state, x) -> (state, value) since the start."""

    def step(s, x, n):
        if n <= 0:
            return all_value(s, x)
        s = [*(s or []), x][-n:]
        return s, (value(s) if len(s) == n or not full else None)

    return step


def _all_so_far(fold, start, finish=lambda s: s):
    def step(s, x):
        s = fold(start if s is None else s, x)
        return s, finish(s)

    return step


def _barslast(s, x):
    s = 0 if x else None if s is None else s + 1
    return s, s


def _barssince(s, x):
    s = s + 1 if s is not None else 0 if x else None
    return s, s


def _run(s, x):
    s = (s or 0) + 1 if x else 0
    return s, s


def _bars(better):
    def step(s, x, n):
        if n <= 0:
            best, at, i = s or (None, 0, 0)
            i += 1
            if best is None or better(x, best):
                best, at = x, i
            return (best, at, i), i - at
        s = [*(s or []), x][-n:]
        at = 0
        for i in range(1, len(s)):
            if better(s[i], s[at]):
                at = i
        return s, len(s) - 1 - at

    return step


def _ref(s, x, n):
    if n <= 0:
        return [], x
    s = [*(s or []), x][-(n + 1) :]
    return s, (s[0] if len(s) == n + 1 else None)


def _wma(s, x, n):
    if n <= 0:
        total, weights, i = s or (0.0, 0, 0)
        i += 1
        s = (total + i * x, weights + i, i)
        return s, s[0] / s[1]
    s = [*(s or []), x][-n:]
    return s, (sum((i + 1) * v for i, v in enumerate(s)) / (n * (n + 1) / 2) if len(s) == n else None)


def _cross(s, a, b):
    if s is None:
        return (a, b), None
    before, other = s
    if abs(before - other) < EPSILON:
        return (a, b), a > b
    return (a, b), before < other and a >= b


def _longcross(s, a, b, n):
    rows, below = s or (0, 0)
    value = None if n <= 0 or rows < n else a >= b and below >= n
    return (rows + 1, below + 1 if a < b else 0), value


def _stat(value):
    def step(s, x, n):
        if n < 2:
            return s, None
        s = [*(s or []), x][-n:]
        return s, (value(s) if len(s) == n else None)

    return step


def _mean(b):
    return sum(b) / len(b)


def _squares(b):
    m = _mean(b)
    return sum((v - m) ** 2 for v in b)


def _slope(b):
    n = len(b)
    mi, mx = (n - 1) / 2, _mean(b)
    return sum((i - mi) * (v - mx) for i, v in enumerate(b)) / sum((i - mi) ** 2 for i in range(n))


STEPS = {
    (None, "avg"): _avg,
    (None, "sum"): _sum,
    (None, "count"): _count,
    (None, "max"): _pick(lambda a, b: a > b),
    (None, "min"): _pick(lambda a, b: a < b),
    (None, "first"): _first,
    (None, "last"): _last,
    ("f", "all"): _buffered(all, _all_so_far(lambda s, x: s and x, True)),
    ("f", "any"): _buffered(any, _all_so_far(lambda s, x: s or x, False)),
    ("f", "count"): _buffered(sum, _all_so_far(lambda s, x: s + bool(x), 0)),
    ("f", "sum"): _buffered(sum, _all_so_far(lambda s, x: s + x, 0.0)),
    ("f", "ma"): _buffered(_mean, _all_so_far(lambda s, x: (s[0] + x, s[1] + 1), (0.0, 0), lambda s: s[0] / s[1])),
    ("f", "hhv"): _buffered(max, _all_so_far(max, -math.inf), full=False),
    ("f", "llv"): _buffered(min, _all_so_far(min, math.inf), full=False),
    ("f", "hhvbars"): _bars(lambda a, b: a > b),
    ("f", "llvbars"): _bars(lambda a, b: a < b),
    ("f", "barslast"): _barslast,
    ("f", "barssince"): _barssince,
    ("f", "last"): _run,
    ("f", "ref"): _ref,
    ("f", "wma"): _wma,
    ("f", "dma"): _dma,
    ("f", "ema"): _ema,
    ("f", "mema"): _mema,
    ("f", "sma"): _sma,
    ("f", "filter"): _filter,
    ("f", "cross"): _cross,
    ("f", "longcross"): _longcross,
    ("f", "avedev"): _stat(lambda b: sum(abs(v - _mean(b)) for v in b) / len(b)),
    ("f", "devsq"): _stat(_squares),
    ("f", "forcast"): _stat(lambda b: _mean(b) + _slope(b) * (len(b) - 1) / 2),
    ("f", "slope"): _stat(_slope),
    ("f", "std"): _stat(lambda b: math.sqrt(_squares(b) / (len(b) - 1))),
    ("f", "stddev"): _stat(lambda b: math.sqrt(_squares(b) / len(b))),
    ("f", "stdp"): _stat(lambda b: math.sqrt(_squares(b) / len(b))),
    ("f", "var"): _stat(lambda b: _squares(b) / (len(b) - 1)),
    ("f", "varp"): _stat(lambda b: _squares(b) / len(b)),
}


def step_of(namespace: str | None, name: str, zeros: tuple, *arguments_of_state):
    """The step of a function with nulls replaced by ``zeros`` (None: kept)."""
    step = STEPS[namespace, name]
    state, *values = arguments_of_state
    return step(state, *[z if v is None else v for v, z in zip(values, zeros, strict=True)])


def zeros_for(f: Function, types: tuple[str, ...]) -> tuple:
    """What a null argument counts as, by position."""
    if f.namespace is None or f.name == "ref":
        return (None,) * len(types)
    return tuple(False if t == "boolean" else 0.0 if t.startswith("float") else 0 for t in types)
