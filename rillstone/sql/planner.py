"""Select statements to StreamFrames."""

from __future__ import annotations

from collections.abc import Callable

from .. import expr as E
from ..errors import PlanError
from ..functions.registry import lookup
from ..operators.frame import StreamFrame
from .parser import Select, parse_select

Sources = Callable[[str, "str | None"], StreamFrame]


def plan(query: Select, sources: Sources) -> StreamFrame:
    """where filters the input, group by and window aggregate it, having filters the output columns."""
    if query.source.query is not None:
        frame = plan(query.source.query, sources).renamed(query.source.alias)
    else:
        frame = sources(query.source.name, query.source.alias)
    if query.where is not None:
        frame = frame.filter(query.where)
    if query.window is not None:
        frame = frame.aggregate(query.group_by, frame._expand(query.items), query.window, query.watermark)
    elif query.group_by:
        raise PlanError("the window clause is missing.")
    else:
        frame = frame.select(*query.items)
    if query.having is not None:
        if aggregates_in(query.having):
            raise PlanError("having reads output columns; name the aggregate in the select list and use its name")
        frame = frame.filter(query.having)
    return frame


def aggregates_in(e: E.Expr) -> bool:
    if isinstance(e, E.Call) and lookup(e.namespace, e.name).kind == "aggregate":
        return True
    return any(map(aggregates_in, E.children(e)))


def sql(text: str, sources: dict[str, StreamFrame] | Sources) -> StreamFrame:
    """Plans a select over named frames."""
    if isinstance(sources, dict):
        known = {k.lower(): v for k, v in sources.items()}

        def find(name, alias):
            if name.lower() not in known:
                raise PlanError(f"no such source: {name}")
            return known[name.lower()].renamed(alias or name)

        return plan(parse_select(text), find)
    return plan(parse_select(text), sources)
