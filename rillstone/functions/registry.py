"""Function table: signatures, return types and how each function becomes Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import PlanError
from ..types import can_widen


@dataclass(frozen=True)
class Signature:
    """kind: exact, uniform, variadic, variadic_equal, any, one_of."""

    kind: str
    types: tuple = ()
    count: int = 0

    def match(self, args: tuple[str, ...]) -> tuple[str, ...] | None:
        """The types the arguments are cast to; None if they don't fit. Exact matches win over widening."""
        if not args:
            return None
        return self._match(args, lambda a, b: a == b) or self._match(args, can_widen)

    def _match(self, args, fits: Callable[[str, str], bool]) -> tuple[str, ...] | None:
        if self.kind == "any":
            return args if len(args) == self.count else None
        if self.kind == "exact":
            return self.types if len(args) == len(self.types) and all(map(fits, args, self.types)) else None
        if self.kind in ("uniform", "variadic"):
            if self.kind == "uniform" and len(args) != self.count:
                return None
            return next(((t,) * len(args) for t in self.types if all(fits(a, t) for a in args)), None)
        if self.kind == "variadic_equal":
            first = next((a for a in args if a != "null"), args[0])
            return (first,) * len(args) if all(fits(a, first) for a in args) else None
        return next((m for s in self.types if (m := s._match(args, fits))), None)


def exact(*types: str) -> Signature:
    return Signature("exact", types)


def uniform(count: int, *types: str) -> Signature:
    return Signature("uniform", types, count)


def variadic(*types: str) -> Signature:
    return Signature("variadic", types)


def variadic_equal() -> Signature:
    return Signature("variadic_equal")


def anything(count: int) -> Signature:
    return Signature("any", (), count)


def one_of(*signatures: Signature) -> Signature:
    return Signature("one_of", signatures)


@dataclass(frozen=True)
class Function:
    """kind ``scalar``: build(*columns); ``aggregate``: grouped(column, seq) and running(column, window);
    ``series``: running(SeriesWindow, *arguments); ``recurrence``: stepped from row to row, see stepping.STEPS."""

    name: str
    signature: Signature
    returns: Callable[[tuple], str] | str
    kind: str = "scalar"
    namespace: str | None = None
    build: Callable | None = None
    grouped: Callable | None = None
    running: Callable | None = None
    constants: tuple = field(default=())  # positions of arguments that must be literals

    def return_type(self, args: tuple[str, ...]) -> str:
        return self.returns if isinstance(self.returns, str) else self.returns(args)

    def bind(self, args: tuple[str, ...]) -> tuple[str, ...]:
        if (m := self.signature.match(args)) is None:
            raise PlanError(f"misuse function: {self.name}")
        return m


_functions: dict[tuple[str | None, str], Function] = {}


def register(f: Function) -> Function:
    """Adds a function, also one of the user's: ``register(Function("twice", exact("float64"), "float64", build=lambda types, x: x * 2))``."""
    _functions[f.namespace and f.namespace.lower(), f.name.lower()] = f
    return f


def unregister(namespace: str | None, name: str) -> None:
    _functions.pop((namespace and namespace.lower(), name.lower()), None)


def lookup(namespace: str | None, name: str) -> Function:
    """Names and namespaces are case-insensitive."""
    load()
    f = _functions.get((namespace and namespace.lower(), name.lower()))
    if f is None:
        raise PlanError(f"no such function: {f'{namespace}.' if namespace else ''}{name}")
    return f


def all_functions() -> list[Function]:
    load()
    return list(_functions.values())


def load() -> None:
    """Fills the table; the modules register what they define."""
    from . import aggregate, math, nulls, series_logic, series_ref, series_stat, strings, time  # noqa: F401
