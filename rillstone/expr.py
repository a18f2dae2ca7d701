"""Expressions of the DSL and of the SQL dialect, before they are bound to a schema."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Base of expressions. Operators build expressions; use .eq() and .not_eq() for equality, & | ~ or the methods for logic."""

    def alias(self, name: str) -> "Alias":
        return Alias(self, name)

    def _binary(self, op: str, other, swap: bool = False) -> "Binary":
        other = as_expr(other)
        return Binary(op, other, self) if swap else Binary(op, self, other)

    def __add__(self, o):
        return self._binary("+", o)

    def __radd__(self, o):
        return self._binary("+", o, True)

    def __sub__(self, o):
        return self._binary("-", o)

    def __rsub__(self, o):
        return self._binary("-", o, True)

    def __mul__(self, o):
        return self._binary("*", o)

    def __rmul__(self, o):
        return self._binary("*", o, True)

    def __truediv__(self, o):
        return self._binary("/", o)

    def __rtruediv__(self, o):
        return self._binary("/", o, True)

    def __mod__(self, o):
        return self._binary("%", o)

    def __lt__(self, o):
        return self._binary("<", o)

    def __le__(self, o):
        return self._binary("<=", o)

    def __gt__(self, o):
        return self._binary(">", o)

    def __ge__(self, o):
        return self._binary(">=", o)

    def __and__(self, o):
        return self._binary("and", o)

    def __or__(self, o):
        return self._binary("or", o)

    def __neg__(self):
        return Unary("-", self)

    def __invert__(self):
        return Unary("not", self)

    def eq(self, o):
        return self._binary("=", o)

    def not_eq(self, o):
        return self._binary("!=", o)

    def lt(self, o):
        return self < o

    def lt_eq(self, o):
        return self <= o

    def gt(self, o):
        return self > o

    def gt_eq(self, o):
        return self >= o

    def and_(self, o):
        return self & o

    def or_(self, o):
        return self | o

    def display(self) -> str:
        raise NotImplementedError

    def output_name(self) -> str:
        return self.display()


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: object

    def display(self) -> str:
        if isinstance(self.value, str):
            return f'"{self.value}"'
        return str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True, eq=False)
class Column(Expr):
    name: str
    qualifier: str | None = None

    def display(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name

    def output_name(self) -> str:
        return self.name


@dataclass(frozen=True, eq=False)
class Wildcard(Expr):
    qualifier: str | None = None

    def display(self) -> str:
        return f"{self.qualifier}.*" if self.qualifier else "*"


@dataclass(frozen=True, eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def display(self) -> str:
        return f"({self.left.display()} {self.op} {self.right.display()})"


@dataclass(frozen=True, eq=False)
class Unary(Expr):
    op: str
    child: Expr

    def display(self) -> str:
        return f"{self.op} {self.child.display()}"


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple
    namespace: str | None = None

    def display(self) -> str:
        space = f"{self.namespace}." if self.namespace else ""
        return f"{space}{self.name}({','.join(a.display() for a in self.args)})"


@dataclass(frozen=True, eq=False)
class Alias(Expr):
    child: Expr
    name: str

    def display(self) -> str:
        return f"{self.child.display()} as {self.name}"

    def output_name(self) -> str:
        return self.name


def as_expr(x) -> Expr:
    return x if isinstance(x, Expr) else Literal(x)


def value(x) -> Literal:
    return Literal(x)


def col(name: str) -> Column:
    return Column(name)


def qualified_col(qualifier: str, name: str) -> Column:
    return Column(name, qualifier)


def wildcard() -> Wildcard:
    return Wildcard()


def wildcard_with_table(qualifier: str) -> Wildcard:
    return Wildcard(qualifier)


def call(name: str, *args) -> Call:
    return Call(name, tuple(map(as_expr, args)))


def call_with_namespace(namespace: str, name: str, *args) -> Call:
    return Call(name, tuple(map(as_expr, args)), namespace)


def children(e: Expr) -> tuple:
    if isinstance(e, Binary):
        return (e.left, e.right)
    if isinstance(e, Unary | Alias):
        return (e.child,)
    return e.args if isinstance(e, Call) else ()
