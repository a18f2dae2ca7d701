"""Statements of the SQL dialect by recursive descent, expressions by precedence climbing.

Keywords are case-insensitive and only special where the grammar wants them. Logic binds weaker than comparison, ``not``
weaker than comparison but stronger than ``and``; unary minus binds strongest. Durations take a unit (ms, s, m, h, d or
their long names) and are milliseconds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .. import expr as E
from ..errors import ParseError
from ..operators.window import PERIODS, Window
from .lexer import Token, tokens

#: Units of durations in milliseconds.
UNITS = {
    "ms": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1000, "sec": 1000, "second": 1000, "seconds": 1000,
    "m": 60_000, "min": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
    "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
}
TYPES = ("int8", "int16", "int32", "int64", "float32", "float64", "boolean", "string", "timestamp")
LEVELS = ({"or"}, {"and"}, {"=", "!=", "<>", "<", "<=", ">", ">="}, {"+", "-"}, {"*", "/", "%"})


@dataclass
class Source:
    """A name or a nested select, with its alias."""

    name: str | None = None
    query: "Select | None" = None
    alias: str | None = None


@dataclass
class Select:
    items: list
    source: Source
    where: E.Expr | None = None
    group_by: list = field(default_factory=list)
    having: E.Expr | None = None
    window: Window | None = None
    watermark: E.Expr | None = None


@dataclass
class CreateSource:
    name: str
    columns: list[tuple[str, str, str | None]]  # name, type, zone
    uri: str
    time: E.Expr | None = None
    time_text: str | None = None
    order: str | None = None  # the column that gives the arrival order


@dataclass
class CreateStream:
    name: str
    query: Select
    text: str
    sink: str


@dataclass
class CreateSink:
    name: str
    uri: str
    format: str | None = None


@dataclass
class Delete:
    kind: str
    name: str


@dataclass
class Start:
    name: str
    restart: bool = False
    once: bool = False  # to the end of what is there


@dataclass
class Stop:
    name: str


@dataclass
class Show:
    kind: str


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    # -- tokens ------------------------------------------------------------------------------------------------------

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        found = self.here.text or "the end"
        raise ParseError(f"expected {wanted} at {self.here.at}, found {found!r}")

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind == "name" and t.text.lower() in words

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            self.at += 1
            return self.tokens[self.at - 1].text.lower()
        return None

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def op(self, *ops: str) -> str | None:
        if self.here.kind == "op" and self.here.text in ops:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need_op(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    def name(self) -> str:
        if self.here.kind not in ("name", "string"):
            self.fail("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    def string(self) -> str:
        if self.here.kind != "string":
            self.fail("a string")
        self.at += 1
        return self.tokens[self.at - 1].text

    def end(self) -> None:
        self.op(";")
        if self.here.kind != "end":
            self.fail("the end of the statement")

    # -- expressions -------------------------------------------------------------------------------------------------

    def expr(self, level: int = 0) -> E.Expr:
        if level == len(LEVELS):
            return self.unary()
        if level == 2 and self.is_word("not") and not (self.tokens[self.at + 1].kind == "op" and self.tokens[self.at + 1].text in ".,)="):
            self.at += 1
            return E.Unary("not", self.expr(2))
        left = self.expr(level + 1)
        while True:
            found = self.word(*LEVELS[level]) if level < 2 else self.op(*LEVELS[level])
            if not found:
                return left
            left = E.Binary("!=" if found == "<>" else found, left, self.expr(level + 1))

    def unary(self) -> E.Expr:
        if self.op("-"):
            return E.Unary("-", self.unary())
        if self.word("not"):
            return E.Unary("not", self.unary())
        return self.primary()

    def primary(self) -> E.Expr:
        t = self.here
        if self.op("("):
            e = self.expr()
            self.need_op(")")
            return e
        if t.kind == "number":
            return self.number()
        if self.op("*"):
            return E.Wildcard()
        nxt = self.tokens[self.at + 1] if t.kind != "end" else t
        called = nxt.kind == "op" and nxt.text == "("
        dotted = nxt.kind == "op" and nxt.text == "."
        if t.kind == "string" and not called and not dotted:
            self.at += 1
            return E.Literal(t.text)
        if t.kind == "name" and not called and not dotted and t.text.lower() in ("true", "false"):
            self.at += 1
            return E.Literal(t.text.lower() == "true")
        if t.kind not in ("name", "string"):
            self.fail("an expression")
        first = self.name()
        if self.op("("):
            return E.Call(first, self.arguments())
        if self.op("."):
            if self.op("*"):
                return E.Wildcard(first)
            second = self.name()
            if self.op("("):
                return E.Call(second, self.arguments(), first)
            return E.Column(second, first)
        return E.Column(first)

    def arguments(self) -> tuple:
        out = []
        if not self.op(")"):
            out.append(self.expr())
            while self.op(","):
                out.append(self.expr())
            self.need_op(")")
        return tuple(out)

    def number(self) -> E.Literal:
        t = self.here
        self.at += 1
        is_float = any(c in t.text for c in ".eE")
        if self.here.kind == "name" and self.here.text.lower() in UNITS and not self.is_word("as"):
            if is_float:
                self.fail("a whole number of time units")
            return E.Literal(int(t.text) * UNITS[self.word(*UNITS)])
        return E.Literal(float(t.text) if is_float else int(t.text))

    def duration(self) -> int:
        if self.here.kind != "number":
            self.fail("a duration")
        if self.tokens[self.at + 1].text.lower() not in UNITS:
            self.at += 1
            self.fail("a time unit")
        return self.number().value

    # -- select ------------------------------------------------------------------------------------------------------

    def select(self) -> Select:
        self.need_word("select")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        self.need_word("from")
        out = Select(items, self.source())
        if self.word("where"):
            out.where = self.expr()
        if self.word("group"):
            self.need_word("by")
            out.group_by = [self.expr()]
            while self.op(","):
                out.group_by.append(self.expr())
        while self.is_word("having", "window"):
            if self.word("having"):
                if out.having is not None:
                    self.fail("one having clause")
                out.having = self.expr()
            else:
                if out.window is not None:
                    self.fail("one window clause")
                self.at += 1
                out.window = self.window()
                if self.word("watermark"):
                    self.need_word("by")
                    out.watermark = self.expr()
        return out

    def item(self) -> E.Expr:
        e = self.expr()
        return E.Alias(e, self.name()) if self.word("as") else e

    def source(self) -> Source:
        if self.op("("):
            out = Source(query=self.select())
            self.need_op(")")
        else:
            out = Source(name=self.name())
        if self.word("as"):
            out.alias = self.name()
        return out

    def window(self) -> Window:
        kind = self.need_word("fixed", "sliding", *PERIODS)
        if kind in PERIODS:
            zone = "UTC"
            if self.op("("):
                zone = self.string()
                self.need_op(")")
            return Window.period(kind, zone)
        self.need_op("(")
        length = self.duration()
        if kind == "fixed":
            self.need_op(")")
            return Window.fixed(length)
        self.need_op(",")
        interval = self.duration()
        self.need_op(")")
        return Window.sliding(length, interval)

    # -- statements --------------------------------------------------------------------------------------------------

    def statement(self):
        if self.is_word("select"):
            out = self.select()
        elif self.word("create"):
            out = self.create()
        elif self.word("delete"):
            out = Delete(self.need_word("source", "stream", "sink"), self.name())
        elif verb := self.word("start", "restart"):
            self.need_word("stream")
            out = Start(self.name(), verb == "restart", bool(self.word("once")))
        elif self.word("stop"):
            self.need_word("stream")
            out = Stop(self.name())
        elif self.word("show"):
            out = Show(self.need_word("sources", "streams", "sinks")[:-1])
        else:
            self.fail("a statement")
        self.end()
        return out

    def create(self):
        kind = self.need_word("source", "stream", "sink")
        name = self.name()
        if kind == "source":
            self.need_op("(")
            columns = [self.column()]
            while self.op(","):
                columns.append(self.column())
            self.need_op(")")
            self.need_word("with")
            out = CreateSource(name, columns, self.string())
            if self.word("time"):
                self.need_word("by")
                start = self.here.at
                out.time = self.expr()
                out.time_text = self.text[start : self.here.at].rstrip("; \n\t")
            if self.word("order"):
                self.need_word("by")
                out.order = self.name()
            return out
        self.need_word("with")
        if kind == "sink":
            out = CreateSink(name, self.string())
            if self.word("format"):
                out.format = self.name().lower()
            return out
        start = self.here.at
        query = self.select()
        text = self.text[start : self.here.at].strip()
        self.need_word("to")
        return CreateStream(name, query, text, self.name())

    def column(self) -> tuple[str, str, str | None]:
        name = self.name()
        kind = self.need_word(*TYPES)
        zone = None
        if kind == "timestamp" and self.word("timezone"):
            zone = self.string()
        return name, kind, zone


def parse_statement(text: str):
    return Parser(text).statement()


def parse_select(text: str) -> Select:
    p = Parser(text)
    out = p.select()
    p.end()
    return out


def parse_expr(text: str) -> E.Expr:
    p = Parser(text)
    out = p.expr()
    p.end()
    return out
