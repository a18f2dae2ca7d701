"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<name>[A-Za-z_@][A-Za-z0-9_]*)
  | (?P<string>'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*")
  | (?P<op><=|>=|<>|!=|[=<>+\-*/%(),.;])
    """,
    re.X | re.S,
)
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}


@dataclass(frozen=True)
class Token:
    """kind: number, name, string, op or end."""

    kind: str
    text: str
    at: int


def _unquote(raw: str) -> str:
    quote, body = raw[0], raw[1:-1]
    return re.sub(rf"\\(.)|{quote}{quote}", lambda m: _ESCAPES.get(m[1], m[1]) if m[1] else quote, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character at {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, _unquote(m[0]) if m.lastgroup == "string" else m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
