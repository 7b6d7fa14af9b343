"""Splits a query text into tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be parsed, bound or run."""


@dataclass
class Token:
    kind: str  # word, quoted, string, int, float, param, op, end
    value: str
    at: int
    end: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<quoted>`[^`]*`)
    |(?P<param>\$\w+)
    |(?P<word>[^\W\d]\w*)
    |(?P<op><>|<=|>=|!=|=~|->|<-|\.\.|<<|>>|::|:=|[-+*/%^=<>()\[\]{},.;:|&!?@])
    """,
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        return chr(int(c[1:], 16)) if len(c) > 1 else _ESCAPES.get(c, c)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "string":
            # \xHH stays as it is: blobs are written so
            value = unescape(re.sub(r"\\(x[0-9A-Fa-f]{2})", r"\\\\\1", value[1:-1]))
        elif kind == "quoted":
            value = value[1:-1]
        elif kind == "param":
            value = value[1:]
        if kind != "space":
            found.append(Token(kind, value, at, m.end()))
        at = m.end()
    return [*found, Token("end", "", len(text), len(text))]
