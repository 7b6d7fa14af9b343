"""Where the scalar functions are registered: name to a builder of Spark columns.

A builder gets values with a column `c` and its type `t` and gives a column. Everything is built from Spark's own
functions, so it stays inside generated code; the two exceptions are marked where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass
class Value:
    c: Column
    t: T.DataType
    constant: object = None  # the value of a literal


@dataclass
class Function:
    name: str
    build: Callable[..., Column]
    signature: str
    least: int
    most: int | None
    kind: str = "SCALAR"
    aliases: tuple[str, ...] = field(default=())


FUNCTIONS: dict[str, Function] = {}


def function(names: str, signature: str = "", least: int = 1, most: int | None = -1):
    """Registers a builder under its first name and the others as aliases; `most` None takes any number."""

    def keep(build: Callable[..., Column]) -> Callable[..., Column]:
        first, *rest = names.split()
        f = Function(first, build, signature, least, least if most == -1 else most, aliases=tuple(rest))
        for n in (first, *rest):
            FUNCTIONS[n] = f
        return build

    return keep


def simple(names: str, build: Callable[..., Column], signature: str = "", least: int = 1, most: int | None = -1) -> None:
    """Registers a builder that only looks at the columns."""
    function(names, signature, least, most)(lambda *a: build(*[x.c for x in a]))
