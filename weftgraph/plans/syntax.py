"""Syntax trees of the query language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Expr:
    """An expression; `text` is what an unaliased projection is called."""

    text: str = ""


@dataclass
class Lit(Expr):
    value: Any


@dataclass
class Param(Expr):
    name: str


@dataclass
class Var(Expr):
    name: str


@dataclass
class Prop(Expr):
    of: Expr
    name: str


@dataclass
class Call(Expr):
    """Functions and operators alike; operators go by their symbol."""

    name: str
    args: list[Expr]
    distinct: bool = False
    named: dict[str, Expr] = field(default_factory=dict)


@dataclass
class Lambda(Expr):
    params: list[str]
    body: Expr


@dataclass
class Case(Expr):
    subject: Expr | None
    whens: list[tuple[Expr, Expr]]
    otherwise: Expr | None


@dataclass
class ListOf(Expr):
    items: list[Expr]


@dataclass
class StructOf(Expr):
    items: dict[str, Expr]


@dataclass
class Index(Expr):
    of: Expr
    at: Expr


@dataclass
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass
class CastTo(Expr):
    of: Expr
    kind: str


@dataclass
class Subquery(Expr):
    """EXISTS { … } or COUNT { … }."""

    kind: str
    patterns: list[Path]
    where: Expr | None


@dataclass
class Star(Expr):
    of: str | None = None


@dataclass
class NodePattern:
    var: str
    labels: list[str]
    props: dict[str, Expr]
    named: bool = True


@dataclass
class Recursion:
    low: int
    high: int | None
    mode: str = "WALK"
    weight: str | None = None
    rel_var: str | None = None
    node_var: str | None = None
    where: Expr | None = None
    rel_items: list | None = None
    node_items: list | None = None


@dataclass
class RelPattern:
    var: str
    types: list[str]
    props: dict[str, Expr]
    direction: str  # "->", "<-" or "--"
    recursion: Recursion | None = None
    named: bool = True


@dataclass
class Path:
    var: str | None
    nodes: list[NodePattern]
    rels: list[RelPattern]


@dataclass
class Item:
    expr: Expr
    alias: str | None


@dataclass
class Projection:
    items: list[Item]
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None


@dataclass
class Match:
    patterns: list[Path]
    where: Expr | None
    optional: bool
    hint: list | None = None


@dataclass
class Unwind:
    expr: Expr
    alias: str


@dataclass
class With:
    body: Projection


@dataclass
class Return:
    body: Projection


@dataclass
class LoadFrom:
    source: Any
    columns: list[tuple[str, str]]
    options: dict[str, Any]
    where: Expr | None


@dataclass
class InCall:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]]
    where: Expr | None


@dataclass
class Create:
    patterns: list[Path]


@dataclass
class Merge:
    pattern: list[Path]
    on_match: list[tuple[Expr, Expr]]
    on_create: list[tuple[Expr, Expr]]


@dataclass
class SetItems:
    items: list[tuple[Expr, Expr]]


@dataclass
class Delete:
    exprs: list[Expr]
    detach: bool


@dataclass
class Query:
    """Single queries joined by UNION or UNION ALL."""

    parts: list[list[Any]]
    union_all: bool = False


@dataclass
class Statement:
    """Anything that isn't a query: `kind` names it, `args` hold its parts."""

    kind: str
    args: dict[str, Any]


def walk(node: Any) -> Iterator[Any]:
    """The node and everything below it."""
    yield node
    if is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, list | tuple):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        for x in node.values():
            yield from walk(x)
