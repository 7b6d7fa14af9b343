"""Projection, implicit grouping, distinct, order and limits of RETURN and WITH."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from ..plans.compile import AGGREGATES, Compiler, contains_aggregate
from ..plans.lexer import QueryError
from ..plans.types import is_interval, micros_of
from .scope import Bound, Scope
from .subquery import attach, where

if TYPE_CHECKING:
    from ..session import Session

VOLATILE = frozenset(("RANDOM", "GEN_RANDOM_UUID"))


def _items(scope: Scope, body: S.Projection) -> list[tuple[S.Expr, str]]:
    found = []
    for item in body.items:
        if isinstance(item.expr, S.Star):
            if item.expr.of:
                found += [(S.Prop(S.Var(item.expr.of), p), f"{item.expr.of}.{p}") for p in scope.need(item.expr.of).props]
            else:
                names = [v for v in scope.vars if not v.startswith(("_n", "_r", "__"))]
                if not names:
                    raise QueryError("RETURN or WITH * is not allowed when there are no variables in scope.")
                found += [(S.Var(v), v) for v in names]
        else:
            found.append((item.expr, item.alias or _name(item.expr)))
    if len({n for _, n in found}) < len(found):
        raise QueryError("Multiple result columns with the same name are not supported.")
    return found


def _name(e: S.Expr) -> str:
    if isinstance(e, S.Var):
        return e.name
    if isinstance(e, S.Prop) and isinstance(e.of, S.Var):
        return f"{e.of.name}.{e.name}"
    return e.text or "value"


def _aggregates(e) -> list[S.Call]:
    if isinstance(e, S.Call) and e.name in AGGREGATES:
        return [e]
    if isinstance(e, list | tuple):
        return [x for y in e for x in _aggregates(y)]
    if isinstance(e, dict):
        return _aggregates(list(e.values()))
    if hasattr(e, "__dataclass_fields__"):
        return [x for n in e.__dataclass_fields__ for x in _aggregates(getattr(e, n))]
    return []


def _plain_parts(e) -> list[S.Expr]:
    """The largest parts of an aggregating expression that read variables outside of its aggregates."""
    if isinstance(e, S.Call) and e.name in AGGREGATES:
        return []
    if isinstance(e, S.Expr) and not contains_aggregate(e):
        return [e] if any(isinstance(x, S.Var) for x in S.walk(e)) else []
    if isinstance(e, list | tuple):
        return [x for y in e for x in _plain_parts(y)]
    if isinstance(e, dict):
        return _plain_parts(list(e.values()))
    if hasattr(e, "__dataclass_fields__"):
        return [x for n in e.__dataclass_fields__ for x in _plain_parts(getattr(e, n))]
    return []


def project(session: Session, scope: Scope, body: S.Projection, params: dict, final: bool) -> Scope:
    if not final and body.order and body.skip is None and body.limit is None:
        raise QueryError("In WITH clause, ORDER BY must be followed by SKIP or LIMIT.")
    if scope.df is None:
        scope = Scope(session.spark.range(1).select(F.lit(1).alias("__one")), {})
    items = _items(scope, body)
    scope, replaced = attach(session, scope, [e for e, _ in items] + [o for o, _ in body.order], params)
    grouped = any(contains_aggregate(e) for e, _ in items)
    if grouped:
        out = _grouped(session, scope, items, replaced, params, final)
    else:
        c = Compiler(session, scope, params)
        c.replaced = replaced(c)
        out = Scope(None, {})
        columns: list[Column] = []
        for e, name in items:
            _keep(c, e, name, final, out, columns)
        early = body.order and not body.distinct
        if early:
            alias = [(S.Var(n), c.compile(e)) for e, n in items if S.Var(n) != e and n not in scope.vars]
            c.replaced = c.replaced + alias
            keys = [(_sort_key(c, o), down) for o, down in body.order]
            df = scope.df.select(*columns, *[k.alias(f"__o{i}") for i, (k, _) in enumerate(keys)])
            df = df.orderBy(*[_direction(F.col(f"__o{i}"), down) for i, (_, down) in enumerate(keys)])
            out.df = _limited(session, df, body, params).drop(*[f"__o{i}" for i in range(len(keys))])
            return where(session, out, body.where, params)
        out.df = scope.df.select(*columns)
    if body.distinct:
        out.df = out.df.distinct()
    if body.order:
        c = Compiler(session, out, params)
        c.replaced = [(e, c.typed(c.value_of(out.vars[n]))) for e, n in items if n in out.vars] + [(S.Var(n), c.typed(c.value_of(out.vars[n]))) for _, n in items if n in out.vars]
        out.df = out.df.orderBy(*[_direction(_sort_key(c, o), down) for o, down in body.order])
    out.df = _limited(session, out.df, body, params)
    return where(session, out, body.where, params)


def _keep(c: Compiler, e: S.Expr, name: str, final: bool, out: Scope, columns: list[Column]) -> None:
    """One projected item: graph elements keep their columns in WITH and become values in RETURN."""
    b = c.scope.vars.get(e.name) if isinstance(e, S.Var) and e.name not in c.lambdas else None
    if b is not None and b.kind != "value" and not final and not any(e == r for r, _ in c.replaced):
        made = Bound(b.kind, name, b.labels, b.props, b.ends)
        have = set(c.scope.df.columns)
        columns += [F.col(f"`{old}`").alias(new) for old, new in zip(b.columns(), made.columns()) if old in have]
        out.vars[name] = made
        return
    columns.append(c.compile(e).col.alias(name))
    out.vars[name] = Bound("value", name)


def _grouped(session: Session, scope: Scope, items: list[tuple[S.Expr, str]], replaced, params: dict, final: bool) -> Scope:
    c = Compiler(session, scope, params)
    c.replaced = replaced(c)
    calls: list[S.Call] = []
    for e, _ in items:
        for a in _aggregates(e):
            if not any(a == x for x in calls):
                calls.append(a)
    keys: list[Column] = []
    firsts: list[Column] = []
    held = Scope(None, {})
    stands: list[tuple[S.Expr, str]] = []

    def add_key(e: S.Expr, name: str) -> None:
        b = scope.vars.get(e.name) if isinstance(e, S.Var) else None
        if b is not None and b.kind in ("node", "rel"):
            made = Bound(b.kind, name, b.labels, b.props, b.ends)
            ids = ("_key", "_label") if b.kind == "node" else ("_src", "_dst", "_label", "_rid", "_slabel", "_dlabel")
            have = set(scope.df.columns)
            for old, new in zip(b.columns(), made.columns()):
                if old in have:
                    part = F.col(f"`{old}`")
                    (keys if old.split("$")[-1] in ids else firsts).append((part if old.split("$")[-1] in ids else F.first(part)).alias(new))
            held.vars[name] = made
        else:
            keys.append(c.compile(e).col.alias(name))
            held.vars[name] = Bound("value", name)
        stands.append((e, name))

    for e, name in items:
        if not contains_aggregate(e):
            add_key(e, name)
    for e, _ in items:
        if contains_aggregate(e):
            for part in _plain_parts(e):
                if not any(part == x for x, _ in stands):
                    add_key(part, f"__g{len(stands)}")
    volatile = [a.args[0] for a in calls if any(isinstance(x, S.Call) and x.name in VOLATILE for x in S.walk(a.args))]
    if volatile:  # Spark aggregates no random values: they are drawn before
        drawn = {f"__v{i}": c.compile(e).col for i, e in enumerate(volatile)}
        scope = Scope(scope.df.withColumns(drawn), scope.vars)
        c = Compiler(session, scope, params)
        c.replaced = [*replaced(c), *((e, c.typed(F.col(v))) for e, v in zip(volatile, drawn))]
    aggregates = [c.aggregate(a).alias(f"__a{i}") for i, a in enumerate(calls)]
    df = scope.df.groupBy(*keys).agg(*aggregates, *firsts) if keys else scope.df.agg(*aggregates)
    held.df = df
    after = Compiler(session, held, params)
    after.replaced = [(a, after.typed(F.col(f"__a{i}"))) for i, a in enumerate(calls)]
    after.replaced += [(e, after.typed(held.vars[n].col())) for e, n in stands if held.vars[n].kind == "value"]
    out = Scope(None, {})
    columns: list[Column] = []
    for e, name in items:
        if contains_aggregate(e):
            columns.append(after.compile(e).col.alias(name))
            out.vars[name] = Bound("value", name)
        else:
            _keep(after, S.Var(name), name, final, out, columns)
    out.df = df.select(*columns)
    return out


def _sort_key(c: Compiler, e: S.Expr) -> Column:
    t = c.compile(e)
    if is_interval(t.type):
        return micros_of(t.col)
    if isinstance(t.type, T.ArrayType | T.MapType | T.StructType):
        raise QueryError("Cannot order by a node, relationship, list, struct, map or union.")
    return t.col


def _direction(c: Column, down: bool) -> Column:
    """NULLs are last ascending and first descending."""
    return c.desc_nulls_first() if down else c.asc_nulls_last()


def _limited(session: Session, df, body: S.Projection, params: dict):
    c = Compiler(session, Scope(df, {}), params)
    for e, use in ((body.skip, "offset"), (body.limit, "limit")):
        if e is not None:
            n = c.constant(e)
            if not isinstance(n, int) or n < 0:
                raise QueryError("The number of rows to skip/limit must be a non-negative integer.")
            df = getattr(df, use)(n)
    return df
