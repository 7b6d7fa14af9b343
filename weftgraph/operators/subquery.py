"""Optional matches, EXISTS and COUNT subqueries: decorrelated into joins.

A subquery that looks at outer variables only through shared pattern nodes is matched by itself and joined on
their keys, so nothing is computed per outer row. If its WHERE looks at other outer variables, the distinct
values of those are matched along.
"""

from __future__ import annotations

import itertools
from copy import copy
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import syntax as S
from ..plans.compile import Compiler, Typed
from ..plans.lexer import QueryError
from .match import WEIGHT, Matcher, conjuncts, used_properties
from .scope import Bound, Scope

if TYPE_CHECKING:
    from ..session import Session

_fresh = itertools.count()


def pattern_vars(patterns: list[S.Path]) -> set[str]:
    return {x.var for p in patterns for x in (*p.nodes, *p.rels)} | {p.var for p in patterns if p.var}


def names_in(e: S.Expr | None) -> set[str]:
    return {x.name for x in S.walk(e) if isinstance(x, S.Var)} if e is not None else set()


def _labelled(patterns: list[S.Path], scope: Scope) -> list[S.Path]:
    """Shared nodes keep the labels that they have outside."""
    made = []
    for p in patterns:
        p = copy(p)
        p.nodes = [S.NodePattern(n.var, n.labels or (scope.vars[n.var].labels if n.var in scope.vars else []), n.props, n.named) for n in p.nodes]
        made.append(p)
    return made


def where(session: Session, scope: Scope, e: S.Expr | None, params: dict) -> Scope:
    """The scope's rows for which the condition is true; plain EXISTS become semi and anti joins."""
    if e is None:
        return scope
    out = Scope(scope.df, scope.vars)
    rest = []
    for c in conjuncts(e):
        negated = isinstance(c, S.Call) and c.name == "NOT"
        sub = c.args[0] if negated else c
        if isinstance(sub, S.Subquery) and sub.kind == "EXISTS":
            inner, keys = _inner(session, out, sub, params)
            out.df = _joined(out, inner.select(*[F.col(f"`{k}`") for k in keys]), keys, "left_anti" if negated else "left_semi")
        else:
            rest.append(c)
    if not rest:
        return out
    columns = out.df.columns
    out, replaced = attach(session, out, rest, params)
    compiler = Compiler(session, out, params)
    compiler.replaced = replaced(compiler)
    for c in rest:
        out.df = out.df.where(compiler.condition(c))
    extra = [c for c in out.df.columns if c not in columns]
    return Scope(out.df.drop(*extra) if extra else out.df, scope.vars)


def _inner(session: Session, scope: Scope, sub: S.Subquery, params: dict) -> tuple[DataFrame, list[str]]:
    """The subquery's rows and the columns that tie them to the outer rows."""
    mine = pattern_vars(sub.patterns)
    shared = sorted(v for v in mine if v in scope.vars)
    outer = sorted(v for v in names_in(sub.where) | {n for p in sub.patterns for x in (*p.nodes, *p.rels) for e in x.props.values() for n in names_in(e)} if v in scope.vars and v not in mine)
    used = used_properties([S.Match(sub.patterns, sub.where, False)])
    matcher = Matcher(session, used, params, weigh=True)
    # with two ends or more the outer rows bound the search: alone it would pair all ends of the graph
    if outer or len(shared) > 1 or any(scope.vars[v].kind != "node" for v in shared):
        tied = [c for v in (*shared, *outer) for c in scope.vars[v].columns() if c in scope.df.columns]
        start = Scope(scope.df.select(*[F.col(f"`{c}`") for c in tied]).distinct(), {v: scope.vars[v] for v in (*shared, *outer)})
        found = matcher.match(sub.patterns, start)
        keys = tied
    else:
        found = matcher.match(_labelled(sub.patterns, scope), Scope(None))
        keys = [f"{v}${c}" for v in shared for c in (("_key", "_label") if len(scope.vars[v].labels) > 1 else ("_key",))]
        for v in shared:
            key = scope.df.schema[f"{v}$_key"].dataType
            if found.df.schema[f"{v}$_key"].dataType != key:
                found.df = found.df.withColumn(f"{v}$_key", found.vars[v].col("_key").cast(key))
    return where(session, found, sub.where, params).df, keys


def _joined(scope: Scope, inner: DataFrame, keys: list[str], how: str, more: list[str] = ()) -> DataFrame:
    """The outer rows joined with the inner ones on the keys; `more` names inner columns to keep."""
    tag = next(_fresh)
    renamed = inner.select(*[F.col(f"`{k}`").alias(f"__k{tag}_{i}") for i, k in enumerate(keys)], *more)
    on = None
    for i, k in enumerate(keys):
        plain = k.endswith(("$_key", "$_label"))
        here, there = F.col(f"`{k}`"), F.col(f"__k{tag}_{i}")
        one = here == there if plain else here.eqNullSafe(there)
        on = one if on is None else on & one
    out = scope.df.join(renamed, on if on is not None else F.lit(True), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__k{tag}_{i}" for i in range(len(keys))])


def attach(session: Session, scope: Scope, exprs: list, params: dict):
    """Adds a column for each subquery in the expressions; gives the scope and what stands for them."""
    out = Scope(scope.df, dict(scope.vars))
    found: list[tuple[S.Subquery, str]] = []
    for sub in _outermost(exprs):
        if any(sub == s for s, _ in found):
            continue
        inner, keys = _inner(session, out, sub, params)
        name = f"__q{next(_fresh)}"
        rows = F.coalesce(F.sum(WEIGHT), F.lit(0)) if WEIGHT in inner.columns else F.count(F.lit(1))
        grouped = inner.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(rows.alias(name)) if keys else inner.agg(rows.alias(name))
        out.df = _joined(out, grouped, keys, "left", [name])
        n = F.coalesce(F.col(name), F.lit(0).cast("long"))
        out.df = out.df.withColumn(name, n if sub.kind == "COUNT" else n > 0)
        out.vars[name] = Bound("value", name)
        found.append((sub, name))

    def replaced(c: Compiler) -> list[tuple[S.Expr, Typed]]:
        return [(s, c.typed(F.col(name))) for s, name in found]

    return out, replaced


def _outermost(e) -> list[S.Subquery]:
    if isinstance(e, S.Subquery):
        return [e]
    if isinstance(e, list | tuple):
        return [x for y in e for x in _outermost(y)]
    if isinstance(e, dict):
        return _outermost(list(e.values()))
    if hasattr(e, "__dataclass_fields__"):
        return [x for n in e.__dataclass_fields__ for x in _outermost(getattr(e, n))]
    return []


def optional(session: Session, scope: Scope, clause: S.Match, used: dict, params: dict) -> Scope:
    """A left join; the clause's WHERE belongs to the join, so rows without a match keep NULLs."""
    mine = pattern_vars(clause.patterns)
    shared = sorted(v for v in mine if v in scope.vars)
    if any(scope.vars[v].kind != "node" for v in shared):
        raise QueryError("an optional match shares nodes only")
    matcher = Matcher(session, used, params)
    if scope.df is None:
        scope = Scope(session.spark.range(1).select(F.lit(1).alias("__one")), {})
    inner = matcher.match(_labelled(clause.patterns, scope), Scope(None))
    outer_refs = {v for v in names_in(clause.where) if v in scope.vars and v not in mine}
    inside = [c for c in conjuncts(clause.where) if not names_in(c) & outer_refs]
    across = [c for c in conjuncts(clause.where) if names_in(c) & outer_refs]
    for c in inside:
        inner = where(session, inner, c, params)
    tag = next(_fresh)
    keys, df = [], inner.df
    for v in shared:
        for part in ("_key", "_label"):
            df = df.withColumnRenamed(f"{v}${part}", f"__k{tag}_{len(keys)}")
            keys.append(f"{v}${part}")
        df = df.drop(*[c for c in inner.vars[v].columns() if c in df.columns])
    on = None
    for i, k in enumerate(keys):
        one = F.col(f"`{k}`") == F.col(f"__k{tag}_{i}")
        on = one if on is None else on & one
    merged = dict(scope.vars) | {v: b for v, b in inner.vars.items() if v not in shared}
    if across:
        both = Scope(scope.df.limit(0).crossJoin(df.limit(0)), merged)
        c = Compiler(session, both, params)
        for e in across:
            one = c.condition(e)
            on = one if on is None else on & one
    out = scope.df.join(df, on if on is not None else F.lit(True), "left")
    return Scope(out.drop(*[f"__k{tag}_{i}" for i in range(len(keys))]), merged)
