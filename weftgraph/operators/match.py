"""Pattern matching: query graphs to joins.

Labels are narrowed by the ends of the relationships first. Then the pattern is walked from what is bound, or
from the most selective node: each relationship is one equi-join on the key of its bound end, and its other end
is joined only if something of it other than its key is asked for (its key is on the relationship already).
In a cycle, relationships that a new node has at most one of are followed from that node and not towards it; where
they end at bound nodes they are joined to the node's way in first, so that both ends are keys of one join.
Join order beyond that, pushdown and strategy are Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from ..plans.compile import AGGREGATES, Compiler, node_struct, rel_struct
from ..plans.lexer import QueryError
from ..plans.types import cast
from .recursive import Spec, traverse
from .scope import Bound, Scope, super_type

if TYPE_CHECKING:
    from ..session import Session

WHOLE = "*"


@dataclass
class NodeSpec:
    var: str
    labels: set[str]
    props: dict[str, S.Expr] = field(default_factory=dict)


@dataclass
class EdgeSpec:
    var: str
    a: str
    b: str
    direction: str
    pattern: S.RelPattern
    tables: list[str] = field(default_factory=list)


def used_properties(clauses: list) -> dict[str, set[str]]:
    """What each variable is used for: property names, WHOLE, or "=" where its id or label will do."""
    found: dict[str, set[str]] = {}

    def visit(e) -> None:
        if isinstance(e, S.Prop) and isinstance(e.of, S.Prop):
            inner = e.of
            while isinstance(inner, S.Prop):
                inner = inner.of
            visit(inner)  # a nested property: of whatever the variable holds
        elif isinstance(e, S.Prop) and isinstance(e.of, S.Var):
            found.setdefault(e.of.name, set()).add(e.name)
        elif isinstance(e, S.Var):
            found.setdefault(e.name, set()).add(WHOLE)
        elif isinstance(e, S.Star):
            found.setdefault(e.of or WHOLE, set()).add(WHOLE)
        elif isinstance(e, S.Call) and e.name in ("ID", "LABEL", "LABELS", "COUNT", "LENGTH", "COST", "IS NULL", "IS NOT NULL") and len(e.args) == 1 and isinstance(e.args[0], S.Var):
            found.setdefault(e.args[0].name, set()).add("=")
        elif isinstance(e, S.Call) and e.name in ("=", "<>") and all(isinstance(a, S.Var) for a in e.args):
            for a in e.args:
                found.setdefault(a.name, set()).add("=")
        elif isinstance(e, S.With):
            for i in e.body.items:
                if isinstance(i.expr, S.Var):
                    found.setdefault(i.expr.name, set())
                    if i.alias and i.alias != i.expr.name:
                        aliases.append((i.alias, i.expr.name))
                else:
                    visit(i.expr)
            for x in (e.body.order, e.body.skip, e.body.limit, e.body.where):
                visit(x)
        elif isinstance(e, S.Subquery):
            for x in (x for p in e.patterns for x in (*p.nodes, *p.rels)):
                found.setdefault(x.var, set()).add("=")  # what a subquery shares can't be folded away
            visit(e.patterns)
            visit(e.where)
        elif isinstance(e, S.Path):
            if e.var:
                paths.append(e)
            for x in (*e.nodes, *e.rels):
                found.setdefault(x.var, set())
                visit(list(x.props.values()))
                if isinstance(x, S.RelPattern) and x.recursion and x.recursion.where is not None:
                    visit(x.recursion.where)
        elif isinstance(e, list | tuple):
            for x in e:
                visit(x)
        elif isinstance(e, dict):
            visit(list(e.values()))
        elif hasattr(e, "__dataclass_fields__"):
            for name in e.__dataclass_fields__:
                visit(getattr(e, name))

    aliases: list[tuple[str, str]] = []
    paths: list[S.Path] = []
    visit(clauses)
    for alias, name in reversed(aliases):
        found[name] |= found.get(alias, set())
    for p in paths:
        if found.get(p.var) or WHOLE in found.get(WHOLE, ()):
            for x in (*p.nodes, *p.rels):
                found[x.var].add(WHOLE)
    return found


#: Rows of a folded match stand for so many matches.
WEIGHT = "__weight"


def only_counts(clauses: list) -> bool:
    """Whether a query is one MATCH whose RETURN doesn't look at single rows beyond counting them, so that matches may
    be counted without being made: rows may stand for several matches where only these aggregates are asked for."""
    if len(clauses) != 2 or not isinstance(clauses[0], S.Match) or clauses[0].optional or not isinstance(clauses[1], S.Return):
        return False
    calls = [x for i in clauses[1].body.items for x in S.walk(i.expr) if isinstance(x, S.Call) and x.name in AGGREGATES]
    by_weight = lambda c: c.distinct or c.name in ("COUNT_STAR", "COUNT", "MIN", "MAX")
    return bool(calls) and all(by_weight(c) for c in calls) and not any(isinstance(x, S.Star) for x in S.walk(clauses[1]))


class Matcher:
    def __init__(self, session: Session, used: dict[str, set[str]], params: dict, fold: bool = False, weigh: bool = False, where: S.Expr | None = None):
        """`fold`: branches may become weights; `weigh`: walks may; `where`: the condition to come, for the join order."""
        self.session, self.catalog, self.used, self.params, self.fold, self.weigh = session, session.catalog, used, params, fold, weigh or fold
        self.tests = [({x.name for x in S.walk(t) if isinstance(x, S.Var)}, t) for t in _conjuncts(where)]

    # --- frames
    def node_bound(self, var: str, labels: set[str]) -> Bound:
        tables = [self.catalog.nodes[n] for n in sorted(labels, key=lambda n: self.catalog.nodes[n].number)]
        props: dict[str, list[T.DataType]] = {}
        for t in tables:
            for p, kind in t.props.items():
                props.setdefault(p, []).append(kind)
        return Bound("node", var, [t.name for t in tables], {p: super_type(k) for p, k in props.items()})

    def key_type(self, labels) -> T.DataType:
        return super_type([self.catalog.nodes[n].props[self.catalog.nodes[n].key] for n in labels])

    def node_frame(self, b: Bound, renamed: str = "") -> DataFrame:
        key = self.key_type(b.labels)
        name = renamed or b.name
        out = None
        for label in b.labels:
            t = self.catalog.nodes[label]
            df = self.session.node_rows(label)
            cols = [df[t.key].cast(key).alias(f"{name}$_key"), F.lit(label).alias(f"{name}$_label")]
            for p, want in b.props.items():
                have = t.props.get(p)
                cols.append((F.lit(None).cast(want) if have is None else df[p] if have == want else cast(df[p], have, want)).alias(f"{name}${p}"))
            part = df.select(*cols)
            out = part if out is None else out.unionByName(part)
        return out

    def rel_bound(self, e: EdgeSpec) -> Bound:
        tables = [self.catalog.rels[t] for t in e.tables]
        props: dict[str, list[T.DataType]] = {}
        for t in tables:
            for p, kind in t.props.items():
                props.setdefault(p, []).append(kind)
        ends = (e.b, e.a) if e.direction == "<-" else (e.a, e.b)
        return Bound("rel", e.var, list(e.tables), {p: super_type(k) for p, k in props.items()}, ends if e.direction != "--" else None)

    def pairs(self, e: EdgeSpec, a: set[str], b: set[str]) -> list[tuple[str, tuple[str, str], bool]]:
        """(table, (source, target) labels, reversed) for which the ends fit."""
        found = []
        for t in e.tables:
            for s, d in self.session.rel_pairs(t):
                if e.direction in ("->", "--") and s in a and d in b:
                    found.append((t, (s, d), False))
                if e.direction in ("<-", "--") and d in a and s in b:
                    found.append((t, (s, d), True))
        return found

    def rel_frame(self, e: EdgeSpec, b: Bound, nodes: dict[str, NodeSpec]) -> DataFrame:
        """Columns of the relationship and the helpers _from, _to with their labels as seen along the pattern."""
        left, right = nodes[e.a].labels, nodes[e.b].labels
        kinds = {"from": self.key_type(left), "to": self.key_type(right)}
        v, out = e.var, None
        pairs = self.pairs(e, left, right)
        end_kind = super_type([kinds["from"], kinds["to"]])
        for table, (s, d), back in pairs:
            t = self.catalog.rels[table]
            df = self.session.rel_rows(table, (s, d))
            f, to = ("_dst", "_src") if back else ("_src", "_dst")
            cols = [
                df[f].cast(kinds["from"]).alias(f"{v}$_from"), df[to].cast(kinds["to"]).alias(f"{v}$_to"), F.lit(d if back else s).alias(f"{v}$_flabel"), F.lit(s if back else d).alias(f"{v}$_tlabel"),
                df["_src"].cast(end_kind).alias(f"{v}$_src"), df["_dst"].cast(end_kind).alias(f"{v}$_dst"), F.lit(table).alias(f"{v}$_label"), F.lit(s).alias(f"{v}$_slabel"), F.lit(d).alias(f"{v}$_dlabel"),
                (df["_rid"].cast("long") if "_rid" in df.columns else F.lit(None).cast("long")).alias(f"{v}$_rid"),
            ]
            for p, want in b.props.items():
                have = t.props.get(p)
                cols.append((F.lit(None).cast(want) if have is None else df[p] if have == want else cast(df[p], have, want)).alias(f"{v}${p}"))
            part = df.select(*cols)
            out = part if out is None else out.unionByName(part)
        if out is None:
            schema = [T.StructField(f"{v}${c}", k) for c, k in (("_from", kinds["from"]), ("_to", kinds["to"]), ("_flabel", T.StringType()), ("_tlabel", T.StringType()), ("_src", end_kind), ("_dst", end_kind), ("_label", T.StringType()), ("_slabel", T.StringType()), ("_dlabel", T.StringType()), ("_rid", T.LongType()))]
            out = self.session.spark.createDataFrame([], T.StructType([*schema, *[T.StructField(f"{v}${p}", k) for p, k in b.props.items()]]))
        return out

    # --- the query graph
    def graph(self, patterns: list[S.Path], scope: Scope) -> tuple[dict[str, NodeSpec], list[EdgeSpec]]:
        nodes: dict[str, NodeSpec] = {}
        edges: list[EdgeSpec] = []
        every = set(self.session.node_labels())
        for path in patterns:
            for n in path.nodes:
                for label in n.labels:
                    if label not in every:
                        raise QueryError(f"Table {label} does not exist.")
                labels = set(n.labels or every)
                if n.var in scope.vars:
                    if scope.vars[n.var].kind != "node":
                        raise QueryError(f"{n.var} is no node.")
                    labels &= set(scope.vars[n.var].labels)
                spec = nodes.setdefault(n.var, NodeSpec(n.var, labels))
                spec.labels &= labels
                spec.props |= {} if self.session.follower else n.props
            for k, r in enumerate(path.rels):
                for t in r.types:
                    if t not in self.session.rel_names():
                        raise QueryError(f"Table {t} does not exist.")
                if any(e.var == r.var for e in edges):
                    raise QueryError(f"Bind relationship {r.var} to relationship with same name is not supported.")
                if self.session.follower and r.direction != "->":
                    raise QueryError("only right-directed relationships are supported")
                edges.append(EdgeSpec(r.var, path.nodes[k].var, path.nodes[k + 1].var, r.direction, r, list(r.types) or list(self.session.rel_names())))
        changed = True
        while changed:
            changed = False
            for e in edges:
                if e.pattern.recursion:
                    continue
                fit = self.pairs(e, nodes[e.a].labels, nodes[e.b].labels)
                a = {(d if back else s) for _, (s, d), back in fit}
                b = {(s if back else d) for _, (s, d), back in fit}
                if fit and (nodes[e.a].labels - a or nodes[e.b].labels - b):
                    nodes[e.a].labels &= a
                    nodes[e.b].labels &= b
                    changed = True
                e.tables = [t for t in e.tables if any(t == x for x, _, _ in fit)] or e.tables
        return nodes, edges

    def _needs_node(self, spec: NodeSpec, labels_sure: bool) -> bool:
        keys = {self.catalog.nodes[n].key for n in spec.labels}
        wanted = self.used.get(spec.var, set()) - {"="}
        return not labels_sure or bool(wanted - (keys if len(keys) == 1 else set())) or bool(set(spec.props) - (keys if len(keys) == 1 else set()))

    # --- matching
    def match(self, patterns: list[S.Path], scope: Scope, hint: list | None = None) -> Scope:
        """The scope joined with all matches of the patterns; their WHERE is the caller's."""
        nodes, edges = self.graph(patterns, scope)
        out = Scope(scope.df, dict(scope.vars))
        left = list(edges)
        folded = self._fold(nodes, left, scope) if self.fold and not hint and not any(p.var for p in patterns) else {}
        gone = {b for pairs in folded.values() for _, b in pairs}
        todo = [n for n in nodes if n not in scope.vars and n not in gone]
        for n in nodes:
            if n in scope.vars and nodes[n].labels < set(scope.vars[n].labels):
                out.df = out.df.where(out.vars[n].col("_label").isin(sorted(nodes[n].labels)))
            if n in scope.vars and nodes[n].props:
                out.df = out.df.where(self._inline(n, nodes[n].props, out))
        wish = {name: i for i, name in enumerate(_hinted(hint))}
        if unknown := set(wish) - set(nodes) - {e.var for e in edges}:
            raise QueryError(f"Cannot bind {min(unknown)} to a node or relationship of the pattern.")
        turn = lambda e: min(wish.get(x, len(wish)) for x in (e.var, e.a, e.b)) if e.var not in wish else wish[e.var]
        first = turn if wish else lambda e: self._waits(e, left, nodes, out)
        broad = scope.df is None and not wish  # bound rows may be few, and hints give an order
        while left or todo:
            closing = [e for e in left if e.a in out.vars and e.b in out.vars]
            step = min(closing, key=turn, default=None) or min([e for e in left if e.a in out.vars or e.b in out.vars], key=first, default=None)
            if step is None:
                start = min(todo, key=lambda n: (wish.get(n, len(wish)), *self._rank(nodes[n], left)))
                broad = broad and self._rank(nodes[start], left)[0] > 0
                self._start(nodes[start], out)
                todo.remove(start)
                continue
            left.remove(step)
            if step.pattern.recursion:
                self._recur(step, nodes, out)
            else:
                at_once = self._single_ends(step, left, nodes, out) if broad else []
                left = [e for e in left if e not in at_once]
                self._extend(step, nodes, out, at_once)
            todo = [n for n in todo if n not in out.vars]
        for n in [n for n in folded if n in out.vars]:
            for e, b in folded[n]:
                self._weigh(out, n, self._counted(e, n, b, nodes, folded))
        for path in patterns:
            if path.var:
                self._path(path, out)
        return out

    # --- counting without making matches
    def _fold(self, nodes: dict[str, NodeSpec], left: list[EdgeSpec], scope: Scope) -> dict[str, list[tuple[EdgeSpec, str]]]:
        """Takes branches that only multiply the matches out of `left`: node -> (edge, far node) of its branches."""
        folded: dict[str, list[tuple[EdgeSpec, str]]] = {}
        found = True
        while found:
            found = False
            for e in list(left):
                if e.pattern.recursion or e.pattern.props or self.used.get(e.var) or e.a == e.b:
                    continue
                for b, a in ((e.b, e.a), (e.a, e.b)):
                    alone = sum(b in (x.a, x.b) for x in left) == 1
                    if alone and b not in scope.vars and not self.used.get(b) and not nodes[b].props:
                        left.remove(e)
                        folded.setdefault(a, []).append((e, b))
                        found = True
                        break
        return folded

    def _counted(self, e: EdgeSpec, near: str, far: str, nodes: dict[str, NodeSpec], folded: dict) -> DataFrame:
        """(k, l, w): for each near node how many ways there are to match the branch."""
        v = e.var
        frame = self.rel_frame(e, Bound("rel", v, list(e.tables), {}), nodes)
        ends = ("_from", "_flabel"), ("_to", "_tlabel")
        (k, lab), (fk, fl) = ends if near == e.a else ends[::-1]
        frame = frame.select(F.col(f"`{v}${k}`").alias("k"), F.col(f"`{v}${lab}`").alias("l"), F.col(f"`{v}${fk}`").alias("fk"), F.col(f"`{v}${fl}`").alias("fl"), F.lit(1).cast("long").alias("w"))
        for e2, b2 in folded.get(far, []):
            more = self._counted(e2, far, b2, nodes, folded).select(F.col("k").alias("k2"), F.col("l").alias("l2"), F.col("w").alias("w2"))
            frame = frame.join(more, (F.col("fk") == F.col("k2")) & (F.col("fl") == F.col("l2"))).withColumn("w", F.col("w") * F.col("w2")).drop("k2", "l2", "w2")
        return frame.groupBy("k", "l").agg(F.sum("w").alias("w"))

    def _weigh(self, out: Scope, n: str, counts: DataFrame) -> None:
        held = out.vars[n]
        on = held.col("_key") == F.col("k")
        if len(held.labels) > 1:
            on = on & (held.col("_label") == F.col("l"))
        joined = out.df.join(counts, on)
        weight = F.col("w") * F.col(WEIGHT) if WEIGHT in out.df.columns else F.col("w")
        out.df = joined.withColumn(WEIGHT, weight).drop("k", "l", "w")

    def _rank(self, spec: NodeSpec, edges: list[EdgeSpec]) -> tuple[int, int]:
        keys = {self.catalog.nodes[n].key for n in spec.labels}
        own = [t for names, t in self.tests if names == {spec.var} and not any(isinstance(x, S.Subquery) for x in S.walk(t))]
        fixed = any(isinstance(t, S.Call) and t.name == "=" and any(a == S.Prop(S.Var(spec.var), k) for a in t.args for k in keys) for t in own)
        selective = 0 if fixed or set(spec.props) & keys else 1 if own or spec.props else 2 if any(spec.var in (e.a, e.b) for e in edges) else 3
        return selective, len(spec.labels)

    def _inline(self, var: str, props: dict[str, S.Expr], scope: Scope) -> Column:
        c = Compiler(self.session, scope, self.params)
        out = None
        for k, e in props.items():
            one = c.condition(S.Call("=", [S.Prop(S.Var(var), k), e]))
            out = one if out is None else out & one
        return out

    def _single(self, e: EdgeSpec, n: str, nodes: dict[str, NodeSpec]) -> bool:
        """Whether a node of the variable has one such relationship at most, by the table's multiplicity."""
        fit = [] if e.pattern.recursion or e.a == e.b else self.pairs(e, nodes[e.a].labels, nodes[e.b].labels)
        if len(fit) != 1:
            return False
        table, _, back = fit[0]
        return self.catalog.rels[table].multiplicity in ("ONE_ONE", "MANY_ONE" if (n == e.a) != back else "ONE_MANY")

    def _waits(self, e: EdgeSpec, left: list[EdgeSpec], nodes: dict[str, NodeSpec], out: Scope) -> bool:
        """Whether the relationship leads to a node that has one at most, and that others lead to as well."""
        far = e.b if e.a in out.vars else e.a
        if not self._single(e, far, nodes):
            return False
        seen, grown = set(out.vars), True
        while grown:
            more = {n for x in left if x is not e and (x.a in seen or x.b in seen) for n in (x.a, x.b)}
            grown, seen = bool(more - seen), seen | more
        return far in seen

    def _single_ends(self, e: EdgeSpec, left: list[EdgeSpec], nodes: dict[str, NodeSpec], out: Scope) -> list[EdgeSpec]:
        """What the new node at the end of `e` has one of at most and that ends at bound nodes."""
        far = next((n for n in (e.a, e.b) if n not in out.vars), None)
        return [x for x in left if far in (x.a, x.b) and (x.a in out.vars or x.b in out.vars) and self._single(x, far, nodes)]

    def _start(self, spec: NodeSpec, out: Scope) -> None:
        b = self.node_bound(spec.var, spec.labels)
        df = self.node_frame(b)
        if spec.props:
            alone = Scope(df, {spec.var: b})
            try:
                df = df.where(self._inline(spec.var, spec.props, alone))
            except QueryError:  # it looks at other variables
                out.df, out.vars[spec.var] = df if out.df is None else out.df.crossJoin(df), b
                out.df = out.df.where(self._inline(spec.var, spec.props, out))
                return
        out.df = df if out.df is None else out.df.crossJoin(df)
        out.vars[spec.var] = b

    def _edge(self, e: EdgeSpec, nodes: dict[str, NodeSpec], out: Scope) -> tuple[Bound, DataFrame, Column | None]:
        """The relationship's frame and what joins it to the ends that are bound."""
        b = self.rel_bound(e)
        v = e.var
        frame = self.rel_frame(e, b, nodes)
        if v in out.vars:
            raise QueryError(f"Bind relationship {v} to relationship with same name is not supported.")
        if e.pattern.props:
            frame = frame.where(self._inline(v, e.pattern.props, Scope(frame, {v: b})))
        on = None
        for n, key, label in _ends(e):
            if n in out.vars:
                held = out.vars[n]
                one = held.col("_key") == F.col(f"`{v}${key}`")
                if len(held.labels) > 1 or len({p[1][0 if key == "_from" else 1] for p in self.pairs(e, nodes[e.a].labels, nodes[e.b].labels)}) > 1:
                    one = one & (held.col("_label") == F.col(f"`{v}${label}`"))
                on = one if on is None else on & one
        return b, frame, on

    def _extend(self, e: EdgeSpec, nodes: dict[str, NodeSpec], out: Scope, at_once: list[EdgeSpec] = ()) -> None:
        """`at_once`: relationships between the new node and bound ones, joined by the same keys' join."""
        v, ends = e.var, _ends(e)
        b, frame, on = self._edge(e, nodes, out)
        more = {}
        for x in at_once:
            more[x.var], other, also = self._edge(x, nodes, out)
            (key, label), (key2, label2) = (next((k, lab) for n, k, lab in _ends(y) if n not in out.vars) for y in (e, x))
            frame = frame.join(other, (F.col(f"`{v}${key}`") == F.col(f"`{x.var}${key2}`")) & (F.col(f"`{v}${label}`") == F.col(f"`{x.var}${label2}`")))
            on = on & also
        joined = out.df.join(frame, on)
        out.vars |= {v: b} | more
        for n, key, label in ends:
            if n not in out.vars:
                spec = nodes[n]
                nb = self.node_bound(n, spec.labels)
                if self._needs_node(spec, True):
                    other = self.node_frame(nb)
                    on = F.col(f"`{v}${key}`") == F.col(f"`{n}$_key`")
                    if len(nb.labels) > 1:
                        on = on & (F.col(f"`{v}${label}`") == F.col(f"`{n}$_label`"))
                    joined = joined.join(other, on)
                else:
                    keys = {self.catalog.nodes[x].key for x in nb.labels}
                    joined = joined.withColumns({f"{n}$_key": F.col(f"`{v}${key}`"), f"{n}$_label": F.col(f"`{v}${label}`")})
                    if len(keys) == 1:
                        joined = joined.withColumn(f"{n}${next(iter(keys))}", F.col(f"`{n}$_key`"))
                        nb.props = {p: t for p, t in nb.props.items() if p in keys}
                    else:
                        nb.props = {}
                out.vars[n] = nb
                out.df = joined
                if spec.props:
                    joined = joined.where(self._inline(n, spec.props, Scope(joined, out.vars)))
        drop = [f"{x}${c}" for x in (v, *more) for c in ("_from", "_to", "_flabel", "_tlabel")]
        out.df = joined.drop(*drop)

    def _recur(self, e: EdgeSpec, nodes: dict[str, NodeSpec], out: Scope) -> None:
        r = e.pattern.recursion
        high = r.high if r.high is not None else self.session.settings["var_length_extend_max_depth"]
        if r.low > high:
            raise QueryError(f"Lower bound of rel {e.var} is greater than upperBound.")
        if high > self.session.settings["var_length_extend_max_depth"]:
            raise QueryError(f"Upper bound of rel {e.var} exceeds maximum: {self.session.settings['var_length_extend_max_depth']}.")
        if "SHORTEST" in r.mode and r.low != 1:
            raise QueryError(f"Lower bound of shortest path {e.var} must be 1.")
        start = e.a if e.a in out.vars else e.b if e.b in out.vars else None
        if start is None:
            raise QueryError("a recursive relationship needs a bound end")
        flip = start == e.b
        direction = {"->": "<-", "<-": "->", "--": "--"}[e.direction] if flip else e.direction
        end = e.a if flip else e.b
        # edges over all labels that the tables join
        labels = set()
        for t in e.tables:
            for s, d in self.session.rel_pairs(t):
                labels |= {s, d}
        many = len(labels) > 1
        probe = EdgeSpec("_e", "_x", "_y", direction, e.pattern, e.tables)
        both = {"_x": NodeSpec("_x", labels), "_y": NodeSpec("_y", labels)}
        rb = self.rel_bound(probe)
        frame = self.rel_frame(probe, rb, both)
        wanted = self.used.get(e.var, set())
        paths = bool(wanted - {"="}) or (WHOLE in self.used.get(WHOLE, ()) and e.pattern.named)
        if e.pattern.props:
            frame = frame.where(self._inline("_e", e.pattern.props, Scope(frame, {"_e": rb})))
        inner = None
        tests = _conjuncts(r.where)
        for test in tests:
            names = {x.name for x in S.walk(test) if isinstance(x, S.Var)}
            if r.rel_var in names and r.node_var in names:
                raise QueryError("a predicate of a recursive relationship looks at the node or at the relationship, not at both")
            if r.rel_var in names or not names:
                c = Compiler(self.session, Scope(frame, {r.rel_var or "_e": _renamed(rb, "_e")}), self.params)
                frame = frame.where(c.condition(test))
        node_tests = [t for t in tests if r.node_var in {x.name for x in S.walk(t) if isinstance(x, S.Var)}]
        ident = lambda label, key: F.struct(label.alias("l"), key.cast("string").alias("k")) if many else key
        if node_tests:
            nb = self.node_bound("_m", labels)
            allowed = self.node_frame(nb)
            c = Compiler(self.session, Scope(allowed, {r.node_var: nb}), self.params)
            for t in node_tests:
                allowed = allowed.where(c.condition(t))
            inner = allowed.select(ident(F.col("`_m$_label`"), F.col("`_m$_key`")).alias("k"))
        cols = [ident(F.col("`_e$_flabel`"), F.col("`_e$_from`")).alias("f"), ident(F.col("`_e$_tlabel`"), F.col("`_e$_to`")).alias("t"), F.struct(F.col("`_e$_label`").alias("l"), F.col("`_e$_rid`").alias("i"), F.col("`_e$_src`").alias("s"), F.col("`_e$_dst`").alias("d")).alias("r")]
        if r.weight:
            if r.weight not in rb.props:
                raise QueryError(f"Cannot find property {r.weight} for {e.var}.")
            if not isinstance(rb.props[r.weight], T.NumericType) or isinstance(rb.props[r.weight], T.DecimalType):
                raise QueryError(f"{r.weight} is no weight: whole numbers and floats are")
            cols.append(F.col(f"`_e${r.weight}`").alias("w"))
        if paths:
            nb = self.node_bound("_m", labels)
            mids = self.node_frame(nb)
            on = F.col("`_e$_to`") == F.col("`_m$_key`")
            frame = frame.join(mids, on & (F.col("`_e$_tlabel`") == F.col("`_m$_label`")) if many else on)
            rb, nb = _only(rb, r.rel_items, r.rel_var), _only(nb, r.node_items, r.node_var)
            cols += [rel_struct(self.session, rb).alias("rel"), node_struct(self.session, nb).alias("mid")]
        edges = frame.select(*cols)
        here = out.vars[start]
        sources = out.df.select(ident(here.col("_label"), here.col("_key")).alias("s")).distinct()
        if not many and set(here.labels) != labels:
            sources = out.df.where(here.col("_label").isin(sorted(labels))).select(here.col("_key").alias("s")).distinct()
        found = traverse(edges, sources, Spec(r.low, high, r.mode, paths, self.weigh), inner)
        v = e.var
        several = [F.col("m").alias(f"{v}$m")] if "m" in found.columns else []
        if paths:
            # the last node of `mids` is the end itself: the relationship's own nodes are those between
            back = (lambda c: F.reverse(c)) if flip else (lambda c: c)
            between = F.slice("mids", F.lit(1), F.greatest(F.size("mids") - 1, F.lit(0)))
            path = F.struct(back(between).alias("_NODES"), back(F.col("rels")).alias("_RELS"))
        else:
            path = F.lit(None).cast("string")
        found = found.select(F.col("s").alias(f"{v}$s"), F.col("t").alias(f"{v}$t"), F.col("n").alias(f"{v}$_length"), F.col("cost").alias(f"{v}$_cost"), path.alias(f"{v}$_path"), *several)
        joined = out.df.join(found, ident(here.col("_label"), here.col("_key")) == F.col(f"`{v}$s`"))
        out.vars[v] = Bound("walk", v)
        if end in out.vars:
            there = out.vars[end]
            joined = joined.where(ident(there.col("_label"), there.col("_key")) == F.col(f"`{v}$t`"))
        else:
            nb = self.node_bound(end, nodes[end].labels & labels or nodes[end].labels)
            frame = self.node_frame(nb)
            joined = joined.join(frame, ident(F.col(f"`{end}$_label`"), F.col(f"`{end}$_key`")) == F.col(f"`{v}$t`"))
            out.vars[end] = nb
            if nodes[end].props:
                joined = joined.where(self._inline(end, nodes[end].props, Scope(joined, out.vars)))
        if several:
            joined = joined.withColumn(WEIGHT, F.col(f"`{v}$m`") * F.col(WEIGHT) if WEIGHT in joined.columns else F.col(f"`{v}$m`"))
        out.df = joined.drop(f"{v}$s", f"{v}$t", f"{v}$m")

    def _path(self, path: S.Path, out: Scope) -> None:
        """The path variable: all nodes and relationships in order, brought to one type each."""
        used = self.used.get(path.var, set())
        out.vars[path.var] = Bound("value", path.var)
        if not used and WHOLE not in self.used.get(WHOLE, set()):
            out.df = out.df.withColumn(path.var, F.lit(None).cast("string"))
            return
        c = Compiler(self.session, out, self.params)
        node_parts: list[tuple[Column, T.DataType]] = []
        rel_parts: list[tuple[Column, T.DataType]] = []

        def add(parts: list, col: Column, is_list: bool) -> None:
            t = c.type_of(col)
            parts.append((col if is_list else F.array(col), t if is_list else T.ArrayType(t)))

        for k, n in enumerate(path.nodes):
            if k:
                r = out.vars[path.rels[k - 1].var]
                if r.kind == "walk":
                    add(rel_parts, r.col("_path")["_RELS"], True)
                    add(node_parts, r.col("_path")["_NODES"], True)
                else:
                    add(rel_parts, rel_struct(self.session, r), False)
            add(node_parts, node_struct(self.session, out.vars[n.var]), False)

        def joined(parts: list) -> Column:
            if not parts:
                return F.array().cast("array<string>")
            fields: dict[str, list[T.DataType]] = {}
            for _, t in parts:
                for f in t.elementType.fields:
                    fields.setdefault(f.name, []).append(f.dataType)
            want = {k: _merged(v) for k, v in fields.items()}

            def shaped(col: Column, t: T.ArrayType) -> Column:
                have = {f.name: f.dataType for f in t.elementType.fields}
                return F.transform(col, lambda x: F.struct(*[(x[k].cast(w) if k in have else F.lit(None).cast(w)).alias(k) for k, w in want.items()]))

            return F.concat(*[shaped(col, t) for col, t in parts])

        out.df = out.df.withColumn(path.var, F.struct(joined(node_parts).alias("_NODES"), joined(rel_parts).alias("_RELS")))


def _ends(e: EdgeSpec) -> list[tuple[str, str, str]]:
    return [(e.a, "_from", "_flabel"), (e.b, "_to", "_tlabel")]


def _hinted(hint) -> list[str]:
    """The variables of a join hint in the order in which they are written: joins are made in that order."""
    if hint is None:
        return []
    if isinstance(hint, str):
        return [hint]
    return [*_hinted(hint[0]), *_hinted(hint[2])]


def _merged(kinds: list[T.DataType]) -> T.DataType:
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.StructType) for k in kinds):
        return T.StructType([T.StructField(f.name, _merged([k[f.name].dataType for k in kinds if f.name in k.fieldNames()])) for f in kinds[0].fields])
    return super_type(kinds)


def _only(b: Bound, items: list[S.Item] | None, var: str | None) -> Bound:
    """The element with the properties that the recursive pattern projects, all of them if it projects none."""
    if items is None:
        return b
    names = [i.expr.name for i in items if isinstance(i.expr, S.Prop) and isinstance(i.expr.of, S.Var) and i.expr.of.name == var]
    if len(names) < len(items) or set(names) - set(b.props):
        raise QueryError("a recursive pattern projects properties of its own variables")
    return Bound(b.kind, b.name, b.labels, {n: b.props[n] for n in names}, b.ends)


def _renamed(b: Bound, column: str) -> Bound:
    return Bound(b.kind, column, b.labels, b.props, b.ends)


def _conjuncts(e: S.Expr | None) -> list[S.Expr]:
    if e is None:
        return []
    if isinstance(e, S.Call) and e.name == "AND":
        return [x for a in e.args for x in _conjuncts(a)]
    return [e]


conjuncts = _conjuncts
