"""Expressions to Spark columns, with static types from Spark's own analyser."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import FUNCTIONS, Value
from ..operators.scope import Bound, Scope
from . import syntax as S
from .lexer import QueryError
from .types import cast, common_type, is_integral, is_interval, is_numeric, parse_type

if TYPE_CHECKING:
    from ..session import Session

AGGREGATES = frozenset("COUNT_STAR COUNT SUM AVG MIN MAX COLLECT".split())


class Typed:
    """A column, and a probe of the same type that can be analysed alone (lambda variables can't be)."""

    def __init__(self, col: Column, probe: Column, typer: Callable[[Column], T.DataType], constant: Any = None):
        self.col, self.probe, self.typer, self.constant = col, probe, typer, constant
        self._type: T.DataType | None = None

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.typer(self.probe)
        return self._type


def contains_aggregate(e: Any) -> bool:
    return any(isinstance(x, S.Call) and x.name in AGGREGATES for x in S.walk(e))


class Compiler:
    """Compiles the expressions of one scope."""

    def __init__(self, session: Session, scope: Scope, params: dict[str, Any] | None = None):
        self.session, self.scope, self.params = session, scope, params or {}
        self.lambdas: dict[str, Typed] = {}
        self.replaced: list[tuple[S.Expr, Typed]] = []
        self._typer = None

    # --- types
    def type_of(self, c: Column) -> T.DataType:
        if self._typer is None:
            spark = self.session.spark
            schema = self.scope.df.schema if self.scope.df is not None else T.StructType([])
            self._typer = spark.createDataFrame([], schema) if schema.fields else spark.range(0)
        return self._typer.select(c.alias("x")).schema[0].dataType

    def typed(self, col: Column, probe: Column | None = None, constant: Any = None) -> Typed:
        return Typed(col, col if probe is None else probe, self.type_of, constant)

    def apply(self, build: Callable[..., Column], *args: Typed) -> Typed:
        col = build(*[Value(a.col, a.type, a.constant) for a in args])
        if all(a.probe is a.col for a in args):
            return self.typed(col)
        return self.typed(col, build(*[Value(a.probe, a.type, a.constant) for a in args]))

    # --- entry points
    def column(self, e: S.Expr) -> Column:
        return self.compile(e).col

    def condition(self, e: S.Expr) -> Column:
        t = self.compile(e)
        return t.col if isinstance(t.type, T.BooleanType | T.NullType) else t.col.cast("boolean")

    def constant(self, e: S.Expr) -> Any:
        """The value of a constant expression."""
        if isinstance(e, S.Lit):
            return e.value
        if isinstance(e, S.Param):
            return self.param_value(e.name)
        return self.session.spark.range(1).select(self.column(e).alias("x")).first()[0]

    def param_value(self, name: str) -> Any:
        if name not in self.params:
            raise QueryError(f"Parameter {name} not found.")
        return self.params[name]

    def literal(self, value: Any) -> Typed:
        if isinstance(value, list | tuple):
            return self.list_of([self.literal(v) for v in value])
        if isinstance(value, dict):
            parts = {k: self.literal(v) for k, v in value.items()}
            return self.typed(F.struct(*[v.col.alias(k) for k, v in parts.items()]))
        if isinstance(value, int) and not isinstance(value, bool):
            if not -(1 << 63) <= value < 1 << 63:
                return self.typed(F.lit(str(value)).cast("decimal(38,0)"), constant=value)
            return self.typed(F.lit(value).cast("long"), constant=value)
        return self.typed(F.lit(value), constant=value)

    def compile(self, e: S.Expr) -> Typed:
        for pattern, given in self.replaced:
            if e == pattern:
                return given
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    # --- leaves
    def _lit(self, e: S.Lit) -> Typed:
        return self.literal(e.value)

    def _var(self, e: S.Var) -> Typed:
        if e.name in self.lambdas:
            return self.lambdas[e.name]
        return self.typed(self.value_of(self.scope.need(e.name)))

    def value_of(self, b: Bound) -> Column:
        if b.kind == "node":
            return node_struct(self.session, b)
        if b.kind == "rel":
            return rel_struct(self.session, b)
        return b.col("_path") if b.kind == "walk" else b.col()

    def _prop(self, e: S.Prop) -> Typed:
        if isinstance(e.of, S.Var) and e.of.name not in self.lambdas:
            b = self.scope.need(e.of.name)
            if b.kind in ("node", "rel"):
                if e.name in b.props:
                    return self.typed(b.col(e.name))
                if e.name == "_label":
                    return self.typed(b.col("_label"))
                if self.session.follower:
                    return self.typed(F.lit(None))
                raise QueryError(f"Cannot find property {e.name} for {e.of.name}.")
        if self.session.follower and (meta := _meta_name(e)):
            return self._prop(S.Prop(S.Var(meta[0]), meta[1]))
        of = self.compile(e.of)
        if isinstance(of.type, T.MapType):
            return self.apply(lambda m: F.element_at(m.c, F.lit(e.name)), of)
        if not isinstance(of.type, T.StructType):
            raise QueryError(f"{e.name} is taken of something that isn't a struct")
        found = next((f for f in of.type.fieldNames() if f.lower() == e.name.lower()), None)
        if found is None:
            raise QueryError(f"Cannot find property {e.name}.")
        return self.apply(lambda s: s.c[found], of)

    def list_of(self, items: list[Typed]) -> Typed:
        if not items:
            return self.typed(F.array().cast("array<string>"))
        want = common_type([i.type for i in items])
        cols = [(i.col if i.type == want else cast(i.col, i.type, want)) if want and not isinstance(i.type, T.NullType) else i.col for i in items]
        probes = [(i.probe if i.type == want else cast(i.probe, i.type, want)) if want and not isinstance(i.type, T.NullType) else i.probe for i in items]
        return self.typed(F.array(*cols), F.array(*probes))

    def _listof(self, e: S.ListOf) -> Typed:
        return self.list_of([self.compile(x) for x in e.items])

    def _structof(self, e: S.StructOf) -> Typed:
        parts = {k: self.compile(v) for k, v in e.items.items()}
        return self.typed(F.struct(*[v.col.alias(k) for k, v in parts.items()]), F.struct(*[v.probe.alias(k) for k, v in parts.items()]))

    def _index(self, e: S.Index) -> Typed:
        return self.apply(FUNCTIONS["LIST_EXTRACT"].build, self.compile(e.of), self.compile(e.at))

    def _slice(self, e: S.Slice) -> Typed:
        low = self.compile(e.low) if e.low is not None else self.literal(1)
        high = self.compile(e.high) if e.high is not None else self.literal(-1)
        return self.apply(FUNCTIONS["LIST_SLICE"].build, self.compile(e.of), low, high)

    def _castto(self, e: S.CastTo) -> Typed:
        want = parse_type(e.kind, self.session.catalog.types)
        name = self.session.catalog.types.get(e.kind, e.kind)
        return self.apply(lambda v: cast(v.c, v.t, want, name), self.compile(e.of))

    def _case(self, e: S.Case) -> Typed:
        whens = []
        for c, v in e.whens:
            test = S.Call("=", [e.subject, c]) if e.subject is not None else c
            whens.append((self.compile(test), self.compile(v)))
        rest = self.compile(e.otherwise) if e.otherwise is not None else None
        want = common_type([v.type for _, v in whens] + ([rest.type] if rest else []))

        def built(part: str) -> Column:
            out = None
            fit = lambda t: cast(getattr(t, part), t.type, want) if want and t.type != want and not isinstance(t.type, T.NullType) else getattr(t, part)
            for c, v in whens:
                out = F.when(getattr(c, part), fit(v)) if out is None else out.when(getattr(c, part), fit(v))
            return out.otherwise(fit(rest)) if rest else out

        return self.typed(built("col"), built("probe"))

    def _param(self, e: S.Param) -> Typed:
        return self.literal(self.param_value(e.name))

    def _subquery(self, e: S.Subquery) -> Typed:
        raise QueryError("a subquery isn't allowed here")

    def _star(self, e: S.Star) -> Typed:
        raise QueryError("* isn't allowed here")

    def _lambda(self, e: S.Lambda) -> Typed:
        raise QueryError("a lambda is only an argument of list functions")

    # --- calls
    def _call(self, e: S.Call) -> Typed:
        name = e.name
        own = getattr(self, "_fn_" + name.lower().replace(" ", "_"), None)
        if own:
            return own(e)
        catalog = self.session.catalog
        macro = next((m for k, m in catalog.macros.items() if k.upper() == name), None)
        if macro:
            return self.compile(expand_macro(name, macro, e))
        if name in catalog.udfs:
            args = [self.compile(a) for a in e.args]
            return self.typed(catalog.udfs[name](*[a.col for a in args]))
        if name in AGGREGATES:
            raise QueryError(f"the aggregate {name} isn't allowed here")
        f = FUNCTIONS.get(name)
        if f is None:
            raise QueryError(f"function {name} does not exist.")
        if len(e.args) < f.least or f.most is not None and len(e.args) > f.most:
            raise QueryError(f"function {name} takes {f.least}{'' if f.most == f.least else ' or more'} arguments; {len(e.args)} given")
        if self.session.follower and name in ("=", "<>", "AND", "OR"):
            return self._two_valued(name, e)
        return self.apply(f.build, *[self.compile(a) for a in self._with_ids(name, e.args)])

    def _with_ids(self, name: str, args: list[S.Expr]) -> list[S.Expr]:
        """Nodes and relationships compare by their ids."""
        if name in ("=", "<>") and all(isinstance(a, S.Var) and a.name in self.scope.vars and self.scope.vars[a.name].kind in ("node", "rel") for a in args):
            return [S.Call("ID", [a]) for a in args]
        return args

    def _two_valued(self, name: str, e: S.Call) -> Typed:
        """The follower's rules: equality never gives NULL, and a NULL makes AND and OR NULL."""
        a, b = (self.compile(x) for x in e.args)
        rules = {
            "=": lambda x, y: x.c.eqNullSafe(y.c), "<>": lambda x, y: ~x.c.eqNullSafe(y.c),
            "AND": lambda x, y: F.when(x.c.isNotNull() & y.c.isNotNull(), x.c & y.c), "OR": lambda x, y: F.when(x.c.isNotNull() & y.c.isNotNull(), x.c | y.c),
        }
        return self.apply(rules[name], a, b)

    def _fn_is_null(self, e: S.Call) -> Typed:
        return self._null_test(e.args[0], True)

    def _fn_is_not_null(self, e: S.Call) -> Typed:
        return self._null_test(e.args[0], False)

    def _null_test(self, of: S.Expr, wish: bool) -> Typed:
        if isinstance(of, S.Var) and of.name in self.scope.vars and self.scope.vars[of.name].kind in ("node", "rel"):
            b = self.scope.vars[of.name]
            c = b.col("_key" if b.kind == "node" else "_src")
            return self.typed(c.isNull() if wish else c.isNotNull())
        return self.apply(lambda v: v.c.isNull() if wish else v.c.isNotNull(), self.compile(of))

    def _over_list(self, e: S.Call, use: Callable[[Column, Callable], Column], params: int = 1) -> Typed:
        a, fn = self.compile(e.args[0]), e.args[1]
        if not isinstance(fn, S.Lambda) or len(fn.params) != params or not isinstance(a.type, T.ArrayType):
            raise QueryError(f"{e.name} takes a list and a lambda of {params} parameter(s)")
        element = a.type.elementType

        def body(*vs: Column) -> Column:
            kept = dict(self.lambdas)
            for p, v in zip(fn.params, vs):
                self.lambdas[p] = self.typed(v, F.lit(None).cast(element))
            out = self.compile(fn.body).col
            self.lambdas = kept
            return out

        def body_probe() -> Column:
            kept = dict(self.lambdas)
            for p in fn.params:
                self.lambdas[p] = self.typed(F.lit(None).cast(element))
            out = self.compile(fn.body).probe
            self.lambdas = kept
            return out

        one = (lambda x: body(x)) if params == 1 else (lambda x, y: body(x, y))
        return self.typed(use(a.col, one), use(a.probe, (lambda x: body_probe()) if params == 1 else (lambda x, y: body_probe())))

    def _fn_list_transform(self, e: S.Call) -> Typed:
        return self._over_list(e, F.transform)

    def _fn_list_filter(self, e: S.Call) -> Typed:
        return self._over_list(e, F.filter)

    def _fn_list_reduce(self, e: S.Call) -> Typed:
        def reduce_(a: Column, f: Callable) -> Column:
            first = F.when(F.size(a) == 0, F.raise_error(F.lit("Cannot execute list_reduce on an empty list."))).otherwise(F.lit(0))
            rest = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1 + first.cast("int"), F.lit(0)))
            kind = self.compile(e.args[0]).type.elementType
            return F.aggregate(rest, F.get(a, F.lit(0)).cast(kind), lambda s, x: f(s, x).cast(kind))

        return self._over_list(e, reduce_, 2)

    def _fn_any(self, e: S.Call) -> Typed:
        return self._over_list(e, lambda a, f: F.when(a.isNotNull(), F.coalesce(F.exists(a, f), F.lit(False))))

    def _fn_all(self, e: S.Call) -> Typed:
        return self._over_list(e, lambda a, f: F.when(a.isNotNull(), F.coalesce(F.forall(a, f), F.lit(False))))

    def _fn_none(self, e: S.Call) -> Typed:
        return self._over_list(e, lambda a, f: F.when(a.isNotNull(), ~F.coalesce(F.exists(a, f), F.lit(False))))

    def _fn_single(self, e: S.Call) -> Typed:
        return self._over_list(e, lambda a, f: F.when(a.isNotNull(), F.size(F.filter(a, f)) == 1))

    def _element(self, e: S.Call, kinds: tuple[str, ...]) -> Bound | None:
        if len(e.args) == 1 and isinstance(e.args[0], S.Var) and e.args[0].name in self.scope.vars and e.args[0].name not in self.lambdas:
            b = self.scope.vars[e.args[0].name]
            return b if b.kind in kinds else None
        return None

    def _fn_id(self, e: S.Call) -> Typed:
        b = self._element(e, ("node", "rel"))
        if b and self.session.follower:
            return self.typed(b.col("_key" if b.kind == "node" else "_rid"))
        if b:
            return self.typed(element_id(self.session, b))
        return self.apply(lambda v: v.c["_ID"], self.compile(e.args[0]))

    def _fn_label(self, e: S.Call) -> Typed:
        b = self._element(e, ("node", "rel"))
        return self.typed(b.col("_label")) if b else self.apply(lambda v: v.c["_LABEL"], self.compile(e.args[0]))

    _fn_labels = _fn_label

    def _fn_keys(self, e: S.Call) -> Typed:
        b = self._element(e, ("node", "rel"))
        if not b:
            raise QueryError("KEYS takes a node or a relationship")
        return self.list_of([self.literal(p) for p in b.props])

    def _fn_start_node(self, e: S.Call) -> Typed:
        return self._end(e, 0)

    def _fn_end_node(self, e: S.Call) -> Typed:
        return self._end(e, 1)

    def _end(self, e: S.Call, which: int) -> Typed:
        b = self._element(e, ("rel",))
        if not b or not b.ends:
            raise QueryError("START_NODE and END_NODE take a relationship")
        return self._var(S.Var(b.ends[which]))

    def _fn_cost(self, e: S.Call) -> Typed:
        b = self._element(e, ("walk",))
        if not b:
            raise QueryError("COST takes a weighted shortest path")
        return self.typed(b.col("_cost"))

    def _fn_length(self, e: S.Call) -> Typed:
        b = self._element(e, ("walk",))
        return self.typed(b.col("_length")) if b else self.apply(FUNCTIONS["LENGTH"].build, self.compile(e.args[0]))

    def _fn_properties(self, e: S.Call) -> Typed:
        return self.apply(FUNCTIONS["PROPERTIES"].build, *[self.compile(a) for a in e.args])

    def _fn_struct_pack(self, e: S.Call) -> Typed:
        return self._structof(S.StructOf(e.named))

    def _fn_union_value(self, e: S.Call) -> Typed:
        (tag, of), *_ = e.named.items()
        return self.apply(lambda v: F.struct(F.lit(tag).alias("tag"), v.c.alias(tag)), self.compile(of))

    def _fn_nextval(self, e: S.Call) -> Typed:
        name = self.constant(e.args[0])
        sequence = self.session.catalog.sequence(name)
        if self.scope.df is not None and f"__next_{name}" in self.scope.df.columns:
            return self.typed(F.col(f"`__next_{name}`"))
        return self.literal(sequence.take())

    def _fn_currval(self, e: S.Call) -> Typed:
        s = self.session.catalog.sequences.get(self.constant(e.args[0]))
        if s is None or s.last is None:
            raise QueryError("currval before nextval")
        return self.literal(s.last)

    def _fn_setseed(self, e: S.Call) -> Typed:
        self.session.seed = int(float(self.constant(e.args[0])) * 1_000_000)
        return self.literal(0)

    def _fn_random(self, e: S.Call) -> Typed:
        return self.typed(F.rand(self.session.seed) if self.session.seed is not None else F.rand())

    # --- aggregates, when the projection has asked for them
    def _number(self, c: Column) -> Column:
        """How many matches have a value; rows may stand for several of them."""
        if "__weight" not in self.scope.df.columns:
            return F.count(c)
        return F.coalesce(F.sum(F.when(c.isNotNull(), F.col("__weight"))), F.lit(0)).cast("long")

    def aggregate(self, e: S.Call) -> Column:
        if e.name == "COUNT_STAR":
            return self._number(F.lit(1))
        if any(contains_aggregate(a) for a in e.args):
            raise QueryError("aggregates can't be nested")
        (of,) = e.args
        b = self._element(e, ("node", "rel", "walk"))
        if b and e.name == "COUNT":
            one = {"node": "_key", "rel": "_rid" if e.distinct else "_src", "walk": "_length"}[b.kind]
            if e.distinct and b.kind == "node":
                return F.count_distinct(F.when(b.col("_key").isNotNull(), F.struct(b.col("_label"), b.col("_key"))))
            return F.count_distinct(b.col(one)) if e.distinct else self._number(b.col(one))
        t = self.compile(of)
        c = t.col
        if e.name == "COUNT":
            return F.count_distinct(c) if e.distinct else self._number(c)
        if e.name == "COLLECT":
            return F.collect_set(c) if e.distinct else F.collect_list(F.struct(c.alias("x"))).getField("x") if self.session.follower else F.collect_list(c)
        if e.name in ("SUM", "AVG"):
            if not (is_numeric(t.type) or isinstance(t.type, T.NullType)):
                raise QueryError(f"{e.name} takes numbers")
            if e.name == "AVG":
                return F.sum_distinct(c.cast("double")) / F.count_distinct(c) if e.distinct else F.avg(c.cast("double"))
            wide = c.cast("decimal(38,0)") if is_integral(t.type) else c if isinstance(t.type, T.DecimalType) else c.cast("double")
            if is_integral(t.type) and not e.distinct and not isinstance(t.type, T.DecimalType):
                # added up as longs where that is sure to fit: a partial sum of 32-bit values
                wide = c.cast("long") if not isinstance(t.type, T.LongType) else wide
                return F.sum(wide).cast("decimal(38,0)")
            return F.sum_distinct(wide) if e.distinct else F.sum(wide)
        if is_interval(t.type):
            from .types import micros_of

            return (F.min_by if e.name == "MIN" else F.max_by)(c, micros_of(c))
        return F.min(c) if e.name == "MIN" else F.max(c)


def _meta_name(e: S.Prop) -> tuple[str, str] | None:
    """n._meta.a.b names the column _meta_a_b of n."""
    parts, of = [e.name], e.of
    while isinstance(of, S.Prop):
        parts.append(of.name)
        of = of.of
    parts.reverse()
    return (of.name, "_".join(parts)) if isinstance(of, S.Var) and parts[0] == "_meta" else None


def expand_macro(name: str, macro: tuple[list, S.Expr], call: S.Call) -> S.Expr:
    params, body = macro
    if len(call.args) > len(params):
        raise QueryError(f"macro {name} takes {len(params)} arguments")
    given: dict[str, S.Expr] = {}
    positional = [a for a in call.args if not any(a is v for v in call.named.values())]
    for (p, default), k in zip(params, range(len(params))):
        value = call.named.get(p) or (positional[k] if k < len(positional) else default)
        if value is None:
            raise QueryError(f"macro {name} needs a value for {p}")
        given[p] = value
    return replace_vars(body, given)


def replace_vars(e: Any, given: dict[str, S.Expr]) -> Any:
    import copy
    from dataclasses import fields, is_dataclass

    if isinstance(e, S.Var):
        return given.get(e.name, e)
    if isinstance(e, list):
        return [replace_vars(x, given) for x in e]
    if isinstance(e, tuple):
        return tuple(replace_vars(x, given) for x in e)
    if isinstance(e, dict):
        return {k: replace_vars(v, given) for k, v in e.items()}
    if is_dataclass(e):
        made = copy.copy(e)
        for f in fields(e):
            setattr(made, f.name, replace_vars(getattr(e, f.name), given))
        return made
    return e


def _number_of(session: Session, b: Bound) -> Column:
    table = session.catalog.nodes if b.kind == "node" else session.catalog.rels
    out = None
    for label in b.labels:
        n = F.lit(table[label].number).cast("long")
        out = n if len(b.labels) == 1 else F.when(b.col("_label") == label, n) if out is None else out.when(b.col("_label") == label, n)
    return out


def element_id(session: Session, b: Bound) -> Column:
    at = b.col("_key" if b.kind == "node" else "_rid")
    return F.when(b.col("_key" if b.kind == "node" else "_src").isNotNull(), F.struct(_number_of(session, b).alias("table"), at.alias("offset")))


def node_struct(session: Session, b: Bound) -> Column:
    props = [b.col(p).alias(p) for p in b.props]
    return F.when(b.col("_key").isNotNull(), F.struct(element_id(session, b).alias("_ID"), b.col("_label").alias("_LABEL"), *props))


def rel_struct(session: Session, b: Bound) -> Column:
    end = lambda side: F.struct(b.col(f"_{side[0]}label").alias("table"), b.col(f"_{side}").alias("offset"))
    props = [b.col(p).alias(p) for p in b.props]
    return F.when(b.col("_src").isNotNull(), F.struct(end("src").alias("_SRC"), end("dst").alias("_DST"), b.col("_label").alias("_LABEL"), element_id(session, b).alias("_ID"), *props))
