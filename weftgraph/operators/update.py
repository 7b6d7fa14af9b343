"""CREATE, MERGE, SET and DELETE on the catalog's frames.

A table's frame is replaced by a new one that is written to the shared folder, so what a statement has read
stays as it was, a rolled-back transaction only forgets frames, and plans stay short.
"""

from __future__ import annotations

import itertools
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..plans import syntax as S
from ..plans.compile import Compiler
from ..plans.lexer import QueryError
from ..plans.types import cast
from ..storage import materialise, sized

from .match import Matcher, used_properties
from .scope import Bound, Scope

if TYPE_CHECKING:
    from ..catalog import Column as Declared
    from ..catalog import NodeTable, RelTable
    from ..session import Session

_fresh = itertools.count(1)


def step(session: Session, clause: Any, scope: Scope, used: dict, params: dict) -> Scope:
    if scope.df is None:
        scope = Scope(session.spark.range(1).select(F.lit(1).alias("__one")), {})
    scope = Scope(materialise(scope.df), dict(scope.vars))
    if isinstance(clause, S.Create):
        return create(session, clause.patterns, scope, params)
    if isinstance(clause, S.SetItems):
        return set_items(session, clause.items, scope, params)
    if isinstance(clause, S.Delete):
        return delete(session, clause, scope)
    if isinstance(clause, S.Merge):
        return merge(session, clause, scope, used, params)
    raise QueryError("unknown clause")


# --- writing to tables
def _value(session: Session, c: Compiler, column: Declared, e: S.Expr | None, name: str) -> Column:
    if e is not None:
        t = c.compile(e)
        return cast(t.col, t.type, column.type, column.kind)
    if column.kind.upper() == "SERIAL":
        return F.lit(None).cast("long")  # numbered later
    if column.default is not None:
        t = c.compile(column.default)
        return cast(t.col, t.type, column.type, column.kind)
    return F.lit(None).cast(column.type)


def number_serials(session: Session, df: DataFrame, table: NodeTable, prefix: str = "") -> DataFrame:
    """Serial columns get the next values of their sequence, in the order of the rows' partitions."""
    for c in table.columns:
        if c.kind.upper() != "SERIAL":
            continue
        seq = session.catalog.sequences[f"{table.name}_{c.name}_serial"]
        placed, n = in_places(df)
        first = seq.take(n) if n else 0
        df = placed.withColumn(f"{prefix}{c.name}", F.lit(first) + F.col("__place")).drop("__place")
    return df


def in_places(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their places from 0 on, and how many there are; only one count a partition is collected."""
    marked = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
    # ids rise within partitions: a place is the sum of the partitions before and the rank in its own
    part = F.shiftright("__row", 33)
    sizes = {r.p: r.n for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    begin = F.create_map(*[F.lit(x).cast("long") for p, s in starts.items() for x in (p, s)]) if starts else F.create_map().cast("map<bigint,bigint>")
    place = F.element_at(begin, part.cast("long")) + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return marked.withColumn("__place", place).drop("__row"), total


def draw(session: Session, clause, scope: Scope) -> Scope:
    """NEXTVAL gives each row of the clause its own value: a column for each sequence that the clause draws from.

    Two NEXTVAL of one sequence in a clause give a row the same value. No rows draw nothing.
    """
    calls = [x for x in S.walk(clause) if isinstance(x, S.Call) and x.name == "NEXTVAL"]
    if not calls or scope.df is None:
        return scope
    compiler = Compiler(session, Scope(None, {}), {})
    df, n = in_places(scope.df)
    for name in sorted({compiler.constant(x.args[0]) for x in calls}):
        seq = session.catalog.sequence(name)
        df = df.withColumn(f"__next_{name}", seq.column(seq.take(n), F.col("__place")) if n else F.lit(0).cast("long"))
    return Scope(df.drop("__place"), scope.vars)


def check_keys(table: NodeTable, new: DataFrame) -> None:
    """Primary keys are present, new, and not repeated."""
    key = new.select(F.col(f"`{table.key}`").alias("k"))
    if not key.where("k IS NULL").isEmpty():
        raise QueryError(f"Found NULL, which violates the non-null constraint of the primary key column {table.key}.")
    bad = key.groupBy("k").count().where("count > 1").select("k").unionByName(key.join(table.df.select(F.col(f"`{table.key}`").alias("k")), "k", "left_semi")).first()
    if bad:
        raise QueryError(f"Found duplicated primary key value {bad.k}, which violates the uniqueness constraint of the primary key column.")


def append_nodes(session: Session, table: NodeTable, new: DataFrame) -> None:
    check_keys(table, new)
    table.df = sized(materialise(table.df.unionByName(new.select(*table.df.columns))))


def with_ids(table: RelTable, pair: tuple[str, str]) -> DataFrame:
    """The frame with an identity of each relationship, fixed from now on."""
    df = table.frames[pair]
    if "_rid" not in df.columns:
        df = table.frames[pair] = sized(materialise(df.withColumn("_rid", F.monotonically_increasing_id())))
    return df


def _id_base(session: Session) -> int:
    """Where the ids of the next batch of relationships begin: no two batches share any."""
    session.catalog.version += 1
    return session.catalog.version << 43


def append_rels(session: Session, table: RelTable, pair: tuple[str, str], new: DataFrame) -> None:
    old = with_ids(table, pair)
    if "_rid" not in new.columns:
        new = new.withColumn("_rid", F.monotonically_increasing_id() + F.lit(_id_base(session)))
    table.frames[pair] = sized(materialise(old.unionByName(new.select(*old.columns))))
    sides = {"MANY_ONE": ["_src"], "ONE_MANY": ["_dst"], "ONE_ONE": ["_src", "_dst"]}.get(table.multiplicity, [])
    for side in sides:
        bad = table.frames[pair].groupBy(side).count().where("count > 1").first()
        if bad:
            table.frames[pair] = old
            raise QueryError(f"Node with key {bad[0]} has more than one neighbour in table {table.name} in the {'fwd' if side == '_src' else 'bwd'} direction, which violates the rel multiplicity constraint.")


# --- CREATE
def _one(names: list[str], known: Any, what: str) -> str:
    if len(names) != 1:
        raise QueryError(f"Create {what} expects a single label.")
    if names[0] not in known:
        raise QueryError(f"Table {names[0]} does not exist.")
    return names[0]


def create(session: Session, patterns: list[S.Path], scope: Scope, params: dict) -> Scope:
    catalog = session.catalog
    out = Scope(scope.df, dict(scope.vars))
    for path in patterns:
        for n in path.nodes:
            if n.var in out.vars:
                continue
            table = catalog.nodes[_one(n.labels, catalog.nodes, "node")]
            _known(n.props, table, n.var)
            c = Compiler(session, out, params)
            cols = {f"{n.var}${d.name}": _value(session, c, d, n.props.get(d.name), d.name) for d in table.columns}
            df = number_serials(session, out.df.withColumns(cols), table, f"{n.var}$")
            df = df.withColumns({f"{n.var}$_key": F.col(f"`{n.var}${table.key}`"), f"{n.var}$_label": F.lit(table.name)})
            out.df = materialise(df)
            append_nodes(session, table, out.df.select(*[F.col(f"`{n.var}${d.name}`").alias(d.name) for d in table.columns]))
            out.vars[n.var] = Bound("node", n.var, [table.name], table.props)
        for k, r in enumerate(path.rels):
            if r.recursion or r.direction == "--":
                raise QueryError("a created relationship has one direction and no bounds")
            table = catalog.rels[_one(r.types, catalog.rels, "rel")]
            _known(r.props, table, r.var)
            a, b = out.vars[path.nodes[k].var], out.vars[path.nodes[k + 1].var]
            src, dst = (b, a) if r.direction == "<-" else (a, b)
            c = Compiler(session, out, params)
            cols = {f"{r.var}${d.name}": _value(session, c, d, r.props.get(d.name), d.name) for d in table.columns}
            cols |= {f"{r.var}$_src": src.col("_key"), f"{r.var}$_dst": dst.col("_key"), f"{r.var}$_label": F.lit(table.name), f"{r.var}$_slabel": src.col("_label"), f"{r.var}$_dlabel": dst.col("_label")}
            out.df = materialise(out.df.withColumns(cols).withColumn(f"{r.var}$_rid", F.monotonically_increasing_id() + F.lit(_id_base(session))))
            fits = [p for p in table.frames if p[0] in src.labels and p[1] in dst.labels]
            if not fits:
                raise QueryError(f"{table.name} does not connect {src.labels} and {dst.labels}.")
            for pair in fits:
                rows = out.df.where((F.col(f"`{r.var}$_slabel`") == pair[0]) & (F.col(f"`{r.var}$_dlabel`") == pair[1]))
                append_rels(session, table, pair, rows.select(*[F.col(f"`{r.var}${x}`").alias(x) for x in ("_src", "_dst", "_rid", *table.props)]))
            out.vars[r.var] = Bound("rel", r.var, [table.name], table.props, (src.name, dst.name))
    return out


def _known(props: dict, table: NodeTable | RelTable, var: str) -> None:
    for p in props:
        if p not in table.props:
            raise QueryError(f"Cannot find property {p} for {var}.")


# --- SET
def set_items(session: Session, items: list[tuple[S.Expr, S.Expr]], scope: Scope, params: dict) -> Scope:
    flat: list[tuple[str, str, S.Expr]] = []
    for target, value in items:
        if isinstance(target, S.Prop) and isinstance(target.of, S.Var):
            flat.append((target.of.name, target.name, value))
        elif isinstance(target, S.Var) and isinstance(value, S.StructOf):
            flat += [(target.name, k, v) for k, v in value.items.items()]
        else:
            raise QueryError("SET takes properties of variables")
    out = Scope(scope.df, dict(scope.vars))
    c = Compiler(session, out, params)
    news = {}
    for i, (var, prop, value) in enumerate(flat):
        b = out.need(var)
        if b.kind not in ("node", "rel"):
            raise QueryError(f"{var} is no node or relationship.")
        tables = [t for t in ((session.catalog.nodes if b.kind == "node" else session.catalog.rels)[n] for n in b.labels) if prop in t.props]
        if not tables:
            raise QueryError(f"Cannot find property {prop} for {var}.")
        t = c.compile(value)
        kind = tables[0].props[prop]
        news[f"__s{i}"] = cast(t.col, t.type, kind, next(d.kind for d in tables[0].columns if d.name == prop))
    df = materialise(out.df.withColumns(news))
    for i, (var, prop, _) in enumerate(flat):
        b = out.vars[var]
        if b.kind == "node":
            for label in b.labels:
                _set_node(session, session.catalog.nodes[label], df, b, prop, f"__s{i}")
        else:
            for name in b.labels:
                _set_rel(session.catalog.rels[name], df, b, prop, f"__s{i}")
        if b.kind == "node" and any(session.catalog.nodes[n].key == prop for n in b.labels):
            df = df.withColumn(f"{var}$_key", F.col(f"__s{i}"))
        df = df.withColumn(f"{var}${prop}", F.col(f"__s{i}"))
        if prop not in b.props:
            b.props = b.props | {prop: df.schema[f"{var}${prop}"].dataType}
    out.df = df.drop(*[f"__s{i}" for i in range(len(flat))])
    return out


def _overwritten(rows: DataFrame, changes: DataFrame, key: str, prop: str) -> DataFrame:
    """rows with `prop` replaced where changes (k, v) has the key; the last of several changes is not defined."""
    one = changes.groupBy("k").agg(F.first("v").alias("v")).withColumn("__hit", F.lit(True))
    kind = rows.schema[prop].dataType
    joined = rows.join(one, F.col(f"`{key}`") == F.col("k"), "left")
    return joined.withColumn(prop, F.when(F.col("__hit"), F.col("v").cast(kind)).otherwise(F.col(f"`{prop}`"))).select(*rows.columns)


def _set_node(session: Session, table: NodeTable, df: DataFrame, b: Bound, prop: str, new: str) -> None:
    if prop not in table.props:
        return
    mine = df.where((b.col("_label") == table.name) & b.col("_key").isNotNull())
    changes = mine.select(b.col("_key").alias("k"), F.col(new).alias("v"))
    if prop == table.key:
        changes = changes.distinct()
        others = table.df.join(changes, F.col(f"`{table.key}`") == F.col("k"), "left_anti")
        clash = changes.where("NOT (k <=> v)").join(others.select(F.col(f"`{table.key}`").alias("v")), "v", "left_semi").first()
        if clash:
            raise QueryError(f"Found duplicated primary key value {clash.v}, which violates the uniqueness constraint of the primary key column.")
    table.df = sized(materialise(_overwritten(table.df, changes, table.key, prop)))
    if prop == table.key:
        for rel in session.catalog.rels.values():
            for pair, frame in list(rel.frames.items()):
                for side, label in zip(("_src", "_dst"), pair):
                    if label == table.name:
                        frame = _overwritten(with_ids(rel, pair) if frame is rel.frames[pair] else frame, changes, side, side)
                if table.name in pair:
                    rel.frames[pair] = sized(materialise(frame))


def _set_rel(table: RelTable, df: DataFrame, b: Bound, prop: str, new: str) -> None:
    if prop not in table.props:
        return
    changes = df.where((b.col("_label") == table.name) & b.col("_src").isNotNull()).select(b.col("_rid").alias("k"), F.col(new).alias("v"))
    for pair in list(table.frames):
        table.frames[pair] = sized(materialise(_overwritten(with_ids(table, pair), changes, "_rid", prop)))


# --- DELETE
def delete(session: Session, clause: S.Delete, scope: Scope) -> Scope:
    catalog = session.catalog
    bound = []
    for e in clause.exprs:
        if not isinstance(e, S.Var):
            raise QueryError("DELETE takes nodes and relationships")
        bound.append(scope.need(e.name))
    if session.follower and any(b.kind == "rel" for b in bound):
        raise QueryError("DeleteEdgeUnsupported")
    for b in sorted(bound, key=lambda b: b.kind == "node"):  # relationships go first
        if b.kind == "rel":
            for name in b.labels:
                table = catalog.rels[name]
                gone = scope.df.where(b.col("_label") == name).select(b.col("_rid").alias("_rid")).distinct()
                for pair in list(table.frames):
                    rows = with_ids(table, pair)
                    table.frames[pair] = sized(materialise(rows.join(gone, "_rid", "left_anti").select(*rows.columns)))
        elif b.kind == "node":
            for label in b.labels:
                _delete_nodes(session, catalog.nodes[label], scope.df.where((b.col("_label") == label) & b.col("_key").isNotNull()).select(b.col("_key").alias("k")).distinct(), clause.detach)
        else:
            raise QueryError("DELETE takes nodes and relationships")
    return scope


def _delete_nodes(session: Session, table: NodeTable, gone: DataFrame, detach: bool) -> None:
    for rel in session.catalog.rels.values():
        for pair in list(rel.frames):
            for side, label in zip(("_src", "_dst"), pair):
                if label != table.name:
                    continue
                rows = rel.frames[pair]
                if detach:
                    rel.frames[pair] = sized(materialise(rows.join(gone, rows[side] == gone["k"], "left_anti")))
                elif not session.follower and (hit := rows.join(gone, rows[side] == gone["k"], "left_semi").first()):
                    raise QueryError(f"Node(nodeOffset: {hit[side]}) has connected edges in table {rel.name} in the {'fwd' if side == '_src' else 'bwd'} direction, which cannot be deleted. Please delete the edges first or try DETACH DELETE.")
    table.df = sized(materialise(table.df.join(gone, table.df[table.key] == gone["k"], "left_anti")))


# --- MERGE
def merge(session: Session, clause: S.Merge, scope: Scope, used: dict, params: dict) -> Scope:
    """Rows whose pattern matches go on with the matches; for the others the pattern is created once per distinct values."""
    used = used | used_properties([S.Match(clause.pattern, None, False), clause.on_match, clause.on_create])
    if session.follower:
        clause = _by_id(session, clause)
    tag = f"__m{next(_fresh)}"
    start = Scope(materialise(scope.df.withColumn(tag, F.monotonically_increasing_id())), scope.vars | {tag: Bound("value", tag)})
    matched = _match_rows(session, clause, start, used, params)
    matched.df = materialise(matched.df)
    missing = start.df.join(matched.df.select(tag).distinct(), tag, "left_anti")
    if missing.isEmpty():
        return _done(session, clause.on_match, matched, tag, params)
    exprs = [e for p in clause.pattern for x in (*p.nodes, *p.rels) for e in x.props.values()]
    c = Compiler(session, Scope(missing, start.vars), params)
    values = {f"{tag}_{i}": c.column(e) for i, e in enumerate(exprs)}
    keys = [k for p in clause.pattern for n in p.nodes if n.var in start.vars for k in (f"{n.var}$_key", f"{n.var}$_label")]
    distinct = missing.withColumns(values).dropDuplicates([*values, *keys]) if values or keys else missing.limit(1)
    created = create(session, clause.pattern, Scope(materialise(distinct.drop(*values)), dict(start.vars)), params)
    if clause.on_create:
        created = set_items(session, clause.on_create, created, params)
    made_rows = created.df.select(tag)
    again = missing.join(made_rows, tag, "left_anti")
    parts = [created]
    if not again.isEmpty():
        later = _match_rows(session, clause, Scope(again, start.vars), used, params)
        parts.append(_done(session, clause.on_match, Scope(materialise(later.df), later.vars), None, params))
    if not matched.df.isEmpty():
        parts.append(_done(session, clause.on_match, matched, None, params))
    held = created.held()
    for p in parts[1:]:
        held = [x for x in held if x in p.df.columns]
    df = None
    for p in parts:
        one = p.df.select(*[F.col(f"`{x}`") for x in held])
        df = one if df is None else df.unionByName(one)
    return Scope(df.drop(tag), {k: v for k, v in created.vars.items() if k != tag})


def _done(session: Session, items: list, scope: Scope, tag: str | None, params: dict) -> Scope:
    out = set_items(session, items, scope, params) if items and not scope.df.isEmpty() else scope
    return Scope(out.df.drop(tag), {k: v for k, v in out.vars.items() if k != tag}) if tag else out


def _match_rows(session: Session, clause: S.Merge, scope: Scope, used: dict, params: dict) -> Scope:
    used = {k: set(v) | {"*"} for k, v in used.items()}
    return Matcher(session, used, params).match(clause.pattern, scope)


def _by_id(session: Session, clause: S.Merge) -> S.Merge:
    """The follower merges by id alone and changes nothing on a hit."""
    return S.Merge(clause.pattern, [], [])


