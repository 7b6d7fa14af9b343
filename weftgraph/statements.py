"""Definitions, copies, transactions, settings and the other statements that aren't queries."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Column, GraphCatalog, NodeTable, Projected, Sequence
from .operators.scope import Scope
from .operators.update import append_nodes, append_rels, number_serials
from .plans import syntax as S
from .plans.compile import Compiler
from .plans.lexer import QueryError
from .plans.types import cast, parse_type, type_name
from .sources.files import read, write
from .storage import materialise

if TYPE_CHECKING:
    from collections.abc import Iterator

    from .session import Session

_READS = {"EXPLAIN", "PROFILE", "COMMIT", "ROLLBACK", "BEGIN", "SETTING", "COPY TO", "EXPORT", "USE", "CHECKPOINT"}


def run_statement(session: Session, s: S.Statement, params: dict[str, Any]) -> DataFrame:
    if session.read_only and s.kind not in _READS:
        raise QueryError("Cannot execute write operations in a read-only transaction!")
    if s.kind == "CREATE MACRO":
        return _create_macro(session, params, **s.args)
    return globals()["_" + s.kind.lower().replace(" ", "_")](session, params=params, **s.args)


# --- tables
def _exists_already(session: Session, name: str, if_not_exists: bool) -> bool:
    there = name in session.catalog.nodes or name in session.catalog.rels
    if there and not if_not_exists:
        raise QueryError(f"{name} already exists in catalog.")
    return there


def _create_node(session: Session, params: dict, name: str, if_not_exists: bool, columns: list = (), key: str | None = None, options: dict | None = None, **more) -> DataFrame:
    if _exists_already(session, name, if_not_exists):
        return session.message(f"{name} already exists in catalog.")
    if "as" in more:
        df = session.run_query(more["as"], params)
        df = df.toDF(*[c.split(".")[-1] for c in df.columns])
        columns = [(f.name, type_name(f.dataType), None) for f in df.schema.fields]
        table = session.catalog.create_node_table(name, columns, df.columns[0])
        append_nodes(session, table, materialise(df))
    else:
        session.catalog.create_node_table(name, columns, key)
    return session.message(f"Table {name} has been created.")


def _create_rel(session: Session, params: dict, name: str, if_not_exists: bool, columns: list, ends: list, multiplicity: str, options: dict | None = None, **more) -> DataFrame:
    if _exists_already(session, name, if_not_exists):
        return session.message(f"{name} already exists in catalog.")
    table = session.catalog.create_rel_table(name, columns, ends, multiplicity)
    if "as" in more:
        df = session.run_query(more["as"], params)
        table.columns = [Column(f.name, type_name(f.dataType), f.dataType) for f in df.schema.fields[2:]]
        pair = ends[0]
        table.frames[pair] = session.catalog.empty_rels(table.columns, *pair)
        append_rels(session, table, pair, df.toDF("_src", "_dst", *[c.name for c in table.columns]))
    return session.message(f"Table {name} has been created.")


def _drop(session: Session, params: dict, kind: str, name: str, if_exists: bool) -> DataFrame:
    c = session.catalog
    if kind == "TABLE":
        if name in c.nodes:
            if users := [r.name for r in c.rels.values() if any(name in p for p in r.frames)]:
                raise QueryError(f"Cannot delete node table {name} because it is referenced by relationship table {users[0]}.")
            del c.nodes[name]
        elif name in c.rels:
            del c.rels[name]
        elif not if_exists:
            raise QueryError(f"Table {name} does not exist.")
    else:
        group = {"SEQUENCE": c.sequences, "MACRO": c.macros, "TYPE": c.types, "GRAPH": c.projected}.get(kind)
        if group is None or name not in group and not if_exists:
            raise QueryError(f"{kind.title()} {name} does not exist.")
        group.pop(name, None)
    c.version += 1
    return session.message(f"{kind.title()} {name} has been dropped.")


def _frames(table) -> list[tuple[Any, DataFrame]]:
    return [(None, table.df)] if isinstance(table, NodeTable) else list(table.frames.items())


def _put(table, key: Any, df: DataFrame) -> None:
    if isinstance(table, NodeTable):
        table.df = df
    else:
        table.frames[key] = df


def _alter(session: Session, params: dict, name: str, action: str, **a) -> DataFrame:
    c = session.catalog
    table = c.table(name)
    if action == "ADD":
        if a["column"] in table.props:
            if a["if_not_exists"]:
                return session.message(f"{name} table already has property {a['column']}.")
            raise QueryError(f"{name} table already has property {a['column']}.")
        made = Column(a["column"], a["type"], parse_type(a["type"], c.types), a["default"])
        for key, df in _frames(table):
            value = F.lit(None).cast(made.type)
            if made.default is not None:
                t = Compiler(session, Scope(df, {}), params).compile(made.default)
                value = cast(t.col, t.type, made.type, made.kind)
            _put(table, key, df.withColumn(made.name, value))
        table.columns = [*table.columns, made]
        if made.kind.upper() == "SERIAL" and isinstance(table, NodeTable):
            c.sequences[f"{name}_{made.name}_serial"] = Sequence(f"{name}_{made.name}_serial")
            table.df = materialise(number_serials(session, table.df, table))
    elif action == "DROP":
        if a["column"] not in table.props:
            if a["if_exists"]:
                return session.message(f"{name} table does not have property {a['column']}.")
            raise QueryError(f"{name} table does not have property {a['column']}.")
        if isinstance(table, NodeTable) and table.key == a["column"]:
            raise QueryError(f"Cannot drop property {a['column']} in table {name} because it is used as primary key.")
        table.columns = [x for x in table.columns if x.name != a["column"]]
        for key, df in _frames(table):
            _put(table, key, df.drop(a["column"]))
    elif action == "RENAME":
        if a["column"] not in table.props:
            raise QueryError(f"{name} table does not have property {a['column']}.")
        if a["to"] in table.props:
            raise QueryError(f"Property {a['to']} already exists in table {name}.")
        table.columns = [Column(a["to"], x.kind, x.type, x.default) if x.name == a["column"] else x for x in table.columns]
        for key, df in _frames(table):
            _put(table, key, df.withColumnRenamed(a["column"], a["to"]))
        if isinstance(table, NodeTable) and table.key == a["column"]:
            table.key = a["to"]
    elif action == "RENAME TABLE":
        c._free(a["to"])
        group = c.nodes if isinstance(table, NodeTable) else c.rels
        del group[name]
        table.name = a["to"]
        group[a["to"]] = table
        if isinstance(table, NodeTable):
            for r in c.rels.values():
                r.frames = {tuple(a["to"] if x == name else x for x in p): df for p, df in r.frames.items()}
    elif action == "ADD ENDS":
        if a["ends"] in table.frames:
            raise QueryError(f"{a['ends'][0]}->{a['ends'][1]} already exists in {name} table.")
        table.frames[a["ends"]] = c.empty_rels(table.columns, *a["ends"])
    elif action == "DROP ENDS":
        if a["ends"] not in table.frames:
            raise QueryError(f"{a['ends'][0]}->{a['ends'][1]} does not exist in {name} table.")
        del table.frames[a["ends"]]
    c.version += 1
    return session.message(f"Table {name} altered.")


def _comment(session: Session, params: dict, name: str, comment: str) -> DataFrame:
    session.catalog.table(name).comment = comment
    return session.message(f"Table {name} comment updated.")


def _create_sequence(session: Session, params: dict, name: str, if_not_exists: bool, cycle: bool, increment: int = 1, min: int | None = None, max: int | None = None, start: int | None = None) -> DataFrame:  # noqa: A002
    c = session.catalog
    if name in c.sequences:
        if if_not_exists:
            return session.message(f"{name} already exists in catalog.")
        raise QueryError(f"{name} already exists in catalog.")
    if increment == 0:
        raise QueryError("INCREMENT must be non-zero.")
    low = min if min is not None else 0 if increment > 0 else -(1 << 63)
    high = max if max is not None else (1 << 63) - 1 if increment > 0 else -1
    begin = start if start is not None else low if increment > 0 else high
    if not low <= begin <= high:
        raise QueryError("START value must be between MINVALUE and MAXVALUE.")
    c.sequences[name] = Sequence(name, begin, increment, low, high, cycle)
    return session.message(f"Sequence {name} has been created.")


def _create_type(session: Session, params: dict, name: str, type: str) -> DataFrame:  # noqa: A002
    if name in session.catalog.types:
        raise QueryError(f"Duplicated type name: {name}.")
    parse_type(type, session.catalog.types)
    session.catalog.types[name] = type
    return session.message(f"Type {name}({type}) has been created.")


def _create_macro(session: Session, bound: dict, name: str, params: list, body: S.Expr) -> DataFrame:
    if any(k.upper() == name.upper() for k in session.catalog.macros):
        raise QueryError(f"Macro {name} already exists.")
    session.catalog.macros[name] = (params, body)
    return session.message(f"Macro: {name} has been created.")


def _unsupported(session: Session, params: dict, what: str) -> DataFrame:
    raise QueryError(f"{what} are not supported")


# --- copies
def _copy_from(session: Session, params: dict, name: str, columns: list, source: Any, by_column: bool, options: dict) -> DataFrame:
    table = session.catalog.table(name)
    if isinstance(table, NodeTable):
        wanted = [c for c in table.columns if c.kind.upper() != "SERIAL" and (not columns or c.name in columns)]
        df = read(session, source, options, params, [(c.name, c.kind) for c in wanted], by_column)
        for c in table.columns:
            if c.name not in df.columns:
                df = df.withColumn(c.name, _default(session, c, params))
        df = materialise(number_serials(session, df.select(*[c.name for c in table.columns]), table))
        if options.get("ignore_errors"):
            df = _valid_keys(session, table, df)
        append_nodes(session, table, df)
        n = df.count()
    else:
        pair = _copy_pair(table, options)
        ends = [session.catalog.nodes[x] for x in pair]
        declared = [(side, type_name(t.props[t.key])) for side, t in zip(("_src", "_dst"), ends)]
        wanted = [c for c in table.columns if not columns or c.name in columns]
        df = read(session, source, options, params, [*declared, *[(c.name, c.kind) for c in wanted]])
        for c in table.columns:
            if c.name not in df.columns:
                df = df.withColumn(c.name, _default(session, c, params))
        df = materialise(df)
        for side, t in zip(("_src", "_dst"), ends):
            known = t.df.select(F.col(f"`{t.key}`").alias("k"))
            lost = df.join(known, df[side] == known["k"], "left_anti")
            if options.get("ignore_errors"):
                for r in lost.limit(int(session.settings["warning_limit"])).collect():
                    session.warnings.append(("unable to find primary key value", str(source), str(r[side])))
                df = df.join(known, df[side] == known["k"], "left_semi")
            elif bad := lost.first():
                raise QueryError(f"Unable to find primary key value {bad[side]}.")
        df = materialise(df)
        append_rels(session, table, pair, df)
        n = df.count()
    return session.message(f"{n} tuples have been copied to the {name} table.")


def _default(session: Session, c: Column, params: dict):
    if c.default is None:
        return F.lit(None).cast(c.type)
    t = Compiler(session, Scope(None, {}), params).compile(c.default)
    return cast(t.col, t.type, c.type, c.kind)


def _copy_pair(table, options: dict) -> tuple[str, str]:
    o = {k.lower(): v for k, v in options.items()}
    if "from" in o and "to" in o:
        pair = (o["from"], o["to"])
        if pair not in table.frames:
            raise QueryError(f"Rel table {table.name} does not contain {pair[0]}-{pair[1]} from-to pair.")
        return pair
    if len(table.frames) > 1:
        raise QueryError(f"The table {table.name} has multiple FROM and TO pairs defined in the schema. A specific pair of FROM and TO options is expected.")
    return next(iter(table.frames))


def _valid_keys(session: Session, table: NodeTable, df: DataFrame) -> DataFrame:
    """IGNORE_ERRORS: one row per new key stays, the others become warnings."""
    limit = int(session.settings["warning_limit"])
    key = F.col(f"`{table.key}`")
    known = df.join(table.df.select(key.alias("__k")), key == F.col("__k"), "left_semi")
    fresh = df.where(key.isNotNull()).join(table.df.select(key.alias("__k")), key == F.col("__k"), "left_anti")
    kept = materialise(fresh.dropDuplicates([table.key]))
    repeated = fresh.groupBy(key.alias("k")).count().where("count > 1").select("k").limit(limit).collect()
    session.warnings += [("duplicated primary key", table.name, str(r.k)) for r in repeated]
    session.warnings += [("duplicated primary key", table.name, str(r[table.key])) for r in known.limit(limit).collect()]
    session.warnings += [("null primary key", table.name, "NULL") for _ in range(df.where(key.isNull()).limit(limit).count())]
    return kept


def _copy_to(session: Session, params: dict, query: S.Query, path: str, options: dict) -> DataFrame:
    df = session.run_query(query, params)
    write(df, path, options)
    return session.message(f"Query result has been written to {path}.")


def ddl_of(catalog: GraphCatalog) -> list[str]:
    """The statements that make the catalog's tables."""

    def one(c: Column) -> str:
        return f"`{c.name}` {c.kind}" + (f" DEFAULT {c.default.text or json.dumps(c.default.value)}" if isinstance(c.default, S.Expr) and (c.default.text or isinstance(c.default, S.Lit)) else "")

    out = [f"CREATE TYPE {k} AS {v};" for k, v in catalog.types.items()]
    out += [f"CREATE SEQUENCE {s.name} START {s.start} INCREMENT {s.increment};" for s in catalog.sequences.values() if not s.name.endswith("_serial")]
    for t in catalog.nodes.values():
        out.append(f"CREATE NODE TABLE `{t.name}` ({', '.join(map(one, t.columns))}, PRIMARY KEY(`{t.key}`));")
    for r in catalog.rels.values():
        ends = ", ".join(f"FROM `{a}` TO `{b}`" for a, b in r.frames)
        out.append(f"CREATE REL TABLE `{r.name}` ({', '.join([ends, *map(one, r.columns), r.multiplicity])});")
    return out


def _export(session: Session, params: dict, path: str, options: dict) -> DataFrame:
    o = {k.lower(): v for k, v in options.items()}
    kind = str(o.get("format", "parquet")).lower()
    spark, c = session.spark, session.catalog
    spark.createDataFrame([(line,) for line in ddl_of(c)] or [("",)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/schema.cypher")
    copies = []
    if not o.get("schema_only"):
        for t in c.nodes.values():
            write(t.df, f"{path}/{t.name}.{kind}", {"header": True} | o)
            copies.append(f"COPY `{t.name}` FROM \"{path}/{t.name}.{kind}\";" if kind != "csv" else f"COPY `{t.name}` FROM \"{path}/{t.name}.{kind}\" (HEADER=true);")
        for r in c.rels.values():
            for (a, b), df in r.frames.items():
                write(df.select("_src", "_dst", *[x.name for x in r.columns]), f"{path}/{r.name}_{a}_{b}.{kind}", {"header": True} | o)
                copies.append(f"COPY `{r.name}` FROM \"{path}/{r.name}_{a}_{b}.{kind}\" (FROM=\"{a}\", TO=\"{b}\"{', HEADER=true' if kind == 'csv' else ''});")
    spark.createDataFrame([(x,) for x in copies] or [("",)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/copy.cypher")
    return session.message("Exported database successfully.")


def _import(session: Session, params: dict, path: str, options: dict) -> DataFrame:
    if session.catalog.nodes:
        raise QueryError("a database is imported into an empty one")
    for name in ("schema.cypher", "copy.cypher"):
        lines = [r.value for r in session.spark.read.text(f"{path}/{name}").collect() if r.value]
        # serial columns keep their values: they are copied like any other
        session.query("\n".join(x.replace(" SERIAL", " INT64") for x in lines) or ";")
    return session.message("Imported database successfully.")


# --- databases, transactions, settings
def _attach(session: Session, params: dict, path: str, alias: str | None, options: dict) -> DataFrame:
    name = alias or path.rstrip("/").rsplit("/", 1)[-1]
    if name in session.attached:
        raise QueryError(f"Duplicate attached database name: {name}. Attached database name must be unique.")
    other = type(session)(session.spark)
    other.query(f'IMPORT DATABASE "{path}"')
    session.attached[name] = other.catalog
    return session.message("Attached database successfully.")


def _detach(session: Session, params: dict, name: str) -> DataFrame:
    if name not in session.attached:
        raise QueryError(f"Database: {name} doesn't exist.")
    if session.using == name:
        session.catalog, session.using = session.home, None
    del session.attached[name]
    return session.message("Detached database successfully.")


def _use(session: Session, params: dict, name: str) -> DataFrame:
    if name not in session.attached:
        raise QueryError(f"No database named {name}.")
    session.catalog, session.using = session.attached[name], name
    return session.message("Used database successfully.")


def _begin(session: Session, params: dict, read_only: bool) -> DataFrame:
    if session.saved is not None:
        raise QueryError("Connection already has an active transaction. Cannot start a transaction within another one.")
    session.saved, session.read_only = session.catalog.snapshot(), read_only
    return session.message("transaction begun")


def _commit(session: Session, params: dict) -> DataFrame:
    if session.saved is None:
        raise QueryError("No active transaction for COMMIT.")
    session.saved, session.read_only = None, False
    return session.message("transaction committed")


def _rollback(session: Session, params: dict) -> DataFrame:
    if session.saved is None:
        raise QueryError("No active transaction for ROLLBACK.")
    session.catalog.restore(session.saved)
    session.saved, session.read_only = None, False
    return session.message("transaction rolled back")


def _checkpoint(session: Session, params: dict) -> DataFrame:
    return session.message("checkpoint done")


def _setting(session: Session, params: dict, name: str, value: S.Expr) -> DataFrame:
    key = name.lower()
    if key not in session.settings:
        raise QueryError(f"Invalid option name: {name}.")
    given = Compiler(session, Scope(None, {}), params).constant(value)
    have = session.settings[key]
    if isinstance(have, bool) != isinstance(given, bool) or isinstance(have, int) != isinstance(given, int):
        raise QueryError(f"Invalid option value for {name}.")
    session.settings[key] = given
    if key == "timeout" and given:
        session.spark.conf.set("spark.sql.broadcastTimeout", str(max(1, given // 1000)))
    return session.message(f"{name} set")


def _explain(session: Session, params: dict, logical: bool, of: Any) -> DataFrame:
    df = session.run(of, params)
    text = df._jdf.queryExecution().optimizedPlan().toString() if logical else df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return session.spark.createDataFrame([(text,)], "`explain result` string")


def _profile(session: Session, params: dict, of: Any) -> DataFrame:
    df = session.timed(of, params)
    done = df._jdf.queryExecution()
    row = (done.toString(), session.profile["seconds"], session.profile["rows"], list(_operators(done.executedPlan(), 0)))
    return session.spark.createDataFrame([row], "`plan` string, seconds double, rows long, operators array<struct<depth: int, name: string, rows: bigint, metrics: map<string, bigint>>>")


#: Plan nodes that only hold other ones, and the method that gives what they hold (fixed names of Spark's classes).
_HOLDERS = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "TableCacheQueryStageExec": "plan", "ResultQueryStageExec": "plan", "WholeStageCodegenExec": "child", "InputAdapter": "child"}


def _operators(plan: Any, depth: int) -> Iterator[tuple[int, str, int | None, dict[str, int]]]:
    """(depth, name, rows put out, all metrics) of each physical operator of a plan that has run, from the top."""
    kind = plan.getClass().getSimpleName()
    if kind in _HOLDERS:
        yield from _operators(getattr(plan, _HOLDERS[kind])(), depth)
        return
    found, each = {}, plan.metrics().iterator()
    while each.hasNext():
        pair = each.next()
        found[pair._1()] = max(0, pair._2().value())
    yield depth, plan.nodeName(), found.get("numOutputRows"), found
    for i in range(plan.children().size()):
        yield from _operators(plan.children().apply(i), depth + 1)


def _extension(session: Session, params: dict, action: str, name: str) -> DataFrame:
    """Extensions are Python entry points of the group weftgraph.extensions; loading calls them with the session."""
    from importlib.metadata import entry_points

    found = [e for e in entry_points(group="weftgraph.extensions") if e.name.lower() == name.lower()]
    if not found:
        raise QueryError(f"{name} is not an available extension.")
    if action == "LOAD":
        found[0].load()(session)
    return session.message(f"Extension: {name} {action.lower()}ed.")


def project_graph(session: Session, name: str, nodes: Any, rels: Any) -> None:
    if name in session.catalog.projected:
        raise QueryError(f"Project graph {name} already exists.")

    def as_dict(x: Any) -> dict[str, str | None]:
        return dict(x) if isinstance(x, dict) else {k: None for k in x or []}

    made = Projected(name, as_dict(nodes), as_dict(rels))
    for t in (*made.nodes, *made.rels):
        session.catalog.table(t)
    session.catalog.projected[name] = made


def projected_session(session: Session, name: str) -> Session:
    """A session over the tables of a projected graph, filtered by its predicates."""
    if name not in session.catalog.projected:
        raise QueryError(f"Cannot find graph {name}.")
    p = session.catalog.projected[name]
    part = session.catalog.snapshot()
    if p.query:
        raise QueryError(f"{name} is projected from a query; use its result")
    part.nodes = {k: v for k, v in part.nodes.items() if k in p.nodes}
    part.rels = {k: v for k, v in part.rels.items() if k in p.rels}
    other = type(session)(session.spark, part, session.dialect)
    for label, test in p.nodes.items():
        if test:
            t = part.nodes[label]
            q = other.query(f"MATCH (n:`{label}`) WHERE {test} RETURN n.`{t.key}` AS k")
            t.df = t.df.join(q, t.df[t.key] == q["k"], "left_semi")
    for r in part.rels.values():
        for pair in list(r.frames):
            if not set(pair) <= set(part.nodes):
                del r.frames[pair]
                continue
            df = r.frames[pair]
            if p.rels[r.name]:
                from .operators.scope import Bound
                from .plans.parser import Parser

                df = df.select(*[F.col(x).alias(x) for x in df.columns])
                alone = Scope(df.select(*[F.col(f"`{x}`").alias(f"r${x}") for x in df.columns]), {"r": Bound("rel", "r", [r.name], r.props)})
                c = Compiler(other, alone, {})
                df = alone.df.where(c.condition(Parser(p.rels[r.name]).expr())).select(*[F.col(f"`r${x}`").alias(x) for x in df.columns])
            for side, label in zip(("_src", "_dst"), pair):
                if p.nodes.get(label):
                    keys = part.nodes[label].df.select(F.col(part.nodes[label].key).alias("__k"))
                    df = df.join(keys, F.col(side) == F.col("__k"), "left_semi")
            r.frames[pair] = df
    return other
