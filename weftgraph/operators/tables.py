"""Table functions: CALL name(…)."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import syntax as S
from ..plans.compile import Compiler
from ..plans.lexer import QueryError
from .scope import Scope

if TYPE_CHECKING:
    from ..session import Session

VERSION = "0.1.0"
TABLES: dict[str, Callable[..., DataFrame]] = {}


def table_function(names: str):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in names.split():
            TABLES[n] = f
        return f

    return keep


def call_table(session: Session, clause: S.InCall, params: dict) -> DataFrame:
    f = session.table_functions.get(clause.name.upper()) or TABLES.get(clause.name.upper())
    if f is None:
        raise QueryError(f"function {clause.name} does not exist.")
    c = Compiler(session, Scope(None, {}), params)
    return f(session, *[_plain(c, a) for a in clause.args])


def _plain(c: Compiler, e: S.Expr) -> Any:
    if isinstance(e, S.ListOf):
        return [_plain(c, x) for x in e.items]
    if isinstance(e, S.StructOf):
        return {k: _plain(c, v) for k, v in e.items.items()}
    if isinstance(e, S.Var):
        return e.name
    return c.constant(e)


def _rows(session: Session, rows: list[tuple], schema: str) -> DataFrame:
    return session.spark.createDataFrame(rows, schema)


@table_function("CURRENT_SETTING")
def current_setting(session: Session, name: str) -> DataFrame:
    if name.lower() not in session.settings:
        raise QueryError(f"Invalid option name: {name}.")
    return _rows(session, [(str(session.settings[name.lower()]),)], f"`{name}` string")


@table_function("CATALOG_VERSION")
def catalog_version(session: Session) -> DataFrame:
    return _rows(session, [(session.catalog.version,)], "version long")


@table_function("DB_VERSION")
def db_version(session: Session) -> DataFrame:
    return _rows(session, [(VERSION,)], "version string")


@table_function("SHOW_TABLES")
def show_tables(session: Session) -> DataFrame:
    c = session.catalog
    rows = [(t.number, t.name, kind, session.using or "local", t.comment) for kind, group in (("NODE", c.nodes), ("REL", c.rels)) for t in group.values()]
    for alias, other in session.attached.items():
        rows += [(t.number, t.name, kind, alias, t.comment) for kind, group in (("NODE", other.nodes), ("REL", other.rels)) for t in group.values()]
    return _rows(session, rows, "id long, name string, type string, `database name` string, comment string")


@table_function("TABLE_INFO")
def table_info(session: Session, name: str) -> DataFrame:
    t = session.catalog.table(name)
    key = getattr(t, "key", None)
    default = lambda c: "NULL" if c.default is None else str(getattr(c.default, "value", None) if isinstance(c.default, S.Lit) else getattr(c.default, "text", ""))
    if key is not None:
        return _rows(session, [(i, c.name, c.kind, default(c), c.name == key) for i, c in enumerate(t.columns)], "`property id` long, name string, type string, `default expression` string, `primary key` boolean")
    return _rows(session, [(i + 1, c.name, c.kind, default(c), "BOTH") for i, c in enumerate(t.columns)], "`property id` long, name string, type string, `default expression` string, storage_direction string")


@table_function("SHOW_CONNECTION")
def show_connection(session: Session, name: str) -> DataFrame:
    c = session.catalog
    if name not in c.rels:
        raise QueryError("Show connection can only be called on a rel table!")
    return _rows(session, [(a, b, c.nodes[a].key, c.nodes[b].key) for a, b in c.rels[name].frames], "`source table name` string, `destination table name` string, `source table primary key` string, `destination table primary key` string")


@table_function("STATS_INFO")
def stats_info(session: Session, name: str) -> DataFrame:
    t = session.catalog.table(name)
    frames = [t.df] if hasattr(t, "key") else list(t.frames.values())
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    plain = [c.name for c in t.columns if df.schema[c.name].dataType.typeName() not in ("array", "map", "struct")]
    return df.agg(F.count("*").alias("cardinality"), *[F.approx_count_distinct(F.col(f"`{p}`")).alias(f"{p}_distinct_count") for p in plain])


@table_function("STORAGE_INFO FILE_INFO")
def storage_info(session: Session, name: str | None = None) -> DataFrame:
    c = session.catalog
    tables = [c.table(name)] if name else [*c.nodes.values(), *c.rels.values()]
    rows = [(t.name, path) for t in tables for df in ([t.df] if hasattr(t, "key") else t.frames.values()) for path in df.inputFiles()]
    return _rows(session, rows, "table_name string, file string")


@table_function("BM_INFO")
def bm_info(session: Session) -> DataFrame:
    status = session.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, total, free = status.valuesIterator(), 0, 0
    while it.hasNext():
        pair = it.next()
        total, free = total + pair._1(), free + pair._2()
    return _rows(session, [(total, total - free)], "mem_limit long, mem_usage long")


@table_function("FSM_INFO")
def fsm_info(session: Session) -> DataFrame:
    return _rows(session, [], "page_idx long, num_pages long")


@table_function("SHOW_WARNINGS")
def show_warnings(session: Session) -> DataFrame:
    return _rows(session, [(i, m, p, s) for i, (m, p, s) in enumerate(session.warnings)], "query_id long, message string, file_path string, skipped_line_or_record string")


@table_function("SHOW_ATTACHED_DATABASES")
def show_attached(session: Session) -> DataFrame:
    return _rows(session, [(n, "LOCAL") for n in session.attached], "name string, `database type` string")


@table_function("SHOW_SEQUENCES")
def show_sequences(session: Session) -> DataFrame:
    rows = [(s.name, session.using or "local", s.start, s.increment, s.low, s.high, s.cycle) for s in session.catalog.sequences.values()]
    return _rows(session, rows, "name string, `database name` string, `start value` long, increment long, `min value` long, `max value` long, cycle boolean")


@table_function("SHOW_FUNCTIONS")
def show_functions(session: Session) -> DataFrame:
    from ..functions import FUNCTIONS
    from ..plans.compile import AGGREGATES

    compiled = [n[4:].upper() for n in dir(Compiler) if n.startswith("_fn_")]
    rows = {(n, "scalar function", f.signature) for n, f in FUNCTIONS.items()} | {(n, "scalar function", "") for n in compiled if n not in FUNCTIONS}
    rows |= {(n, "aggregate function", "") for n in AGGREGATES} | {(n, "table function", "") for n in TABLES}
    return _rows(session, sorted(rows), "name string, type string, signature string")


@table_function("SHOW_LOADED_EXTENSIONS SHOW_OFFICIAL_EXTENSIONS")
def show_extensions(session: Session) -> DataFrame:
    return _rows(session, [], "`extension name` string, `extension source` string, `extension path` string")


@table_function("SHOW_INDEXES")
def show_indexes(session: Session) -> DataFrame:
    rows = [(t.name, "_PK", "HASH", [t.key]) for t in session.catalog.nodes.values()]
    return _rows(session, rows, "`table name` string, `index name` string, `index type` string, `property names` array<string>")


@table_function("SHOW_PROJECTED_GRAPHS")
def show_projected(session: Session) -> DataFrame:
    return _rows(session, [(p.name, "CYPHER" if p.query else "NATIVE") for p in session.catalog.projected.values()], "name string, type string")


@table_function("PROJECTED_GRAPH_INFO")
def projected_info(session: Session, name: str) -> DataFrame:
    if name not in session.catalog.projected:
        raise QueryError(f"Projected graph {name} does not exist.")
    p = session.catalog.projected[name]
    if p.query:
        return _rows(session, [(p.query,)], "`cypher statement` string")
    rows = [("NODE", k, v or "") for k, v in p.nodes.items()] + [("REL", k, v or "") for k, v in p.rels.items()]
    return _rows(session, rows, "`table type` string, `table name` string, predicate string")


@table_function("SHOW_MACROS")
def show_macros(session: Session) -> DataFrame:
    rows = [(n, f"({', '.join(p + (' := ' + (d.text or str(getattr(d, 'value', ''))) if d is not None else '') for p, d in params)}) -> {body.text}") for n, (params, body) in session.catalog.macros.items()]
    return _rows(session, rows, "name string, definition string")


# --- standalone calls
@table_function("CLEAR_WARNINGS")
def clear_warnings(session: Session) -> DataFrame:
    session.warnings.clear()
    return session.message("warnings cleared")


@table_function("_CACHE_ARRAY_COLUMN_LOCALLY")
def cache_column(session: Session, table: str, column: str) -> DataFrame:
    """Keeps a column of vectors on the executors, where it fits."""
    session.catalog.table(table).df.select(column).cache()
    return session.message(f"{column} cached")


@table_function("PROJECT_GRAPH")
def project_graph(session: Session, name: str, nodes: Any, rels: Any) -> DataFrame:
    from ..statements import project_graph as define

    define(session, name, nodes, rels)
    return session.message(f"graph {name} projected")


@table_function("PROJECT_GRAPH_CYPHER")
def project_graph_cypher(session: Session, name: str, query: str) -> DataFrame:
    from ..catalog import Projected
    from ..plans.parser import parse

    parse(query)
    session.catalog.projected[name] = Projected(name, {}, {}, query)
    return session.message(f"graph {name} projected")


@table_function("DROP_PROJECTED_GRAPH")
def drop_projected(session: Session, name: str) -> DataFrame:
    if session.catalog.projected.pop(name, None) is None:
        raise QueryError(f"Projected graph {name} does not exist.")
    return session.message(f"graph {name} dropped")


# --- scans as functions
def _scan(session: Session, source: Any, options: dict | None = None) -> DataFrame:
    from ..sources.files import read

    return read(session, source, options or {}, {})


@table_function("READ_PARQUET READ_NPY")
def read_files(session: Session, *paths: Any) -> DataFrame:
    return _scan(session, list(paths) if len(paths) > 1 else paths[0])


@table_function("READ_CSV_SERIAL READ_CSV_PARALLEL")
def read_csv_files(session: Session, path: Any, *options: dict) -> DataFrame:
    merged: dict = {}
    for o in options:
        merged |= o
    return _scan(session, path, merged)
