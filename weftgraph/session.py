"""Runs statements of the query language on Spark."""

from __future__ import annotations

import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import GraphCatalog
from .operators import subquery
from .operators.match import Matcher, only_counts, used_properties
from .operators.project import project
from .operators.scope import Bound, Scope
from .plans import syntax as S
from .plans.compile import Compiler
from .plans.lexer import QueryError
from .plans.parser import parse
from .storage import materialise

SETTINGS: dict[str, Any] = {
    "threads": 0, "timeout": 0, "progress_bar": False, "var_length_extend_max_depth": 30, "sparse_frontier_threshold": 1000, "enable_semi_mask": True, "disable_map_key_check": True,
    "warning_limit": 8192, "spill_to_disk": True, "home_directory": "", "file_search_path": "", "enable_zone_map": True, "enable_gds": True, "recursive_pattern_semantic": "WALK",
    "recursive_pattern_factor": 1, "checkpoint_threshold": 16_777_216, "auto_checkpoint": True, "force_checkpoint_on_close": True, "enable_plan_optimizer": True, "enable_internal_catalog": False,
}


def _numbered_alike(df: DataFrame) -> bool:
    """Whether rows are numbered alike each time: the frame is a scan with projections and filters at most."""
    lines = df._jdf.queryExecution().analyzed().treeString().splitlines()
    names = {m.group(1) for line in lines if (m := re.match(r"[\s:+\-|]*(\w+)", line))}
    return names <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias", "View", "Union", "ResolvedHint"}


class Session:
    """One connection: a catalog, settings, and the transaction that may be open."""

    def __init__(self, spark: SparkSession, catalog: GraphCatalog | None = None, dialect: str = "analytics"):
        self.spark, self.catalog, self.dialect = spark, catalog or GraphCatalog(spark), dialect
        self.follower = dialect == "follower"
        self.settings = dict(SETTINGS)
        self.seed: int | None = None
        self.warnings: list[tuple] = []
        self.attached: dict[str, GraphCatalog] = {}
        self.home, self.using = self.catalog, None
        self.saved: GraphCatalog | None = None
        self.read_only = False
        self.profile: dict[str, Any] = {}
        self.table_functions: dict[str, Any] = {}

    # --- what matching reads
    def node_labels(self) -> list[str]:
        return list(self.catalog.nodes)

    def rel_names(self) -> list[str]:
        return list(self.catalog.rels)

    def rel_pairs(self, table: str) -> list[tuple[str, str]]:
        return list(self.catalog.rels[table].frames)

    def node_rows(self, label: str) -> DataFrame:
        return self.catalog.nodes[label].df

    def rel_rows(self, table: str, pair: tuple[str, str]) -> DataFrame:
        frames = self.catalog.rels[table].frames
        df = frames[pair]
        if "_rid" in df.columns:
            return df
        numbered = df.withColumn("_rid", F.monotonically_increasing_id())
        if _numbered_alike(df):
            return numbered
        frames[pair] = materialise(numbered)  # rows may come in another order next time: their identities are kept
        return frames[pair]

    # --- entry points
    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Runs all statements of the text; the last one's result."""
        result = None
        for statement in parse(text, self.dialect):
            result = self.run(statement, params or {})
        if result is None:
            result = self.message("ok")
        return result

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse(text, self.dialect))

    def message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def run(self, statement: Any, params: dict[str, Any]) -> DataFrame:
        if isinstance(statement, S.Query):
            return self.run_query(statement, params)
        from .statements import run_statement

        return run_statement(self, statement, params)

    def run_query(self, q: S.Query, params: dict[str, Any]) -> DataFrame:
        frames = [self.run_single(p, params) for p in q.parts]
        out = frames[0]
        for f in frames[1:]:
            if len(f.columns) != len(out.columns):
                raise QueryError("The number of columns to union/union all must be the same.")
            kinds = [type(a.dataType) is type(b.dataType) or "void" in (a.dataType.typeName(), b.dataType.typeName()) for a, b in zip(out.schema, f.schema)]
            if not all(kinds):
                raise QueryError("the columns of a union must have the same types")
            out = out.union(f)
        return out if q.union_all or len(frames) == 1 else out.distinct()

    def run_single(self, clauses: list, params: dict[str, Any]) -> DataFrame:
        used = used_properties(clauses)
        folds = only_counts(clauses) and not self.follower
        scope = Scope(None, {})
        for clause in clauses:
            scope = self.step(clause, scope, used, params, folds)
        if not isinstance(clauses[-1], S.Return):
            if isinstance(clauses[-1], S.InCall | S.LoadFrom):
                return scope.df.select(*[b.col() for b in scope.vars.values()])
            if isinstance(clauses[-1], S.Match | S.With | S.Unwind):
                raise QueryError("Query must conclude with RETURN clause")
            return self.message("ok")
        return scope.df

    def step(self, clause: Any, scope: Scope, used: dict, params: dict[str, Any], folds: bool = False) -> Scope:
        from .operators import update

        scope = update.draw(self, clause, scope)
        if isinstance(clause, S.Match):
            if clause.optional:
                return subquery.optional(self, scope, clause, used, params)
            found = Matcher(self, used, params, folds, where=clause.where).match(clause.patterns, scope, clause.hint)
            return subquery.where(self, found, clause.where, params)
        if isinstance(clause, S.With):
            return project(self, scope, clause.body, params, False)
        if isinstance(clause, S.Return):
            return project(self, scope, clause.body, params, True)
        if isinstance(clause, S.Unwind):
            df = scope.df if scope.df is not None else self.spark.range(1).select(F.lit(1).alias("__one"))
            c = Compiler(self, Scope(df, scope.vars), params)
            df = df.withColumn(clause.alias, F.explode(c.column(clause.expr)))
            return Scope(df, scope.vars | {clause.alias: Bound("value", clause.alias)})
        if isinstance(clause, S.LoadFrom):
            from .sources.files import load

            return self._values(load(self, clause, params), scope, [], clause.where, params)
        if isinstance(clause, S.InCall):
            from .operators.tables import call_table

            return self._values(call_table(self, clause, params), scope, clause.yields, clause.where, params)
        if self.read_only:
            raise QueryError("Cannot execute write operations in a read-only transaction!")
        return update.step(self, clause, scope, used, params)

    def _values(self, df: DataFrame, scope: Scope, yields: list, test: S.Expr | None, params: dict) -> Scope:
        if yields:
            df = df.select(*[F.col(f"`{a}`").alias(b) for a, b in yields])
        alone = Scope(df, {c: Bound("value", c) for c in df.columns})
        alone = subquery.where(self, alone, test, params)
        if scope.df is None:
            return alone
        return Scope(scope.df.crossJoin(alone.df), scope.vars | alone.vars)

    # --- registration of functions
    def create_function(self, name: str, f: Any, kind: Any) -> None:
        """A scalar function under a name of the language: a Python function (row by row) or a pandas one."""
        udf = f if hasattr(f, "evalType") or hasattr(f, "returnType") else F.udf(f, kind)
        self.catalog.udfs[name.upper()] = udf

    def create_table_function(self, name: str, f: Any) -> None:
        """A table function for CALL: a Python UDTF, or a function of the session and the arguments to a frame."""
        self.table_functions[name.upper()] = (lambda session, *args: f(*[F.lit(a) for a in args])) if hasattr(f, "returnType") else f

    def timed(self, statement: Any, params: dict) -> DataFrame:
        began = time.time()
        df = self.run(statement, params)
        n = df._jdf.queryExecution().toRdd().count()  # the very plan of the frame, whose metrics fill in
        self.profile = {"seconds": time.time() - began, "rows": n}
        return df


class Prepared:
    """A parsed text that runs again with other parameters."""

    def __init__(self, session: Session, statements: list):
        self.session, self.statements = session, statements

    def execute(self, **params: Any) -> DataFrame:
        result = None
        for s in self.statements:
            result = self.session.run(s, params)
        return result
