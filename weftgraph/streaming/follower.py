"""The follower store: a property graph fed by an append-only log of mutations, offline first.

Every successful change is one log entry with a rising local_seq. The log is a folder of JSON files that Spark
writes and reads; the graph is the log folded by a window over each id, so it needs no other storage, and a file
with a torn last line loses that line only. Controllers upstream get the entries in local_seq order, from a
Structured Streaming query over the folder or in one go.
"""

from __future__ import annotations

import json
import time
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import GraphCatalog
from ..operators.scope import Scope
from ..plans import syntax as S
from ..plans.compile import Compiler
from ..plans.lexer import QueryError
from ..plans.parser import parse
from ..session import Session

LOG_SCHEMA = "local_seq long, user string, device string, foreshadow boolean, op string, id string, label string, src string, dst string, props string, schema string"
#: A property's value carries its kind, as values of one property may differ (fixed values).
KINDS = ("Null", "Bool", "I64", "F64", "String", "Timestamp", "List")
_SPARK = {"Bool": "boolean", "I64": "long", "F64": "double", "String": "string", "Timestamp": "timestamp", "List": "string", "Null": "string"}


class StoreError(QueryError):
    """A change that the store rejects; nothing is logged for it."""


class Transient(Exception):
    """A controller's failure that is worth another try."""


class Permanent(Exception):
    """A controller's failure that drops the mutation."""


class Controller(Protocol):
    def connect(self) -> None: ...
    def apply(self, mutation: dict[str, Any]) -> None: ...
    def flush(self) -> None: ...


@dataclass
class Timestamp:
    ms: int


@dataclass
class Schema:
    """Labels and the kinds of declared properties; a newer version replaces an older one as a whole."""

    version: int
    nodes: dict[str, dict[str, str]] = field(default_factory=dict)
    edges: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class Config:
    """What a follower may do and who it is, from TOML."""

    user: str = "local"
    device: str = "local"
    foreshadow: bool = False
    can_write: bool = True
    retry_ms: int = 100
    most_retries: int = 8

    @classmethod
    def from_toml(cls, text: str) -> Config:
        raw = tomllib.loads(text)
        flat = {k: v for part in raw.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)}
        unknown = set(flat) - set(cls.__dataclass_fields__)
        if unknown:
            raise StoreError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**flat)


def kind_of(v: Any) -> str:
    if v is None:
        return "Null"
    if isinstance(v, bool):
        return "Bool"
    if isinstance(v, int):
        return "I64"
    if isinstance(v, float):
        return "F64"
    if isinstance(v, str):
        return "String"
    if isinstance(v, Timestamp):
        return "Timestamp"
    if isinstance(v, list | tuple):
        return "List"
    raise StoreError(f"a property can't be a {type(v).__name__}")


def _encoded(props: dict[str, Any]) -> str:
    plain = lambda v: v.ms if isinstance(v, Timestamp) else [plain(x) for x in v] if isinstance(v, list | tuple) else v
    return json.dumps({k: {"k": kind_of(v), "v": json.dumps(plain(v))} for k, v in sorted(props.items())})


class FollowerStore:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.seq = 0
        self.schema: Schema | None = None
        self._open()

    def _open(self) -> None:
        log = self.log()
        last = log.agg(F.max("local_seq")).first()[0]
        self.seq = last or 0
        pushed = log.where("op = 'SchemaApply'").orderBy(F.desc("local_seq")).limit(1).first()
        if pushed:
            self.schema = Schema(**json.loads(pushed.schema))

    # --- the log
    def log(self) -> DataFrame:
        """All entries; a line that was cut short by a crash is left out."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(f"{self.path}/log").where("local_seq IS NOT NULL")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG_SCHEMA)
            raise

    def _commit(self, rows: list[dict[str, Any]], foreshadow: bool | None = None) -> None:
        if not self.config.can_write and any(r["op"] != "SchemaApply" for r in rows):
            raise StoreError("this follower may not write")
        mark = self.config.foreshadow if foreshadow is None else foreshadow
        names = [f.split()[0] for f in LOG_SCHEMA.split(", ")]
        made = []
        for r in rows:
            self.seq += 1
            full = {"local_seq": self.seq, "user": self.config.user, "device": self.config.device, "foreshadow": mark} | r
            made.append(tuple(full.get(n) for n in names))
        self.spark.createDataFrame(made, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/log")

    # --- the graph: the log folded
    def _folded(self, inserted: str, deleted: str) -> DataFrame:
        last = F.row_number().over(W.partitionBy("id").orderBy(F.desc("local_seq")))
        mine = self.log().where(F.col("op").isin(inserted, deleted))
        return mine.withColumn("__n", last).where(f"__n = 1 AND op = '{inserted}'").drop("__n")

    def nodes(self) -> DataFrame:
        return self._folded("NodeInsert", "NodeDelete").select("id", "label", "props", "foreshadow", "local_seq")

    def edges(self) -> DataFrame:
        return self._folded("EdgeInsert", "EdgeDelete").select("id", "label", "src", "dst", "props", "foreshadow", "local_seq")

    def edges_by_label(self, label: str) -> DataFrame:
        return self.edges().where(F.col("label") == label)

    def edges_from(self, node: str) -> DataFrame:
        return self.edges().where(F.col("src") == node)

    def edges_incident_to(self, node: str) -> DataFrame:
        return self.edges().where((F.col("src") == node) | (F.col("dst") == node))

    def get_node(self, node: str) -> dict[str, Any] | None:
        r = self.nodes().where(F.col("id") == node).first()
        return r and {"id": r.id, "label": r.label, "properties": decoded(r.props)}

    def get_edge(self, edge: str) -> dict[str, Any] | None:
        r = self.edges().where(F.col("id") == edge).first()
        return r and {"id": r.id, "label": r.label, "from": r.src, "to": r.dst, "properties": decoded(r.props)}

    def has_node(self, node: str) -> bool:
        return not self.nodes().where(F.col("id") == node).isEmpty()

    def has_edge(self, edge: str) -> bool:
        return not self.edges().where(F.col("id") == edge).isEmpty()

    # --- changes
    def _check(self, known: dict[str, dict[str, str]] | None, label: str, props: dict[str, Any]) -> None:
        if known is None:
            return
        if label not in known:
            raise StoreError(f"label {label} isn't in the schema")
        for k, v in props.items():
            want = known[label].get(k)
            if want and kind_of(v) not in (want, "Null"):
                raise StoreError(f"property {k} of {label} is a {want}, not a {kind_of(v)}")

    def insert_node(self, node: str, label: str, foreshadow: bool | None = None, **props: Any) -> None:
        self.insert_nodes([(node, label, props)], foreshadow)

    def insert_nodes(self, rows: list[tuple[str, str, dict]], foreshadow: bool | None = None) -> None:
        """Several nodes in one log file: all of them or none."""
        ids = [r[0] for r in rows]
        for _, label, props in rows:
            self._check(self.schema and self.schema.nodes, label, props)
        if len(set(ids)) < len(ids) or not self.nodes().where(F.col("id").isin(ids)).isEmpty():
            raise StoreError("a node with this id exists")
        self._commit([{"op": "NodeInsert", "id": i, "label": label, "props": _encoded(p)} for i, label, p in rows], foreshadow)

    def insert_edge(self, edge: str, label: str, src: str, dst: str, foreshadow: bool | None = None, **props: Any) -> None:
        self._check(self.schema and self.schema.edges, label, props)
        if self.has_edge(edge):
            raise StoreError("an edge with this id exists")
        if self.nodes().where(F.col("id").isin(src, dst)).count() < len({src, dst}):
            raise StoreError("an end of the edge doesn't exist")
        self._commit([{"op": "EdgeInsert", "id": edge, "label": label, "src": src, "dst": dst, "props": _encoded(props)}], foreshadow)

    def delete_node(self, node: str) -> None:
        """Removes the node alone: edges that touched it stay."""
        if not self.has_node(node):
            raise StoreError("there is no such node")
        self._commit([{"op": "NodeDelete", "id": node}])

    def delete_node_with_cascade(self, node: str) -> int:
        """Removes the node and its edges; how many edges went."""
        if not self.has_node(node):
            raise StoreError("there is no such node")
        ids = [r.id for r in self.edges_incident_to(node).select("id").collect()]
        self._commit([*({"op": "EdgeDelete", "id": i} for i in sorted(ids)), {"op": "NodeDelete", "id": node}])
        return len(ids)

    def delete_edge(self, edge: str) -> None:
        if not self.has_edge(edge):
            raise StoreError("there is no such edge")
        self._commit([{"op": "EdgeDelete", "id": edge}])

    def apply_schema(self, schema: Schema) -> bool:
        """Takes a newer schema; an older or equal version changes nothing."""
        if self.schema and schema.version <= self.schema.version:
            return False
        self._commit([{"op": "SchemaApply", "schema": json.dumps(schema.__dict__)}])
        self.schema = schema
        return True

    # --- queries
    def session(self) -> Session:
        """A session over the folded graph; each label's properties become columns of their kinds."""
        g = GraphCatalog(self.spark)
        version = self.schema.version if self.schema else None
        nodes = self._typed(self.nodes(), ["id"], version)
        for label, df in nodes.items():
            g.add_nodes(label, df, "id")
        labels = self.nodes().select(F.col("id").alias("nid"), F.col("label").alias("nlabel"))
        ends = (
            self.edges().join(labels.select(F.col("nid").alias("src"), F.col("nlabel").alias("sl")), "src")
            .join(labels.select(F.col("nid").alias("dst"), F.col("nlabel").alias("dl")), "dst")
        )
        for r in ends.select("label", "sl", "dl").distinct().collect():
            part = ends.where((F.col("label") == r.label) & (F.col("sl") == r.sl) & (F.col("dl") == r.dl))
            for df in self._typed(part, ["id", "src", "dst"], version).values():
                props = [c for c in df.columns if c not in ("src", "dst")]
                g.add_rels(r.label, df, (r.sl, "src"), (r.dl, "dst"), props)
        return Session(self.spark, g, "follower")

    def _typed(self, rows: DataFrame, keep: list[str], version: int | None) -> dict[str, DataFrame]:
        parsed = rows.withColumn("__p", F.from_json("props", "map<string, struct<k: string, v: string>>"))
        kinds = parsed.select("label", F.explode_outer("__p").alias("name", "value")).groupBy("label", "name").agg(F.collect_set("value.k").alias("ks")).collect()
        found: dict[str, dict[str, str]] = {}
        for r in kinds:
            mine = found.setdefault(r.label, {})
            if r.name is not None:
                ks = set(r.ks) - {"Null"}
                mine[r.name] = ks.pop() if len(ks) == 1 else "F64" if ks == {"I64", "F64"} else "String" if ks else "Null"
        out = {}
        for label, props in found.items():
            cols = [F.col(k) for k in keep]
            for name, kind in sorted(props.items()):
                if name in keep:
                    continue
                raw = F.element_at("__p", F.lit(name))["v"]
                text = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x")).when(raw != "null", raw)
                value = F.timestamp_millis(text.cast("long")).cast("timestamp") if kind == "Timestamp" else text.cast(_SPARK[kind])
                cols.append(value.alias(name))
            cols += [F.col("foreshadow").alias("_meta_foreshadow"), F.lit(version).cast("long").alias("_meta_schema_version")]
            out[label] = parsed.where(F.col("label") == label).select(*cols)
        return out

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Reads go to the folded graph; CREATE, MERGE and DELETE become changes of the store."""
        result = None
        for q in parse(text, "follower"):
            if not isinstance(q, S.Query) or len(q.parts) != 1:
                raise QueryError("a follower takes single queries")
            result = self._one(q, params or {})
        return result

    def _one(self, q: S.Query, params: dict[str, Any]) -> DataFrame:
        clauses = q.parts[0]
        session = self.session()
        write = next((c for c in clauses if isinstance(c, S.Create | S.Merge | S.Delete)), None)
        if write is None:
            return session.run_query(q, params)
        if isinstance(write, S.Delete):
            return self._delete(session, clauses, write, params)
        c = Compiler(session, Scope(None, {}), params)
        patterns = write.patterns if isinstance(write, S.Create) else write.pattern
        made = 0
        for path in patterns:
            ids = []
            for n in path.nodes:
                props = {k: self._constant(c, e) for k, e in n.props.items()}
                node = str(props.pop("id", None) or uuid.uuid4())
                ids.append(node)
                if (isinstance(write, S.Merge) or not n.labels) and self.has_node(node):
                    continue
                if len(n.labels) != 1:
                    raise QueryError("a created node has one label")
                self.insert_node(node, n.labels[0], **props)
                made += 1
            for k, r in enumerate(path.rels):
                props = {x: self._constant(c, e) for x, e in r.props.items()}
                edge = str(props.pop("id", None) or uuid.uuid4())
                if isinstance(write, S.Merge) and self.has_edge(edge):
                    continue
                a, b = (ids[k + 1], ids[k]) if r.direction == "<-" else (ids[k], ids[k + 1])
                self.insert_edge(edge, r.types[0], a, b, **props)
                made += 1
        return self.spark.createDataFrame([(made,)], "created long")

    @staticmethod
    def _constant(c: Compiler, e: S.Expr) -> Any:
        return [FollowerStore._constant(c, x) for x in e.items] if isinstance(e, S.ListOf) else c.constant(e)

    def _delete(self, session: Session, clauses: list, write: S.Delete, params: dict[str, Any]) -> DataFrame:
        before = clauses[: clauses.index(write)]
        rels = {r.var for m in before if isinstance(m, S.Match) for p in m.patterns for r in p.rels}
        names = [e.name for e in write.exprs if isinstance(e, S.Var)]
        if set(names) & rels:
            raise QueryError("DeleteEdgeUnsupported")
        items = [S.Item(S.Call("ID", [S.Var(n)]), n) for n in names]
        rows = session.run_query(S.Query([[*before, S.Return(S.Projection(items, True))]]), params).collect()
        gone = sorted({v for r in rows for v in r if v is not None})
        for node in gone:
            if write.detach:
                self.delete_node_with_cascade(node)
            else:
                self.delete_node(node)
        return self.spark.createDataFrame([(len(gone),)], "deleted long")

    # --- upstream
    def _deliver(self, controller: Controller, rows: list, sleep: Callable[[float], None]) -> None:
        for r in sorted(rows, key=lambda r: r.local_seq):
            wait = self.config.retry_ms / 1000
            for attempt in range(self.config.most_retries + 1):
                try:
                    controller.apply(r.asDict())
                    break
                except Permanent:
                    break
                except Transient:
                    if attempt == self.config.most_retries:
                        raise
                    sleep(wait)
                    wait *= 2

    def sync(self, controller: Controller, checkpoint: str, sleep: Callable[[float], None] = time.sleep) -> None:
        """Feeds all entries that the controller hasn't had yet, in order, and returns.

        The streaming query's checkpoint remembers what was delivered; a failed batch is delivered again. A batch
        of the log is one follower's own changes, small by nature, and goes through the driver entry by entry.
        """
        controller.connect()
        stream = self.spark.readStream.schema(LOG_SCHEMA).json(f"{self.path}/log")
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self._deliver(controller, df.where("local_seq IS NOT NULL").collect(), sleep)).start()
        query.awaitTermination()
        controller.flush()

    def replay_unconfirmed(self, controller: Controller, sleep: Callable[[float], None] = time.sleep) -> int:
        """Feeds the foreshadowed entries again, in order; how many there were."""
        rows = self.log().where("foreshadow").orderBy("local_seq").collect()
        controller.connect()
        self._deliver(controller, rows, sleep)
        controller.flush()
        return len(rows)


def decoded(props: str) -> dict[str, Any]:
    return {k: Timestamp(json.loads(v["v"])) if v["k"] == "Timestamp" else json.loads(v["v"]) for k, v in json.loads(props or "{}").items()}
