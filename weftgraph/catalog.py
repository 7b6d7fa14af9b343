"""The graph catalog: node and relationship tables over data frames, and the other named things of a database."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.lexer import QueryError
from .plans.types import parse_type, type_name


@dataclass
class Column:
    name: str
    kind: str  # as declared
    type: T.DataType
    default: Any = None


@dataclass
class NodeTable:
    name: str
    number: int
    columns: list[Column]
    key: str
    df: DataFrame
    comment: str = ""

    @property
    def props(self) -> dict[str, T.DataType]:
        return {c.name: c.type for c in self.columns}


@dataclass
class RelTable:
    """Relationships by (source label, target label); frames have _src, _dst and the properties, maybe _rid."""

    name: str
    number: int
    columns: list[Column]
    frames: dict[tuple[str, str], DataFrame]
    multiplicity: str = "MANY_MANY"
    comment: str = ""

    @property
    def props(self) -> dict[str, T.DataType]:
        return {c.name: c.type for c in self.columns}


@dataclass
class Sequence:
    name: str
    start: int = 0
    increment: int = 1
    low: int = 0
    high: int = (1 << 63) - 1
    cycle: bool = False
    last: int | None = None

    def take(self, n: int = 1) -> int:
        """Advances by n values; the first of them."""
        first = self.start if self.last is None else self._next(self.last)
        if n > 1 and not self.cycle and not self.low <= first + (n - 1) * self.increment <= self.high:
            raise QueryError(f"sequence {self.name} has reached its end")
        self.last = self.at(first, n - 1)
        return first

    def _turn(self, first: int) -> tuple[int, int, int]:
        """How many values there are from `first` to the end, in a whole turn, and where a turn begins."""
        begin, end = (self.low, self.high) if self.increment > 0 else (self.high, self.low)
        return (end - first) // self.increment + 1, (end - begin) // self.increment + 1, begin

    def at(self, first: int, place: int) -> int:
        """The value `place` steps after `first`."""
        ahead, turn, begin = self._turn(first)
        return first + place * self.increment if place < ahead else begin + (place - ahead) % turn * self.increment

    def column(self, first: int, place: SparkColumn) -> SparkColumn:
        """The same of a column of places."""
        ahead, turn, begin = (F.lit(str(x)).cast("decimal(38,0)") for x in self._turn(first))
        straight, p = F.lit(first) + place * F.lit(self.increment), place.cast("decimal(38,0)")
        if not self.cycle:
            return straight
        return F.when(p < ahead, straight).otherwise((begin + (p - ahead) % turn * F.lit(self.increment)).cast("long"))

    def _next(self, value: int) -> int:
        value += self.increment
        if not self.low <= value <= self.high:
            if not self.cycle:
                raise QueryError(f"sequence {self.name} has reached its end")
            value = self.low if self.increment > 0 else self.high
        return value


@dataclass
class Projected:
    name: str
    nodes: dict[str, str | None]
    rels: dict[str, str | None]
    query: str | None = None


@dataclass
class GraphCatalog:
    """Frames are immutable, so a copy of the dictionaries is a snapshot: that is all a transaction needs."""

    spark: SparkSession
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    rels: dict[str, RelTable] = field(default_factory=dict)
    sequences: dict[str, Sequence] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    macros: dict[str, tuple[list, Any]] = field(default_factory=dict)
    udfs: dict[str, Callable] = field(default_factory=dict)
    projected: dict[str, Projected] = field(default_factory=dict)
    version: int = 0

    def snapshot(self) -> GraphCatalog:
        copied = copy.copy(self)
        for name in ("nodes", "rels", "sequences"):
            setattr(copied, name, {k: copy.copy(v) for k, v in getattr(self, name).items()})
        for r in copied.rels.values():
            r.frames = dict(r.frames)
        for name in ("types", "macros", "udfs", "projected"):
            setattr(copied, name, dict(getattr(self, name)))
        return copied

    def restore(self, other: GraphCatalog) -> None:
        self.__dict__.update(other.__dict__)

    def _number(self) -> int:
        self.version += 1
        return max([-1, *(t.number for t in [*self.nodes.values(), *self.rels.values()])]) + 1

    def _free(self, name: str) -> None:
        if name in self.nodes or name in self.rels:
            raise QueryError(f"{name} already exists in catalog.")

    # --- registration of existing frames
    def add_nodes(self, name: str, df: DataFrame, key: str) -> NodeTable:
        """Registers a frame as a node table; its key column must be unique and not null."""
        self._free(name)
        if key not in df.columns:
            raise QueryError(f"{name} has no column {key}")
        self.nodes[name] = NodeTable(name, self._number(), [Column(f.name, type_name(f.dataType), f.dataType) for f in df.schema.fields], key, df)
        return self.nodes[name]

    def add_rels(self, name: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], props: list[str] | dict[str, str] | None = None, multiplicity: str = "MANY_MANY", rid: str | None = None) -> RelTable:
        """Registers a frame as relationships: (label, column) of both ends, and the properties to keep.

        The columns hold primary keys of the two labels. A further frame under the same name adds a pair of labels.
        """
        for label, _ in (src, dst):
            if label not in self.nodes:
                raise QueryError(f"table {label} does not exist.")
        renamed = props if isinstance(props, dict) else {p: p for p in props or []}
        made = df.select(F.col(src[1]).alias("_src"), F.col(dst[1]).alias("_dst"), *[F.col(c).alias(p) for p, c in renamed.items()], *([F.col(rid).alias("_rid")] if rid else []))
        columns = [Column(f.name, type_name(f.dataType), f.dataType) for f in made.schema.fields if f.name in renamed]
        table = self.rels.get(name)
        if table is None:
            self._free(name)
            table = self.rels[name] = RelTable(name, self._number(), columns, {}, multiplicity)
        table.frames[src[0], dst[0]] = made
        return table

    # --- empty tables by declaration
    def declare(self, columns: list[tuple[str, str, Any]]) -> list[Column]:
        made = [Column(n, k, parse_type(k, self.types), d) for n, k, d in columns]
        if len({c.name for c in made}) < len(made):
            raise QueryError("a property is declared twice")
        return made

    def create_node_table(self, name: str, columns: list[tuple[str, str, Any]], key: str | None) -> NodeTable:
        self._free(name)
        made = self.declare(columns)
        if key is None:
            raise QueryError("a node table needs a primary key")
        if key not in {c.name for c in made}:
            raise QueryError(f"primary key {key} is no property")
        empty = self.spark.createDataFrame([], T.StructType([T.StructField(c.name, c.type) for c in made]))
        self.nodes[name] = NodeTable(name, self._number(), made, key, empty)
        for c in made:
            if c.kind.upper() == "SERIAL":
                self.sequences[f"{name}_{c.name}_serial"] = Sequence(f"{name}_{c.name}_serial")
        return self.nodes[name]

    def create_rel_table(self, name: str, columns: list[tuple[str, str, Any]], ends: list[tuple[str, str]], multiplicity: str) -> RelTable:
        self._free(name)
        made = self.declare(columns)
        table = RelTable(name, self._number(), made, {}, multiplicity)
        for a, b in ends:
            table.frames[a, b] = self.empty_rels(made, a, b)
        if not ends:
            raise QueryError("a relationship table needs FROM and TO")
        self.rels[name] = table
        return table

    def empty_rels(self, columns: list[Column], a: str, b: str) -> DataFrame:
        for label in (a, b):
            if label not in self.nodes:
                raise QueryError(f"Node table {label} does not exist.")
        ends = [T.StructField(n, self.nodes[t].props[self.nodes[t].key]) for n, t in (("_src", a), ("_dst", b))]
        more = [T.StructField(c.name, c.type) for c in columns]
        return self.spark.createDataFrame([], T.StructType([*ends, *more, T.StructField("_rid", T.LongType())]))

    def sequence(self, name: str) -> Sequence:
        if name not in self.sequences:
            raise QueryError(f"sequence {name} does not exist")
        return self.sequences[name]

    def table(self, name: str) -> NodeTable | RelTable:
        found = self.nodes.get(name) or self.rels.get(name)
        if found is None:
            raise QueryError(f"{name} does not exist in catalog.")
        return found
