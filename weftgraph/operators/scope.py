"""What a query part has bound: a frame and the variables that its columns stand for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError


@dataclass
class Bound:
    """A variable. Nodes and relationships are spread over columns `name$property`; values have one column."""

    kind: str  # node, rel, walk (a recursive relationship), value
    name: str
    labels: list[str] = field(default_factory=list)
    props: dict[str, T.DataType] = field(default_factory=dict)
    ends: tuple[str, str] | None = None  # the node variables of a relationship

    def col(self, part: str = "") -> Column:
        return F.col(f"`{self.name}${part}`") if part else F.col(f"`{self.name}`")

    def columns(self) -> list[str]:
        if self.kind == "node":
            return [f"{self.name}${p}" for p in ("_key", "_label", *self.props)]
        if self.kind == "rel":
            return [f"{self.name}${p}" for p in ("_src", "_dst", "_label", "_rid", "_slabel", "_dlabel", *self.props)]
        if self.kind == "walk":
            return [f"{self.name}${p}" for p in ("_length", "_cost", "_path")]
        return [self.name]


@dataclass
class Scope:
    df: DataFrame | None
    vars: dict[str, Bound] = field(default_factory=dict)

    def need(self, name: str) -> Bound:
        if name not in self.vars:
            raise QueryError(f"Variable {name} is not in scope.")
        return self.vars[name]

    def held(self) -> list[str]:
        """The variables' columns that the frame has."""
        have = set(self.df.columns) if self.df is not None else set()
        return [c for b in self.vars.values() for c in b.columns() if c in have]


def super_type(kinds: list[T.DataType]) -> T.DataType:
    """One type for a property that several labels have."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.NumericType) for k in kinds):
        if any(isinstance(k, T.DoubleType | T.FloatType) for k in kinds):
            return T.DoubleType()
        if any(isinstance(k, T.DecimalType) for k in kinds):
            return T.DecimalType(38, max([0, *(k.scale for k in kinds if isinstance(k, T.DecimalType))]))
        order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
        return max(kinds, key=lambda k: order.index(type(k)))
    return T.StringType()
