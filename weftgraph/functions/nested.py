"""List, array, map, struct, union, node, relationship and path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError
from ..plans.types import is_integral, to_string
from .registry import Value, function, simple
from .strings import char_at

simple("LIST_CREATION ARRAY_VALUE", lambda *c: F.array(*c), "(ANY) -> LIST", 0, None)
simple("LIST_CONCAT LIST_CAT ARRAY_CONCAT ARRAY_CAT", lambda a, b: F.concat(a, b), "(LIST,LIST) -> LIST", 2)
simple("LIST_APPEND ARRAY_APPEND ARRAY_PUSH_BACK", lambda a, x: F.when(a.isNotNull(), F.array_append(a, x)), "(LIST,ANY) -> LIST", 2)
simple("LIST_PREPEND ARRAY_PREPEND ARRAY_PUSH_FRONT", lambda a, x: F.when(a.isNotNull(), F.array_prepend(a, x)), "(LIST,ANY) -> LIST", 2)
simple("LIST_DISTINCT", lambda a: F.array_distinct(F.array_compact(a)), "(LIST) -> LIST")
simple("LIST_UNIQUE", lambda a: F.size(F.array_distinct(F.array_compact(a))).cast("long"), "(LIST) -> INT64")
simple("LIST_ANY_VALUE", lambda a: F.get(F.array_compact(a), F.lit(0)), "(LIST) -> ANY")
simple("LIST_REVERSE", F.reverse, "(LIST) -> LIST")
simple("LIST_TO_STRING", lambda sep, a: F.call_function("array_join", a.cast("array<string>"), sep), "(STRING,LIST) -> STRING", 2)
simple("LIST_HAS_ALL", lambda a, b: F.size(F.array_except(F.array_compact(b), a)) == 0, "(LIST,LIST) -> BOOL", 2)


@function("RANGE", "(T,T[,T]) -> LIST", 2, 3)
def range_(a: Value, b: Value, step: Value | None = None):
    by = step.c if step else F.lit(1)
    wrong = ((by > 0) & (a.c > b.c)) | ((by < 0) & (a.c < b.c))
    zero = F.when(by == 0, F.raise_error(F.lit("Step of range cannot be 0.")).cast("long")).otherwise(by)
    safe = F.when(wrong, F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.sequence(a.c.cast("long"), b.c.cast("long"), zero.cast("long")))
    safe = F.when(wrong, F.slice(safe, 1, 0)).otherwise(safe)
    kind = a.t if is_integral(a.t) else T.LongType()
    return safe.cast(T.ArrayType(kind))


@function("LIST_EXTRACT LIST_ELEMENT ARRAY_EXTRACT", "(LIST,INT64) -> ANY", 2)
def list_extract(a: Value, i: Value):
    if isinstance(a.t, T.StringType):
        return char_at(a.c, i.c)
    if isinstance(a.t, T.MapType):
        return F.element_at(a.c, i.c)
    return F.element_at(a.c, i.c.cast("int"))


@function("LIST_POSITION LIST_INDEXOF ARRAY_POSITION ARRAY_INDEXOF", "(LIST,ANY) -> INT64", 2)
def list_position(a: Value, x: Value):
    return F.array_position(a.c, x.c).cast("long") if _fits(a, x) else F.when(a.c.isNotNull(), F.lit(0).cast("long"))


@function("LIST_CONTAINS LIST_HAS ARRAY_CONTAINS ARRAY_HAS", "(LIST,ANY) -> BOOL", 2)
def list_contains(a: Value, x: Value):
    if not _fits(a, x):
        return F.when(a.c.isNotNull() & x.c.isNotNull(), F.lit(False))
    return F.when(a.c.isNotNull() & x.c.isNotNull(), F.coalesce(F.array_contains(a.c, x.c), F.lit(False)))


def _fits(a: Value, x: Value) -> bool:
    if not isinstance(a.t, T.ArrayType):
        raise QueryError("a list is needed")
    e = a.t.elementType
    return type(e) is type(x.t) or isinstance(e, T.NumericType) and isinstance(x.t, T.NumericType)


@function("LIST_SLICE ARRAY_SLICE", "(LIST,INT64,INT64) -> LIST", 3)
def list_slice(a: Value, low: Value, high: Value):
    """Both ends belong to it, counted from 1, negative from the end; what lies outside is left out."""
    n = F.length(a.c) if isinstance(a.t, T.StringType) else F.size(a.c)
    first = F.greatest(F.when(low.c < 0, n + low.c + 1).when(low.c == 0, 1).otherwise(low.c), F.lit(1)).cast("int")
    last = F.least(F.when(high.c < 0, n + high.c + 1).when(high.c == 0, n).otherwise(high.c), n).cast("int")
    size = F.greatest(last - first + 1, F.lit(0))
    if isinstance(a.t, T.StringType):
        return F.substring(a.c, first, size)
    return F.slice(a.c, first, size)


def _ordered(a: Value, down: bool, nulls_first: bool):
    bare = F.sort_array(F.array_compact(a.c), not down)
    nulls = F.filter(a.c, lambda x: x.isNull())
    return F.concat(nulls, bare) if nulls_first else F.concat(bare, nulls)


@function("LIST_SORT", "(LIST[,STRING[,STRING]]) -> LIST", 1, 3)
def list_sort(a: Value, way: Value | None = None, nulls: Value | None = None):
    down = way is not None and str(way.constant).upper() == "DESC"
    return _ordered(a, down, nulls is None or "FIRST" in str(nulls.constant).upper())


@function("LIST_REVERSE_SORT", "(LIST[,STRING]) -> LIST", 1, 2)
def list_reverse_sort(a: Value, nulls: Value | None = None):
    return _ordered(a, True, nulls is None or "FIRST" in str(nulls.constant).upper())


def _fold(a: Value, start: int, step):
    e = a.t.elementType if isinstance(a.t, T.ArrayType) else T.LongType()
    wide = T.LongType() if is_integral(e) and not isinstance(e, T.DecimalType) else e
    return F.aggregate(F.array_compact(a.c), F.lit(start).cast(wide), lambda s, x: step(s, x.cast(wide)).cast(wide))


function("LIST_SUM", "(LIST) -> N")(lambda a: _fold(a, 0, lambda s, x: s + x))
function("LIST_PRODUCT", "(LIST) -> N")(lambda a: _fold(a, 1, lambda s, x: s * x))


@function("SIZE CARDINALITY", "(LIST) -> INT64 and maps, strings")
def size(a: Value):
    return (F.length(a.c) if isinstance(a.t, T.StringType) else F.size(a.c)).cast("long")


# --- vectors
def _sum(c: Column, kind: str) -> Column:
    return F.aggregate(c, F.lit(0.0).cast(kind), lambda s, x: (s + x).cast(kind))


def _vectors(a: Value, b: Value) -> tuple[Column, Column, str]:
    kind = "float" if all(isinstance(x.t, T.ArrayType) and isinstance(x.t.elementType, T.FloatType) for x in (a, b)) else "double"
    return a.c.cast(f"array<{kind}>"), b.c.cast(f"array<{kind}>"), kind


def _dot(x: Column, y: Column, kind: str) -> Column:
    return _sum(F.zip_with(x, y, lambda p, q: (p * q).cast(kind)), kind)


def _squared(a: Value, b: Value) -> tuple[Column, str]:
    x, y, kind = _vectors(a, b)
    return _sum(F.zip_with(x, y, lambda p, q: ((p - q) * (p - q)).cast(kind)), kind), kind


@function("ARRAY_INNER_PRODUCT ARRAY_DOT_PRODUCT", "(ARRAY,ARRAY) -> F", 2)
def inner_product(a: Value, b: Value):
    return _dot(*_vectors(a, b))


@function("ARRAY_SQUARED_DISTANCE", "(ARRAY,ARRAY) -> F", 2)
def squared_distance(a: Value, b: Value):
    return _squared(a, b)[0]


@function("ARRAY_DISTANCE", "(ARRAY,ARRAY) -> F", 2)
def distance(a: Value, b: Value):
    s, kind = _squared(a, b)
    return F.sqrt(s).cast(kind)


@function("ARRAY_COSINE_SIMILARITY", "(ARRAY,ARRAY) -> F", 2)
def cosine(a: Value, b: Value):
    x, y, kind = _vectors(a, b)
    return (_dot(x, y, kind) / (F.sqrt(_dot(x, x, kind)) * F.sqrt(_dot(y, y, kind)))).cast(kind)


@function("ARRAY_CROSS_PRODUCT", "(ARRAY,ARRAY) -> ARRAY", 2)
def cross_product(a: Value, b: Value):
    x = [F.element_at(a.c, i) for i in (1, 2, 3)]
    y = [F.element_at(b.c, i) for i in (1, 2, 3)]
    return F.array(x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0])


# --- maps, structs, unions
simple("MAP", lambda k, v: F.map_from_arrays(k, v), "(LIST,LIST) -> MAP", 2)
simple("MAP_KEYS", F.map_keys, "(MAP) -> LIST")
simple("MAP_VALUES", F.map_values, "(MAP) -> LIST")


@function("MAP_EXTRACT ELEMENT_AT", "(MAP,ANY) -> LIST", 2)
def map_extract(m: Value, k: Value):
    if isinstance(m.t, T.ArrayType | T.StringType):
        return list_extract(m, k)
    hits = F.filter(F.map_entries(m.c), lambda e: e["key"] == k.c)
    return F.when(m.c.isNotNull(), F.transform(hits, lambda e: e["value"]))


@function("STRUCT_EXTRACT UNION_EXTRACT", "(STRUCT,STRING) -> ANY", 2)
def struct_extract(s: Value, field: Value):
    return s.c[str(field.constant)]


simple("UNION_TAG", lambda u: u["tag"], "(UNION) -> STRING")

# --- ids, nodes, relationships, paths
simple("INTERNAL_ID", lambda t, o: F.struct(t.cast("long").alias("table"), o.alias("offset")), "(INT64,INT64) -> INTERNAL_ID", 2)


@function("OFFSET", "(INTERNAL_ID) -> INT64")
def offset(i: Value):
    part = i.c["offset"]
    kind = i.t["offset"].dataType if isinstance(i.t, T.StructType) else T.LongType()
    return part.cast("long") if is_integral(kind) else F.xxhash64(part)


simple("NODES", lambda p: p["_NODES"], "(RECURSIVE_REL) -> LIST")
simple("RELS RELATIONSHIPS", lambda p: p["_RELS"], "(RECURSIVE_REL) -> LIST")


@function("PROPERTIES", "(LIST,STRING) -> LIST", 2)
def properties(a: Value, name: Value):
    key = str(name.constant)
    if isinstance(a.t, T.ArrayType) and key not in a.t.elementType.fieldNames():
        raise QueryError(f"there is no property {key}")
    return F.transform(a.c, lambda x: x[key])


def _once(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) == F.size(ids)


simple("IS_TRAIL", lambda p: _once(F.transform(p["_RELS"], lambda r: r["_ID"])), "(RECURSIVE_REL) -> BOOL")
simple("IS_ACYCLIC", lambda p: _once(F.transform(p["_NODES"], lambda n: n["_ID"])), "(RECURSIVE_REL) -> BOOL")


@function("TO_STRING STRING", "(T) -> STRING")
def to_string_(x: Value):
    return to_string(x.c, x.t)
