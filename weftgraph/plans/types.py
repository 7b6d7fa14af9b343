"""The type names of the query language over Spark's types, and casts between them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexer import QueryError

INTERVAL = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])

#: Whole-number types: Spark type and value range (fixed values).
_BITS = {"INT8": 8, "INT16": 16, "INT32": 32, "INT64": 64, "SERIAL": 64, "INT128": 128, "UINT8": 8, "UINT16": 16, "UINT32": 32, "UINT64": 64, "UINT128": 128}
_SIMPLE: dict[str, T.DataType] = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT": T.IntegerType(),
    "INT64": T.LongType(), "SERIAL": T.LongType(), "INT128": T.DecimalType(38, 0), "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(),
    "UINT64": T.DecimalType(20, 0), "UINT128": T.DecimalType(38, 0), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "FLOAT8": T.DoubleType(),
    "STRING": T.StringType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "UUID": T.StringType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_NS": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_SEC": T.TimestampNTZType(),
    "TIMESTAMP_TZ": T.TimestampType(), "INTERVAL": INTERVAL, "DURATION": INTERVAL, "JSON": T.StringType(), "ANY": T.StringType(),
}


def _split(text: str) -> list[str]:
    """Parts between the commas that no bracket holds."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


def parse_type(name: str, own: dict[str, str] | None = None) -> T.DataType:
    name = name.strip()
    own = own or {}
    if m := re.fullmatch(r"(.*)\[(\d*)\]", name, re.S):
        return T.ArrayType(parse_type(m[1], own))
    up = name.upper()
    if up in _SIMPLE:
        return _SIMPLE[up]
    if m := re.fullmatch(r"(DECIMAL|NUMERIC)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", name, re.I):
        p, s = int(m[2] or 18), int(m[3] or (3 if not m[2] else 0))
        if p > 38:
            raise QueryError("precision of DECIMAL is at most 38")
        return T.DecimalType(p, s)
    if m := re.fullmatch(r"STRUCT\s*\((.*)\)", name, re.I | re.S):
        return T.StructType([T.StructField(f.split(None, 1)[0].strip("`"), parse_type(f.split(None, 1)[1], own)) for f in _split(m[1])])
    if m := re.fullmatch(r"UNION\s*\((.*)\)", name, re.I | re.S):
        tags = [T.StructField(f.split(None, 1)[0].strip("`"), parse_type(f.split(None, 1)[1], own)) for f in _split(m[1])]
        return T.StructType([T.StructField("tag", T.StringType()), *tags])
    if m := re.fullmatch(r"MAP\s*\((.*)\)", name, re.I | re.S):
        key, value = _split(m[1])
        return T.MapType(parse_type(key, own), parse_type(value, own))
    for alias, meant in own.items():
        if alias.upper() == up:
            return parse_type(meant, own)
    raise QueryError(f"type {name} is unknown")


def is_interval(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == INTERVAL.fieldNames()


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType) or isinstance(t, T.DecimalType) and t.scale == 0


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, T.TimestampType | T.TimestampNTZType)


def type_name(t: T.DataType) -> str:
    if is_interval(t):
        return "INTERVAL"
    if isinstance(t, T.DecimalType):
        return "INT128" if (t.precision, t.scale) == (38, 0) else "UINT64" if (t.precision, t.scale) == (20, 0) else f"DECIMAL({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"{type_name(t.elementType)}[]"
    if isinstance(t, T.MapType):
        return f"MAP({type_name(t.keyType)}, {type_name(t.valueType)})"
    if isinstance(t, T.StructType):
        if t.fieldNames()[:1] == ["tag"]:
            return "UNION(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in t.fields[1:]) + ")"
        if "_ID" in t.fieldNames():
            return "REL" if "_SRC" in t.fieldNames() else "NODE"
        if t.fieldNames() == ["_NODES", "_RELS"]:
            return "RECURSIVE_REL"
        return "STRUCT(" + ", ".join(f"{f.name} {type_name(f.dataType)}" for f in t.fields) + ")"
    named = {
        T.BooleanType: "BOOL", T.ByteType: "INT8", T.ShortType: "INT16", T.IntegerType: "INT32", T.LongType: "INT64", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
        T.StringType: "STRING", T.BinaryType: "BLOB", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP_TZ", T.NullType: "ANY",
    }
    return next((n for k, n in named.items() if isinstance(t, k)), t.simpleString().upper())


def micros_of(i: Column) -> Column:
    """An interval on one scale, months of thirty days."""
    return (i["months"].cast("long") * 30 + i["days"]) * 86_400_000_000 + i["micros"]


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(months).cast("int").alias("months"), as_col(days).cast("int").alias("days"), as_col(micros).cast("long").alias("micros"))


#: Units of an interval text: which part they count and how much of it (fixed values).
_UNITS = {
    "year": ("months", 12), "month": ("months", 1), "decade": ("months", 120), "century": ("months", 1200), "week": ("days", 7), "day": ("days", 1),
    "hour": ("micros", 3_600_000_000), "minute": ("micros", 60_000_000), "second": ("micros", 1_000_000), "millisecond": ("micros", 1_000), "microsecond": ("micros", 1),
}
_SPELT = {"year": "years?|yrs?|y", "month": "months?|mons?", "decade": "decades?", "century": "century|centuries", "week": "weeks?|w", "day": "days?|d", "hour": "hours?|hrs?|h", "minute": "minutes?|mins?|m", "second": "seconds?|secs?|s", "millisecond": "milliseconds?|msecs?|ms", "microsecond": "microseconds?|usecs?|us"}


def interval_from_string(s: Column) -> Column:
    """Adds up all `number unit` parts and one clock time of the text."""
    low = F.lower(s)
    totals = {"months": F.lit(0).cast("long"), "days": F.lit(0).cast("long"), "micros": F.lit(0).cast("long")}
    for unit, (part, times) in _UNITS.items():
        found = F.regexp_extract_all(low, F.lit(rf"([+-]?\d+)\s*(?:{_SPELT[unit]})(?![a-z])"), F.lit(1))
        totals[part] = totals[part] + F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) * times
    clock = F.regexp_extract(low, r"(-?)(\d+):(\d+):(\d+)(?:\.(\d+))?", 0)
    piece = lambda k: F.regexp_extract(low, r"(-?)(\d+):(\d+):(\d+)(?:\.(\d+))?", k)
    whole = (piece(2).cast("long") * 3600 + piece(3).cast("long") * 60 + piece(4).cast("long")) * 1_000_000 + F.rpad(F.coalesce(F.nullif(piece(5), F.lit("")), F.lit("0")), 6, "0").cast("long")
    totals["micros"] = totals["micros"] + F.when(clock == "", F.lit(0)).otherwise(F.when(piece(1) == "-", -whole).otherwise(whole))
    return F.when(s.isNotNull(), interval(totals["months"], totals["days"], totals["micros"]))


def interval_to_string(i: Column) -> Column:
    def some(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(" " + unit), F.when(F.abs(n) == 1, "").otherwise("s")))

    years, months = (i["months"] / 12).cast("int"), i["months"] % 12
    left = F.abs(i["micros"])
    sec = (left / 1_000_000).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    fraction = F.when(left % 1_000_000 != 0, F.concat(F.lit("."), F.regexp_replace(F.lpad((left % 1_000_000).cast("string"), 6, "0"), "0+$", ""))).otherwise("")
    clock = F.when(i["micros"] != 0, F.concat(F.when(i["micros"] < 0, "-").otherwise(""), two((sec / 3600).cast("long")), F.lit(":"), two((sec / 60).cast("long") % 60), F.lit(":"), two(sec % 60), fraction))
    text = F.concat_ws(" ", some(years, "year"), some(months, "month"), some(i["days"], "day"), clock)
    return F.when(i.isNotNull(), F.when(text == "", "00:00:00").otherwise(text))


def to_string(c: Column, t: T.DataType) -> Column:
    """The text of a value: True and False, [a,b], {k: v}, and so on."""
    if isinstance(t, T.StringType):
        return c
    if isinstance(t, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if is_interval(t):
        return interval_to_string(c)
    if isinstance(t, T.ArrayType):
        part = lambda x: F.coalesce(to_string(x, t.elementType), F.lit(""))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(c, part), ","), F.lit("]")))
    if isinstance(t, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(to_string(e["key"], t.keyType), F.lit("="), F.coalesce(to_string(e["value"], t.valueType), F.lit(""))))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")))
    if isinstance(t, T.StructType):
        if t.fieldNames()[:1] == ["tag"]:
            return F.coalesce(*[to_string(c[f.name], f.dataType) for f in t.fields[1:]])
        parts = [F.concat(F.lit(f"{f.name}: "), F.coalesce(to_string(c[f.name], f.dataType), F.lit(""))) for f in t.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    if isinstance(t, T.DoubleType | T.FloatType):
        plain = F.format_string("%.6f", c.cast("double"))
        return F.when(c.isNotNull(), F.when(F.abs(c) < 1e15, plain).otherwise(c.cast("string")))
    if is_time(t):
        return F.regexp_replace(c.cast("string"), r"(\.\d+?)0+$", "$1")
    return c.cast("string")


def cast(c: Column, have: T.DataType, want: T.DataType, name: str = "") -> Column:
    """A cast by the rules of the language: half-even from floats, half-up from decimals, range errors raise."""
    up = name.strip().upper()
    if is_interval(want):
        return c if is_interval(have) else interval_from_string(c.cast("string"))
    if isinstance(want, T.StringType):
        text = to_string(c, have)
        return F.lower(F.regexp_replace(text, r"[{}]", "")) if up == "UUID" else text
    if is_integral(want):
        if isinstance(have, T.FloatType | T.DoubleType):
            c = F.rint(c)
        elif isinstance(have, T.DecimalType) and have.scale:
            c = F.round(c, 0)
        elif isinstance(have, T.StringType):
            c = F.trim(c)
        out = c.cast(want)
        bits = _BITS.get(up)
        if bits and up.startswith("U"):
            top = F.lit(str((1 << bits) - 1) if bits < 128 else "9" * 38).cast("decimal(38,0)")
            bad = (c.cast("decimal(38,0)") < 0) | (c.cast("decimal(38,0)") > top)
            out = F.when(bad, F.raise_error(F.concat(F.lit("out of range of " + up + ": "), c.cast("string"))).cast(want)).otherwise(out)
        return out
    if isinstance(want, T.BinaryType) and isinstance(have, T.StringType):
        hexed = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "^$", "")
        return F.when(c.contains("\\x"), F.unhex(F.regexp_replace(c, r"\\x", ""))).otherwise(F.unhex(hexed))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: cast(x, have.elementType, want.elementType, re.sub(r"\[\d*\]$", "", name)))
    if isinstance(want, T.ArrayType | T.MapType | T.StructType) and isinstance(have, T.StringType):
        return nested_from_string(c, want)
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        if want.fieldNames()[:1] == ["tag"]:
            return c.cast(want)
        return F.when(c.isNotNull(), F.struct(*[cast(c[h.name], h.dataType, w.dataType).alias(w.name) for h, w in zip(have.fields, want.fields)]))
    if isinstance(want, T.StructType) and want.fieldNames()[:1] == ["tag"]:
        fits = next((f for f in want.fields[1:] if f.dataType == have), want.fields[1])
        return F.struct(F.lit(fits.name).alias("tag"), *[(c.cast(f.dataType) if f is fits else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields[1:]])
    return c.cast(want)


def nested_from_string(c: Column, want: T.DataType) -> Column:
    """A list, struct or map from its text; strings inside need no quotes."""
    if isinstance(want, T.MapType):
        body = F.regexp_replace(F.trim(c), r"^\{|\}$", "")
        return F.when(body == "", F.create_map().cast(want)).otherwise(F.str_to_map(body, F.lit(","), F.lit("=")).cast(want))
    if isinstance(want, T.StructType):
        return F.from_json(c, want, {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"})
    inner = F.substring(F.trim(c), 2, 1 << 30)
    inner = F.substring(inner, F.lit(1), F.length(inner) - 1)
    if isinstance(want.elementType, T.ArrayType):
        parts = F.regexp_extract_all(inner, F.lit(r"(\[[^\[\]]*\])"), F.lit(1))
        return F.transform(parts, lambda x: nested_from_string(x, want.elementType))
    parts = F.transform(F.split(inner, ","), lambda x: F.nullif(F.trim(x), F.lit("")))
    return F.when(F.trim(inner) == "", F.array().cast(want)).otherwise(F.transform(parts, lambda x: cast(x, T.StringType(), want.elementType)))


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """The type that all values are brought to, or None if Spark's own rules do."""
    kinds = [t for t in types if not isinstance(t, T.NullType)]
    if not kinds:
        return None
    if all(t == kinds[0] for t in kinds):
        return kinds[0]
    if all(is_numeric(t) for t in kinds):
        return None
    if any(isinstance(t, T.StringType) for t in kinds):
        return T.StringType()
    return None
