"""String, regular-expression, blob and UUID functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Value, function, simple


def _len(c):
    return F.length(c)


simple("CONTAINS", lambda s, x: s.contains(x), "(STRING,STRING) -> BOOL", 2)
simple("STARTS_WITH PREFIX", lambda s, x: s.startswith(x), "(STRING,STRING) -> BOOL", 2)
simple("ENDS_WITH SUFFIX", lambda s, x: s.endswith(x), "(STRING,STRING) -> BOOL", 2)
simple("LOWER TOLOWER LCASE", F.lower, "(STRING) -> STRING")
simple("UPPER UCASE TOUPPER", F.upper, "(STRING) -> STRING")
simple("TRIM", F.trim, "(STRING) -> STRING")
simple("LTRIM", F.ltrim, "(STRING) -> STRING")
simple("RTRIM", F.rtrim, "(STRING) -> STRING")
simple("REPEAT", lambda s, n: F.repeat(s, n.cast("int")), "(STRING,INT64) -> STRING", 2)
simple("LPAD", lambda s, n, x: F.lpad(s, n.cast("int"), x), "(STRING,INT64,STRING) -> STRING", 3)
simple("RPAD", lambda s, n, x: F.rpad(s, n.cast("int"), x), "(STRING,INT64,STRING) -> STRING", 3)
simple("REVERSE", F.reverse, "(STRING) -> STRING")
simple("LEFT", lambda s, n: F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(_len(s) + n, F.lit(0))).cast("int")), "(STRING,INT64) -> STRING", 2)
simple("RIGHT", lambda s, n: F.right(s, F.when(n >= 0, n).otherwise(F.greatest(_len(s) + n, F.lit(0))).cast("int")), "(STRING,INT64) -> STRING", 2)
simple("SUBSTR SUBSTRING", lambda s, p, n: F.when(p < 1, F.when(s.isNotNull(), "")).otherwise(F.substring(s, p.cast("int"), n.cast("int"))), "(STRING,INT64,INT64) -> STRING", 3)
simple("INITCAP", lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s)))), "(STRING) -> STRING")
simple("LEVENSHTEIN", lambda a, b: F.levenshtein(a, b).cast("long"), "(STRING,STRING) -> INT64", 2)
simple("CONCAT", lambda *c: F.concat_ws("", *[x.cast("string") for x in c]), "(STRING) -> STRING", 1, None)
simple("CONCAT_WS", lambda sep, *c: F.when(sep.isNotNull(), F.call_function("concat_ws", sep, *[x.cast("string") for x in c])), "(STRING) -> STRING", 2, None)
simple("REGEXP_FULL_MATCH", lambda s, p: F.regexp_like(s, F.concat(F.lit("^(?:"), p, F.lit(")$"))), "(STRING,STRING) -> BOOL", 2)
simple("REGEXP_MATCHES", lambda s, p: F.regexp_like(s, p), "(STRING,STRING) -> BOOL", 2)
simple("REGEXP_SPLIT_TO_ARRAY", lambda s, p: F.split(s, p, -1), "(STRING,STRING) -> STRING[]", 2)
simple("SPLIT_PART", lambda s, sep, n: F.when(s.isNull() | sep.isNull() | n.isNull(), None).when(n < 1, "").otherwise(F.split_part(s, sep, F.greatest(n, F.lit(1)).cast("int"))), "(STRING,STRING,INT64) -> STRING", 3)
simple("STRING_SPLIT STR_SPLIT STRING_TO_ARRAY", lambda s, sep: F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1), "(STRING,STRING) -> STRING[]", 2)


@function("REGEXP_REPLACE", "(STRING,STRING,STRING[,STRING]) -> STRING", 3, 4)
def regexp_replace(s: Value, p: Value, r: Value, how: Value | None = None):
    to = F.regexp_replace(F.regexp_replace(r.c, r"\$", r"\\\$"), r"\\(\d)", r"\$$1")
    if how is not None and "g" in str(how.constant):
        return F.call_function("regexp_replace", s.c, p.c, to)
    # the first match only: what is before it is matched, lazily, along with it
    wrapped = F.concat(F.lit("(?s)\\A(.*?)(?:"), p.c, F.lit(")"))
    return F.call_function("regexp_replace", s.c, wrapped, F.concat(F.lit("$1"), _shift_refs(to)))


def _shift_refs(c):
    """$1 becomes $2 and so on: the wrapping adds a group in front."""
    for k in range(8, 0, -1):
        c = F.replace(c, F.lit(f"${k}"), F.lit(f"${k + 1}"))
    return c


@function("REGEXP_EXTRACT", "(STRING,STRING[,INT64]) -> STRING", 2, 3)
def regexp_extract(s: Value, p: Value, group: Value | None = None):
    return F.call_function("regexp_extract", s.c, p.c, group.c.cast("int") if group else F.lit(0))


@function("REGEXP_EXTRACT_ALL", "(STRING,STRING[,INT64]) -> STRING[]", 2, 3)
def regexp_extract_all(s: Value, p: Value, group: Value | None = None):
    return F.regexp_extract_all(s.c, p.c, group.c.cast("int") if group else F.lit(0))


def char_at(s, i):
    """One character, 1-based, negative from the end; 0 is empty, beyond either end is the last or first one."""
    n = _len(s)
    at = F.when(i > 0, F.least(i, n)).otherwise(F.greatest(n + i + 1, F.lit(1)))
    return F.when(s.isNull() | i.isNull(), None).when((i == 0) | (n == 0), "").otherwise(F.substring(s, at.cast("int"), F.lit(1)))


# --- blobs and UUIDs
simple("OCTET_LENGTH", lambda b: F.octet_length(b).cast("long"), "(BLOB) -> INT64")
simple("ENCODE", lambda s: F.encode(s, "UTF-8"), "(STRING) -> BLOB")
simple("DECODE", lambda b: F.decode(b, "UTF-8"), "(BLOB) -> STRING")
simple("GEN_RANDOM_UUID", lambda: F.uuid(), "() -> UUID", 0)


@function("LENGTH", "(PATH) -> INT64 and strings", 1)
def length(x: Value):
    if isinstance(x.t, T.StructType) and "_RELS" in x.t.fieldNames():
        return F.size(x.c["_RELS"]).cast("long")
    return F.length(x.c).cast("long")
