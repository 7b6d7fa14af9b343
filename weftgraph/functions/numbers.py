"""Arithmetic, comparison, boolean and hash functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError
from ..plans.types import INTERVAL, interval, is_integral, is_interval, is_numeric, is_time, micros_of
from .registry import Value, function, simple


def _double(c):
    return c.cast("double")


def _whole(f, c):
    """floor or ceil of a double as a double; from 2^52 on (and for NaN) the value itself, which has no fraction.

    A zero has the sign of the value, as IEEE 754 wants it: ceil(-0.5) is -0.0.
    """
    whole = f(c).cast("double")
    return F.when(F.abs(c) < float(1 << 52), F.when(whole == 0, c.cast("double") * 0.0).otherwise(whole)).otherwise(c)


def _is_float(*values: Value) -> bool:
    return any(isinstance(v.t, T.DoubleType | T.FloatType) for v in values) and all(is_numeric(v.t) for v in values)


for _name, _f in {"ACOS": F.acos, "ASIN": F.asin, "ATAN": F.atan, "COS": F.cos, "COT": F.cot, "DEGREES": F.degrees, "LN": F.ln, "LOG LOG10": F.log10, "LOG2": F.log2, "RADIANS": F.radians, "SIN": F.sin, "SQRT": F.sqrt, "TAN": F.tan, "CBRT": F.cbrt}.items():
    simple(_name, lambda c, f=_f: f(_double(c)), "(DOUBLE) -> DOUBLE")
simple("ATAN2", lambda y, x: F.atan2(_double(y), _double(x)), "(DOUBLE,DOUBLE) -> DOUBLE", 2)
simple("PI", lambda: F.pi(), "() -> DOUBLE", 0)
simple("ABS", F.abs, "(N) -> N")
simple("EVEN", lambda c: F.when(c >= 0, _whole(F.ceil, _double(c) / 2) * 2).otherwise(_whole(F.floor, _double(c) / 2) * 2), "(DOUBLE) -> DOUBLE")
simple("SIGN", lambda c: F.signum(_double(c)).cast("long"), "(N) -> INT64")
simple("FACTORIAL", lambda c: F.factorial(c.cast("int")), "(INT64) -> INT64")
simple("BITWISE_XOR", lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), "(INT64,INT64) -> INT64", 2)
simple("BITWISE_AND", lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), "(INT64,INT64) -> INT64", 2)
simple("BITWISE_OR", lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), "(INT64,INT64) -> INT64", 2)
simple("BITSHIFT_LEFT", lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")), "(INT64,INT64) -> INT64", 2)
simple("BITSHIFT_RIGHT", lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")), "(INT64,INT64) -> INT64", 2)
simple("POW POWER", lambda a, b: F.pow(_double(a), _double(b)), "(DOUBLE,DOUBLE) -> DOUBLE", 2)


@function("CEIL CEILING", "(N) -> N")
def ceil(x: Value):
    return _whole(F.ceil, x.c).cast(x.t) if _is_float(x) else F.ceil(x.c).cast(x.t if is_numeric(x.t) else "double")


@function("FLOOR", "(N) -> N")
def floor(x: Value):
    return _whole(F.floor, x.c).cast(x.t) if _is_float(x) else F.floor(x.c).cast(x.t if is_numeric(x.t) else "double")


@function("ROUND", "(DOUBLE,INT64) -> DOUBLE", 1, 2)
def round_(x: Value, n: Value | None = None):
    digits = n.c if n else F.lit(0)
    scale = F.pow(F.lit(10.0), _double(digits))
    value = _double(x.c)
    shifted = F.abs(value) * scale
    # nothing to round where the shifted value has no fraction, is not a number or out of range
    return F.when(shifted < float(1 << 52), F.signum(value) * F.floor(shifted + 0.5) / scale).otherwise(value)


# no built-in exists for these two: vectorised by Arrow
@F.pandas_udf(T.DoubleType())
def _gamma(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if pd.isna(v) else math.gamma(v))


@F.pandas_udf(T.DoubleType())
def _lgamma(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if pd.isna(v) else math.lgamma(v))


simple("GAMMA", lambda c: _gamma(_double(c)), "(DOUBLE) -> DOUBLE")
simple("LGAMMA", lambda c: _lgamma(_double(c)), "(DOUBLE) -> DOUBLE")


@function("+", "(N,N) -> N and lists, strings, dates, timestamps, intervals", 2)
def plus(a: Value, b: Value):
    if isinstance(a.t, T.ArrayType) and isinstance(b.t, T.ArrayType):
        return F.concat(a.c, b.c)
    if isinstance(a.t, T.StringType) or isinstance(b.t, T.StringType):
        return F.concat_ws("", a.c.cast("string"), b.c.cast("string"))
    if is_interval(a.t) and is_interval(b.t):
        return F.when(a.c.isNotNull() & b.c.isNotNull(), interval(*(a.c[f] + b.c[f] for f in INTERVAL.fieldNames())))
    if is_interval(a.t):
        a, b = b, a
    if is_interval(b.t):
        return shift(a, b, 1)
    if isinstance(b.t, T.DateType):
        a, b = b, a
    if isinstance(a.t, T.DateType) and is_integral(b.t):
        return F.date_add(a.c, b.c.cast("int"))
    return a.c + b.c


def shift(a: Value, i: Value, sign: int):
    """A date or timestamp moved by an interval; a date stays a date."""
    s = F.lit(sign)
    step = F.make_interval(F.lit(0), i.c["months"] * s, F.lit(0), i.c["days"] * s, F.lit(0), F.lit(0), (i.c["micros"] * s / 1_000_000).cast("decimal(18,6)"))
    if isinstance(a.t, T.DateType):
        return F.when(i.c.isNotNull(), (a.c.cast("timestamp_ntz") + step).cast("date"))
    return F.when(i.c.isNotNull(), a.c + step)


@function("-", "(N,N) -> N and dates, timestamps, intervals", 2)
def minus(a: Value, b: Value):
    if is_interval(a.t) and is_interval(b.t):
        return F.when(a.c.isNotNull() & b.c.isNotNull(), interval(*(a.c[f] - b.c[f] for f in INTERVAL.fieldNames())))
    if is_interval(b.t):
        return shift(a, b, -1)
    if isinstance(a.t, T.DateType) and isinstance(b.t, T.DateType):
        return F.datediff(a.c, b.c).cast("long")
    if isinstance(a.t, T.DateType) and is_integral(b.t):
        return F.date_sub(a.c, b.c.cast("int"))
    if is_time(a.t) and is_time(b.t):
        micros = F.unix_micros(a.c.cast("timestamp")) - F.unix_micros(b.c.cast("timestamp"))
        day = 86_400_000_000
        return F.when(micros.isNotNull(), interval(0, F.floor(F.abs(micros) / day) * F.signum(micros), micros % day))
    return a.c - b.c


simple("*", lambda a, b: a * b, "(N,N) -> N", 2)


@function("%", "(N,N) -> N; floats give NaN for zero", 2)
def modulo(a: Value, b: Value):
    if _is_float(a, b):
        return F.when(a.c.isNotNull() & (_double(b.c) == 0), F.lit(float("nan"))).otherwise(_double(a.c) % F.nullif(_double(b.c), F.lit(0.0)))
    return a.c % b.c


@function("/", "(N,N) -> N; whole numbers truncate", 2)
def divide(a: Value, b: Value):
    if is_interval(a.t):
        return F.when(a.c.isNotNull() & b.c.isNotNull(), interval((a.c["months"] / b.c).cast("int"), (a.c["days"] / b.c).cast("int"), (a.c["micros"] / b.c).cast("long")))
    if is_integral(a.t) and is_integral(b.t):
        if isinstance(a.t, T.DecimalType) or isinstance(b.t, T.DecimalType):
            return F.call_function("div", a.c, b.c)
        wide = "int" if all(isinstance(x.t, T.ByteType | T.ShortType | T.IntegerType) for x in (a, b)) else "long"
        return F.call_function("div", a.c, b.c).cast(wide)
    if _is_float(a, b):
        x, y = _double(a.c), _double(b.c)
        by_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return F.when(x.isNotNull() & (y == 0), F.when(F.isnan(x), x).otherwise(by_zero)).otherwise(x / F.nullif(y, F.lit(0.0)))
    return a.c / b.c


@function("NEGATE", "(N) -> N")
def negate(x: Value):
    return F.when(x.c.isNotNull(), interval(*(-x.c[f] for f in INTERVAL.fieldNames()))) if is_interval(x.t) else -x.c


# --- comparison
_COMPARE = {"=": ("EQUALS", lambda a, b: a == b), "<>": ("NOT_EQUALS", lambda a, b: a != b), ">": ("GREATER_THAN", lambda a, b: a > b), ">=": ("GREATER_THAN_EQUALS", lambda a, b: a >= b), "<": ("LESS_THAN", lambda a, b: a < b), "<=": ("LESS_THAN_EQUALS", lambda a, b: a <= b)}


def comparable(a: Value, b: Value):
    if is_interval(a.t) or is_interval(b.t):
        return micros_of(a.c), micros_of(b.c)
    # texts compare with dates and times by being read as such
    for x, y in ((a, b), (b, a)):
        if isinstance(x.t, T.StringType) and (isinstance(y.t, T.DateType) or is_time(y.t)):
            return tuple(v.c if v is y else v.c.cast(y.t) for v in (a, b))
    if isinstance(a.t, T.MapType) and isinstance(b.t, T.MapType):
        return F.map_entries(a.c), F.map_entries(b.c)
    return a.c, b.c


for _sign, (_word, _op) in _COMPARE.items():
    function(f"{_sign} {_word}", "(T,T) -> BOOL", 2)(lambda a, b, op=_op: op(*comparable(a, b)))

simple("AND", lambda a, b: a.cast("boolean") & b.cast("boolean"), "(BOOL,BOOL) -> BOOL", 2)
simple("OR", lambda a, b: a.cast("boolean") | b.cast("boolean"), "(BOOL,BOOL) -> BOOL", 2)
simple("XOR", lambda a, b: a.cast("boolean") != b.cast("boolean"), "(BOOL,BOOL) -> BOOL", 2)
simple("NOT", lambda a: ~a.cast("boolean"), "(BOOL) -> BOOL")
simple("IS_NULL", lambda a: a.isNull(), "(T) -> BOOL")
simple("IS_NOT_NULL", lambda a: a.isNotNull(), "(T) -> BOOL")

# --- hash and utility
simple("MD5", F.md5, "(STRING) -> STRING")
simple("SHA256", lambda c: F.sha2(c, 256), "(STRING) -> STRING")
simple("HASH", lambda c: F.xxhash64(c), "(ANY) -> INT64")
simple("RANDOM", lambda: F.rand(), "() -> DOUBLE", 0)
simple("COALESCE", lambda *c: F.coalesce(*c), "(ANY) -> ANY", 1, None)
simple("IFNULL", lambda a, b: F.coalesce(a, b), "(ANY,ANY) -> ANY", 2)
simple("CONSTANT_OR_NULL", lambda a, b: F.when(b.isNotNull(), a), "(ANY,ANY) -> ANY", 2)
simple("NULLIF", lambda a, b: F.nullif(a, b), "(T,T) -> T", 2)
simple("ERROR", lambda c: F.raise_error(c).cast("int"), "(STRING) -> INT32")


@function("COUNT_IF", "(T) -> UINT8")
def count_if(x: Value):
    truth = x.c if isinstance(x.t, T.BooleanType) else x.c != 0
    return F.when(truth, 1).otherwise(0)


@function("TYPEOF", "(ANY) -> STRING")
def typeof(x: Value):
    from ..plans.types import type_name

    return F.lit(type_name(x.t))


@function("GREATEST", "(DATE,DATE) -> DATE and timestamps", 2)
def greatest(a: Value, b: Value):
    _times(a, b)
    return F.when(a.c >= b.c, a.c).when(a.c < b.c, b.c)


@function("LEAST", "(DATE,DATE) -> DATE and timestamps", 2)
def least(a: Value, b: Value):
    _times(a, b)
    return F.when(a.c <= b.c, a.c).when(a.c > b.c, b.c)


def _times(*args: Value) -> None:
    if not all(isinstance(x.t, T.DateType | T.NullType) or is_time(x.t) for x in args):
        raise QueryError("GREATEST and LEAST take dates or timestamps")
