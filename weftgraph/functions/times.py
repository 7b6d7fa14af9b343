"""Date, timestamp and interval functions, and casts by function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError
from ..plans.types import cast, interval, is_interval, parse_type
from .registry import Value, function, simple

_PARTS = {
    "year": "year", "years": "year", "y": "year", "month": "month", "months": "month", "mon": "month", "day": "day", "days": "day", "d": "day", "dayofmonth": "day",
    "hour": "hour", "hours": "hour", "h": "hour", "minute": "minute", "minutes": "minute", "m": "minute", "second": "second", "seconds": "second", "s": "second",
    "millisecond": "millisecond", "milliseconds": "millisecond", "ms": "millisecond", "microsecond": "microsecond", "microseconds": "microsecond", "us": "microsecond",
    "quarter": "quarter", "week": "week", "weeks": "week", "decade": "decade", "decades": "decade", "century": "century", "centuries": "century", "millennium": "millennium", "millenium": "millennium",
    "dow": "dow", "dayofweek": "dow", "doy": "doy", "dayofyear": "doy", "isodow": "isodow", "epoch": "epoch",
}


def _part(v: Value) -> str:
    p = _PARTS.get(str(v.constant).lower())
    if not p:
        raise QueryError(f"date part {v.constant} is unknown")
    return p


@function("DATE_PART DATEPART", "(STRING,DATE) -> INT64", 2)
def date_part(part: Value, x: Value):
    p = _part(part)
    if is_interval(x.t):
        months, days, micros = (x.c[f] for f in ("months", "days", "micros"))
        parts = {
            "year": months / 12, "month": months % 12, "day": days, "decade": months / 120, "century": months / 1200, "millennium": months / 12000, "quarter": months % 12 / 3 + 1,
            "hour": micros / 3_600_000_000, "minute": micros % 3_600_000_000 / 60_000_000, "second": micros % 60_000_000 / 1_000_000, "millisecond": micros % 60_000_000 / 1_000, "microsecond": micros % 60_000_000,
        }
        if p not in parts:
            raise QueryError(f"an interval has no {p}")
        return parts[p].cast("long")
    c = x.c.cast("timestamp_ntz") if isinstance(x.t, T.DateType | T.StringType) else x.c
    year = F.year(c)
    whole = {
        "year": year, "month": F.month(c), "day": F.day(c), "hour": F.hour(c), "minute": F.minute(c), "second": F.second(c), "quarter": F.quarter(c), "week": F.weekofyear(c),
        "dow": F.dayofweek(c) - 1, "doy": F.dayofyear(c), "isodow": F.weekday(c) + 1, "decade": F.floor(year / 10), "century": F.floor((year - 1) / 100) + 1, "millennium": F.floor((year - 1) / 1000) + 1,
        "millisecond": F.floor(F.date_part(F.lit("second"), c) * 1000), "microsecond": F.floor(F.date_part(F.lit("second"), c) * 1_000_000), "epoch": F.unix_seconds(c.cast("timestamp")),
    }
    return whole[p].cast("long")


@function("DATE_TRUNC DATETRUNC", "(STRING,DATE) -> DATE and timestamps", 2)
def date_trunc(part: Value, x: Value):
    p = _part(part)
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if p in spans:
        out: Column = F.make_date((F.floor(F.year(x.c) / spans[p]) * spans[p]).cast("int"), F.lit(1), F.lit(1))
    else:
        out = F.date_trunc(p, x.c)
    return out.cast(x.t if not isinstance(x.t, T.StringType) else "timestamp_ntz")


simple("DAYNAME", lambda d: F.date_format(d, "EEEE"), "(DATE) -> STRING")
simple("MONTHNAME", lambda d: F.date_format(d, "MMMM"), "(DATE) -> STRING")
simple("LAST_DAY", F.last_day, "(DATE) -> DATE")
simple("MAKE_DATE", lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), "(INT64,INT64,INT64) -> DATE", 3)
simple("CURRENT_DATE", lambda: F.current_date(), "() -> DATE", 0)
simple("CURRENT_TIMESTAMP", lambda: F.current_timestamp(), "() -> TIMESTAMP_TZ", 0)
simple("CENTURY", lambda t: (F.floor((F.year(t) - 1) / 100) + 1).cast("long"), "(TIMESTAMP) -> INT64")
simple("EPOCH_MS", lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz"), "(INT64) -> TIMESTAMP")
simple("TO_TIMESTAMP", lambda s: F.timestamp_micros(F.round(s.cast("double") * 1e6).cast("long")).cast("timestamp_ntz"), "(DOUBLE) -> TIMESTAMP")
simple("TO_EPOCH_MS", lambda t: F.unix_millis(t.cast("timestamp")), "(TIMESTAMP) -> INT64")

for _name, _args in {"TO_YEARS": lambda n: (n * 12, 0, 0), "TO_MONTHS": lambda n: (n, 0, 0), "TO_DAYS": lambda n: (0, n, 0), "TO_HOURS": lambda n: (0, 0, n * 3_600_000_000), "TO_MINUTES": lambda n: (0, 0, n * 60_000_000), "TO_SECONDS": lambda n: (0, 0, n * 1_000_000), "TO_MILLISECONDS": lambda n: (0, 0, n * 1_000), "TO_MICROSECONDS": lambda n: (0, 0, n)}.items():
    simple(_name, lambda n, a=_args: F.when(n.isNotNull(), interval(*a(n.cast("long")))), "(INT64) -> INTERVAL")

_CASTS = {
    "TO_DATE DATE": "DATE", "TIMESTAMP": "TIMESTAMP", "TO_INTERVAL INTERVAL DURATION": "INTERVAL", "TO_BLOB BLOB": "BLOB", "TO_UUID UUID": "UUID", "TO_DOUBLE": "DOUBLE", "TO_FLOAT": "FLOAT",
    "TO_SERIAL": "SERIAL", "TO_INT64": "INT64", "TO_INT32": "INT32", "TO_INT16": "INT16", "TO_INT8": "INT8", "TO_UINT64": "UINT64", "TO_UINT32": "UINT32", "TO_UINT16": "UINT16", "TO_UINT8": "UINT8",
    "TO_INT128": "INT128", "TO_UINT128": "UINT128", "TO_BOOL": "BOOL",
}
for _names, _kind in _CASTS.items():
    function(_names, f"(T) -> {_kind}")(lambda x, k=_kind: cast(x.c, x.t, parse_type(k), k))
