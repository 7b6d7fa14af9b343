"""Reading and writing files: CSV with dialect detection, Parquet, NPY columns, and frames by name."""

from __future__ import annotations

import csv
import io
import os
import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import syntax as S
from ..plans.lexer import QueryError
from ..plans.types import cast, parse_type

if TYPE_CHECKING:
    from ..session import Session

SAMPLE_ROWS = 256
#: What the dialect search tries, in this order (fixed values).
DELIMITERS, QUOTES, ESCAPES = (",", ";", "\t", "|"), ('"', "'"), ('"', "\\", "'")


def _resolve(session: Session, path: str) -> str:
    root = session.settings.get("file_search_path") or session.settings.get("home_directory")
    return os.path.join(root, path) if root and not os.path.isabs(path) and "://" not in path else path


def file_kind(path: str, options: dict) -> str:
    kind = str(options.get("file_format", "")) or re.sub(r"[*?]", "", path).rsplit(".", 1)[-1]
    kind = kind.lower()
    if kind not in ("csv", "parquet", "npy", "tsv", "json", "orc"):
        raise QueryError(f"Cannot load from file type {kind}.")
    return "csv" if kind == "tsv" else kind


def load(session: Session, clause: S.LoadFrom, params: dict[str, Any]) -> DataFrame:
    declared = [(n, k) for n, k in clause.columns]
    return read(session, clause.source, clause.options, params, declared)


def read(session: Session, source: Any, options: dict, params: dict[str, Any], declared: list[tuple[str, str]] = (), by_column: bool = False) -> DataFrame:
    """A frame from whatever FROM names; `declared` columns are cast to their types."""
    if isinstance(source, S.Param):
        source = params[source.name]
    if isinstance(source, S.Query):
        df = session.run_query(source, params)
    elif isinstance(source, S.Var):
        df = session.spark.table(source.name)
    elif isinstance(source, DataFrame):
        df = source
    elif isinstance(source, str | list):
        paths = [_resolve(session, p) for p in ([source] if isinstance(source, str) else source)]
        kind = file_kind(paths[0], options)
        if kind == "npy":
            df = read_npy(session, paths, [n for n, _ in declared] or None)
        elif kind == "csv":
            return read_csv(session, paths, options, declared)
        else:
            df = getattr(session.spark.read, kind)(*paths) if kind != "parquet" else session.spark.read.parquet(*paths)
    else:  # a pandas or Arrow table
        df = session.spark.createDataFrame(source)
    return _as_declared(session, df, declared)


def _as_declared(session: Session, df: DataFrame, declared: list[tuple[str, str]]) -> DataFrame:
    if not declared:
        return df
    if len(declared) != len(df.columns):
        raise QueryError(f"Number of columns mismatch. Expected {len(declared)} but got {len(df.columns)}.")
    own = session.catalog.types
    return df.select(*[cast(F.col(f"`{f.name}`"), f.dataType, parse_type(k, own), k).alias(n) for f, (n, k) in zip(df.schema.fields, declared)])


# --- CSV
def sniff(lines: list[str], options: dict) -> dict[str, str]:
    """The dialect whose rows agree best: as many columns as possible, the same in all lines."""
    best, found = (-1, 0), {"delim": ",", "quote": '"', "escape": '"'}
    for d in [options["delim"]] if "delim" in options else DELIMITERS:
        for q in [options["quote"]] if "quote" in options else QUOTES:
            for e in [options["escape"]] if "escape" in options else ESCAPES:
                if e == "'" and q == '"' or e == '"' and q == "'":
                    continue
                try:
                    rows = list(csv.reader(io.StringIO("".join(lines)), delimiter=d, quotechar=q, doublequote=e == q, escapechar=None if e == q else e, strict=True))
                except csv.Error:
                    continue
                widths = [len(r) for r in rows if r]
                if not widths:
                    continue
                same = widths.count(widths[0])
                rank = (same if widths[0] > 1 else 0, widths[0] if same == len(widths) else 0)
                if rank > best:
                    best, found = rank, {"delim": d, "quote": q, "escape": e}
    return found


def _head(session: Session, path: str, n: int) -> list[str]:
    """The first lines of a path, through Spark, so that any store will do."""
    return [r.value + "\n" for r in session.spark.read.text(path).limit(n).collect()]


def _looks_like_header(lines: list[str], dialect: dict) -> bool:
    rows = list(csv.reader(io.StringIO("".join(lines[:SAMPLE_ROWS])), delimiter=dialect["delim"], quotechar=dialect["quote"]))
    rows = [r for r in rows if r]
    if len(rows) < 2 or not all(re.fullmatch(r"[^\W\d]\w*(?::[\w\[\]]+)?", c.strip()) for c in rows[0]):
        return False
    plain = lambda c: bool(re.fullmatch(r"-?\d+(\.\d+)?|true|false|\d{4}-\d\d-\d\d.*", c.strip(), re.I))
    return any(plain(rows[1][i]) and not plain(rows[0][i]) for i in range(min(len(rows[0]), len(rows[1])))) or not any(set(r) & set(rows[0]) for r in rows[1:])


def _has_open_quotes(session: Session, paths: list[str], dialect: dict) -> bool:
    """Whether any line of any path has an odd number of quotes, with or without the escaped ones."""
    quote, escape, line = dialect["quote"], dialect["escape"], F.col("value")
    odd = lambda c: F.length(F.regexp_replace(c, f"[^{re.escape(quote)}]", "")) % 2 == 1
    found = odd(line)
    if escape and escape != quote:
        found = found | odd(F.regexp_replace(line, re.escape(escape) + ".", ""))
    return bool(quote) and not session.spark.read.text(paths).where(found).isEmpty()


def read_csv(session: Session, paths: list[str], options: dict, declared: list[tuple[str, str]]) -> DataFrame:
    """CSV by Spark's reader with the options given, the dialect and the header detected where they aren't.

    Declared columns are read as text and cast by the language's rules; with IGNORE_ERRORS rows that don't fit
    are left out and kept as warnings.
    """
    o = {k.lower(): v for k, v in options.items()}
    lines = _head(session, paths[0], int(o.get("sample_size", SAMPLE_ROWS)) + int(o.get("skip", 0)))[int(o.get("skip", 0)) :]
    dialect = sniff(lines, o) if o.get("auto_detect", True) else {"delim": o.get("delim", ","), "quote": o.get("quote", '"'), "escape": o.get("escape", '"')}
    header = bool(o["header"]) if "header" in o else (bool(lines) and _looks_like_header(lines, dialect))
    quoted_newlines = o.get("parallel") is False or _has_open_quotes(session, paths, dialect)
    reader = session.spark.read.option("sep", dialect["delim"]).option("quote", dialect["quote"]).option("escape", dialect["escape"]).option("header", str(header and not o.get("skip")).lower()).option("multiLine", str(quoted_newlines).lower())
    reader = reader.option("enforceSchema", "true").option("nullValue", "" if "null_strings" not in o else str(o["null_strings"][0] if o["null_strings"] else ""))
    if o.get("skip"):
        skipped = int(o["skip"]) + (1 if header else 0)
        text = session.spark.read.text(paths).rdd.zipWithIndex().filter(lambda p: p[1] >= skipped).map(lambda p: p[0].value)
        names = next(csv.reader(lines, delimiter=dialect["delim"], quotechar=dialect["quote"])) if header else None
        df = reader.csv(text)
        if names:
            df = df.toDF(*names)
    elif declared:
        schema = T.StructType([T.StructField(n, T.StringType()) for n, _ in declared])
        width = len(next(csv.reader(lines, delimiter=dialect["delim"], quotechar=dialect["quote"]), [])) if lines else len(declared)
        if width != len(declared) and not o.get("ignore_errors"):
            raise QueryError(f"expected {len(declared)} values per row, but got {width}")
        if o.get("ignore_errors"):
            schema = schema.add("_bad", T.StringType())
            reader = reader.option("columnNameOfCorruptRecord", "_bad")
        df = reader.schema(schema).csv(paths)
    else:
        df = reader.option("inferSchema", "true").option("samplingRatio", "1.0").csv(paths)
        if not header:
            df = df.toDF(*[f"column{i}" for i in range(len(df.columns))])
        return df
    if not declared:
        return df
    own = session.catalog.types
    names = df.columns
    kinds = {n: k for n, k in declared}
    cols = [F.col(f"`{c}`") for c in names if c != "_bad"]
    targets = [(n, parse_type(k, own), k) for n, k in kinds.items()]
    if o.get("ignore_errors"):
        tries = [c.try_cast(t) if not isinstance(t, T.ArrayType | T.MapType | T.StructType) else cast(c, T.StringType(), t, k) for c, (_, t, k) in zip(cols, targets)]
        fits = F.col("_bad").isNull() if "_bad" in names else F.lit(True)
        for c, x, (_, t, _) in zip(cols, tries, targets):
            if not isinstance(t, T.ArrayType | T.MapType | T.StructType):
                fits = fits & (c.isNull() | x.isNotNull())
        marked = df.withColumn("__fits", fits)
        for r in marked.where("NOT __fits").limit(int(session.settings["warning_limit"])).collect():
            session.warnings.append(("row doesn't fit its types", paths[0], str(r[: len(cols)])))
        return marked.where("__fits").select(*[x.alias(n) for x, (n, _, _) in zip(tries, targets)])
    return df.select(*[cast(_list_brackets(c, t, o), T.StringType(), t, k).alias(n) for c, (n, t, k) in zip(cols, targets)])


def _list_brackets(c, t: T.DataType, o: dict):
    """LIST_UNBRACED: a list is written without its brackets."""
    if o.get("list_unbraced") and isinstance(t, T.ArrayType):
        return F.when(c.startswith("["), c).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    return c


# --- NPY
def _npy_open(path: str):
    """The file of a path or of an address in any store that Arrow reads, on the driver and on workers alike."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _npy_head(path: str) -> tuple[tuple[int, ...], Any, int]:
    """Shape, type and the place of the first value."""
    import numpy as np

    with _npy_open(path) as f:
        start = io.BytesIO(f.read(65_536))
    version = np.lib.format.read_magic(start)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if by_column and len(shape) > 1:
        raise QueryError("npy files in Fortran order are not supported")
    return shape, kind, start.tell()


def read_npy(session: Session, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """One .npy file per column; workers read the bytes of their slices only, columns are joined by row number."""
    import numpy as np

    out = None
    for i, path in enumerate(paths):
        name = names[i] if names else f"column{i}"
        shape, dtype, begin = _npy_head(path)
        kind: T.DataType = {"int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "float64": T.DoubleType(), "float32": T.FloatType()}.get(dtype.name, None)
        if kind is None:
            raise QueryError(f"unsupported npy type {dtype}")
        for _ in shape[1:]:
            kind = T.ArrayType(kind)
        rows, width = shape[0], int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        per = max(1, min(65_536, (8 << 20) // max(1, width)))  # slices of 8 MB at most

        def slices(batches, path=path, per=per, rows=rows, width=width, dtype=dtype, shape=shape, begin=begin):
            import numpy as np
            import pandas as pd

            with _npy_open(path) as f:
                for pdf in batches:
                    for first in (pdf["id"] * per).tolist():
                        n = min(rows - first, per)
                        f.seek(begin + first * width)
                        part = np.frombuffer(f.read(n * width), dtype).reshape(n, *shape[1:])
                        yield pd.DataFrame({"__row": range(first, first + n), "v": part.tolist()})

        column = session.spark.range(-(-rows // per)).mapInPandas(slices, T.StructType([T.StructField("__row", T.LongType()), T.StructField("v", kind)])).withColumnRenamed("v", name)
        out = column if out is None else out.join(column, "__row")
    return out.drop("__row")


# --- writing
def write(df: DataFrame, path: str, options: dict) -> None:
    """COPY … TO: one file when the path names one (nested values as text in CSV)."""
    from ..plans.types import to_string

    o = {k.lower(): v for k, v in options.items()}
    kind = file_kind(path, o)
    if kind == "csv":
        flat = df.select(*[(to_string(F.col(f"`{f.name}`"), f.dataType) if not isinstance(f.dataType, T.NumericType | T.StringType | T.DateType) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
        flat.write.mode("overwrite").option("header", str(bool(o.get("header", False))).lower()).option("sep", o.get("delim", ",")).option("quote", o.get("quote", '"')).option("escape", o.get("escape", '"')).csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").option("compression", str(o.get("compression", "snappy")).lower()).parquet(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)
