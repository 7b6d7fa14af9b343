"""Statements that aren't queries: definitions, copies, transactions, settings."""

from __future__ import annotations

from typing import TYPE_CHECKING

from . import syntax as S

if TYPE_CHECKING:
    from .parser import Parser


def parse_statement(p: Parser) -> S.Statement | None:
    first, second = p.tok.upper, p.ahead().upper
    if first == "CREATE" and second in ("NODE", "REL", "SEQUENCE", "TYPE", "MACRO", "USER", "ROLE"):
        p.i += 2
        return {"NODE": _node_table, "REL": _rel_table, "SEQUENCE": _sequence, "TYPE": _type, "MACRO": _macro, "USER": _role, "ROLE": _role}[second](p)
    if first == "DROP":
        p.i += 1
        kind = p.name().upper()
        exists = p.word("IF", "EXISTS")
        return S.Statement("DROP", {"kind": kind, "name": p.name(), "if_exists": exists})
    if first == "ALTER":
        p.i += 1
        p.need_word("TABLE")
        return _alter(p)
    if first == "COMMENT":
        p.i += 1
        p.need_word("ON", "TABLE")
        name = p.name()
        p.need_word("IS")
        p.i += 1
        return S.Statement("COMMENT", {"name": name, "comment": p.toks[p.i - 1].value})
    if first == "COPY":
        p.i += 1
        return _copy(p)
    if first in ("EXPORT", "IMPORT") and second == "DATABASE":
        p.i += 3
        path = p.toks[p.i - 1].value
        return S.Statement(first, {"path": path, "options": p.options() if p.is_op("(") else {}})
    if first == "ATTACH":
        p.i += 2
        path, alias = p.toks[p.i - 1].value, None
        if p.word("AS"):
            alias = p.name()
        options = p.options() if p.is_op("(") else {}
        return S.Statement("ATTACH", {"path": path, "alias": alias, "options": options})
    if first in ("DETACH", "USE") and second != "DELETE":
        p.i += 2 if second in ("DATABASE", "") or first == "USE" and second == "DATABASE" else 1
        return S.Statement(first, {"name": p.name()})
    if first == "BEGIN":
        p.i += 1
        p.need_word("TRANSACTION")
        return S.Statement("BEGIN", {"read_only": p.word("READ", "ONLY")})
    if first in ("COMMIT", "ROLLBACK", "CHECKPOINT"):
        p.i += 1
        return S.Statement(first, {})
    if first == "CALL" and p.is_op("=", 2):
        p.i += 1
        name = p.name()
        p.need("=")
        return S.Statement("SETTING", {"name": name, "value": p.expr()})
    if first in ("INSTALL", "UNINSTALL", "UPDATE") or first == "LOAD" and second not in ("FROM", "WITH"):
        p.i += 1
        p.word("EXTENSION")
        p.word("EXTENSIONS")
        p.i += 1
        return S.Statement("EXTENSION", {"action": first, "name": p.toks[p.i - 1].value})
    return None


def _exists(p: Parser) -> bool:
    return p.word("IF", "NOT", "EXISTS")


def _columns(p: Parser) -> tuple[list, str | None, list[str], list[tuple[str, str]]]:
    """Columns (name, type, default, comment free), the primary key, other words, FROM-TO pairs."""
    columns, key, more, ends = [], None, [], []

    def one() -> None:
        nonlocal key
        if p.word("PRIMARY", "KEY"):
            p.need("(")
            key = p.name()
            p.need(")")
        elif p.is_word("FROM"):
            p.i += 1
            a = p.name()
            p.need_word("TO")
            ends.append((a, p.name()))
        elif p.tok.upper in ("MANY_MANY", "MANY_ONE", "ONE_MANY", "ONE_ONE"):
            more.append(p.name().upper())
        else:
            name = p.name()
            kind = p.type_name()
            default = p.expr() if p.word("DEFAULT") else None
            if p.word("PRIMARY", "KEY"):
                key = name
            columns.append((name, kind, default))

    p.need("(")
    p.some(one)
    return columns, key, more, ends


def _node_table(p: Parser) -> S.Statement:
    p.need_word("TABLE")
    absent = _exists(p)
    name = p.name()
    if p.word("AS"):
        return S.Statement("CREATE NODE", {"name": name, "if_not_exists": absent, "as": p.query()})
    columns, key, _, _ = _columns(p)
    return S.Statement("CREATE NODE", {"name": name, "if_not_exists": absent, "columns": columns, "key": key, "options": _with(p)})


def _with(p: Parser) -> dict:
    return p.options() if p.word("WITH") else {}


def _rel_table(p: Parser) -> S.Statement:
    p.need_word("TABLE")
    p.word("GROUP")
    absent = _exists(p)
    name = p.name()
    columns, _, more, ends = _columns(p)
    args = {"name": name, "if_not_exists": absent, "columns": columns, "ends": ends, "multiplicity": more[0] if more else "MANY_MANY", "options": _with(p)}
    if p.word("AS"):
        args["as"] = p.query()
    return S.Statement("CREATE REL", args)


def _sequence(p: Parser) -> S.Statement:
    absent = _exists(p)
    args = {"name": p.name(), "if_not_exists": absent, "cycle": False}

    def number() -> int:
        sign = -1 if p.op("-") else 1
        p.i += 1
        return sign * int(p.toks[p.i - 1].value)

    while p.tok.kind == "word":
        if p.word("INCREMENT"):
            p.word("BY")
            args["increment"] = number()
        elif p.word("MINVALUE"):
            args["min"] = number()
        elif p.word("MAXVALUE"):
            args["max"] = number()
        elif p.word("START"):
            p.word("WITH")
            args["start"] = number()
        elif p.word("CYCLE"):
            args["cycle"] = True
        elif p.word("NO"):
            p.name()
        else:
            raise p.error("expected a sequence option")
    return S.Statement("CREATE SEQUENCE", args)


def _type(p: Parser) -> S.Statement:
    name = p.name()
    p.need_word("AS")
    return S.Statement("CREATE TYPE", {"name": name, "type": p.type_name()})


def _macro(p: Parser) -> S.Statement:
    name = p.name()
    p.need("(")

    def param() -> tuple[str, S.Expr | None]:
        n = p.name()
        return n, p.expr() if p.op(":=") else None

    params = p.some(param)
    p.need_word("AS")
    return S.Statement("CREATE MACRO", {"name": name, "params": params, "body": p.expr()})


def _role(p: Parser) -> S.Statement:
    p.i += 1
    while p.tok.kind != "end" and not p.is_op(";"):
        p.i += 1
    return S.Statement("UNSUPPORTED", {"what": "users and roles"})


def _alter(p: Parser) -> S.Statement:
    name = p.name()
    args: dict = {"name": name}
    if p.word("ADD"):
        if p.word("FROM"):
            a = p.name()
            p.need_word("TO")
            return S.Statement("ALTER", args | {"action": "ADD ENDS", "ends": (a, p.name())})
        absent = _exists(p)
        column, kind = p.name(), p.type_name()
        default = p.expr() if p.word("DEFAULT") else None
        return S.Statement("ALTER", args | {"action": "ADD", "column": column, "type": kind, "default": default, "if_not_exists": absent})
    if p.word("DROP"):
        if p.word("FROM"):
            a = p.name()
            p.need_word("TO")
            return S.Statement("ALTER", args | {"action": "DROP ENDS", "ends": (a, p.name())})
        exists = p.word("IF", "EXISTS")
        return S.Statement("ALTER", args | {"action": "DROP", "column": p.name(), "if_exists": exists})
    p.need_word("RENAME")
    if p.word("TO"):
        return S.Statement("ALTER", args | {"action": "RENAME TABLE", "to": p.name()})
    column = p.name()
    p.need_word("TO")
    return S.Statement("ALTER", args | {"action": "RENAME", "column": column, "to": p.name()})


def _copy(p: Parser) -> S.Statement:
    if p.op("("):
        q = p.query()
        p.need(")")
        p.need_word("TO")
        p.i += 1
        path = p.toks[p.i - 1].value
        return S.Statement("COPY TO", {"query": q, "path": path, "options": p.options() if p.is_op("(") else {}})
    name, columns = p.name(), []
    if p.is_op("("):
        p.need("(")
        columns = p.some(p.name)
    p.need_word("FROM")
    source = p.source()
    by_column = p.word("BY", "COLUMN")
    options = p.options() if p.is_op("(") else {}
    return S.Statement("COPY FROM", {"name": name, "columns": columns, "source": source, "by_column": by_column, "options": options})
