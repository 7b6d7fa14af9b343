"""Recursive-descent parser: query text to syntax trees."""

from __future__ import annotations

import itertools
from typing import Any

from . import syntax as S
from .lexer import QueryError, Token, tokens

DEFAULT_HIGH = 30
_CLAUSES = frozenset("MATCH OPTIONAL WHERE RETURN WITH UNWIND ORDER SKIP LIMIT UNION CREATE MERGE SET DELETE DETACH ON CALL YIELD LOAD HINT THEN ELSE END WHEN AND OR XOR AS ASC ASCENDING DESC DESCENDING".split())
_COMPARE = {"=", "<>", "<", "<=", ">", ">="}
_MODES = {("SHORTEST",): "SHORTEST", ("ALL", "SHORTEST"): "ALL SHORTEST", ("WSHORTEST",): "WSHORTEST", ("ALL", "WSHORTEST"): "ALL WSHORTEST", ("TRAIL",): "TRAIL", ("ACYCLIC",): "ACYCLIC", ("WALK",): "WALK"}


class Parser:
    def __init__(self, text: str, dialect: str = "analytics"):
        self.text, self.toks, self.i, self.dialect = text, tokens(text), 0, dialect
        self.fresh = itertools.count()

    # --- tokens
    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def is_word(self, *words: str) -> bool:
        return all(self.ahead(k).upper == w for k, w in enumerate(words))

    def is_op(self, op: str, n: int = 0) -> bool:
        t = self.ahead(n)
        return t.kind == "op" and t.value == op

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += len(words)
            return True
        return False

    def op(self, op: str) -> bool:
        if self.is_op(op):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            raise self.error(f"expected {op!r}")

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            raise self.error(f"expected {' '.join(words)}")

    def error(self, what: str) -> QueryError:
        return QueryError(f"{what}, found {self.tok.value or 'the end'!r} at {self.tok.at}")

    def name(self) -> str:
        if self.tok.kind not in ("word", "quoted"):
            raise self.error("expected a name")
        self.i += 1
        return self.toks[self.i - 1].value

    def some(self, one, until: str = ")") -> list:
        found = []
        if not self.is_op(until):
            found.append(one())
            while self.op(","):
                found.append(one())
        self.need(until)
        return found

    # --- statements
    def statements(self) -> list:
        found = []
        while self.tok.kind != "end":
            if self.op(";"):
                continue
            found.append(self.statement())
            if self.tok.kind != "end":
                self.need(";")
        return found

    def statement(self) -> Any:
        if self.word("EXPLAIN"):
            logical = self.word("LOGICAL")
            return S.Statement("EXPLAIN", {"logical": logical, "of": self.statement()})
        if self.word("PROFILE"):
            return S.Statement("PROFILE", {"of": self.statement()})
        from .ddl import parse_statement

        return parse_statement(self) or self.query()

    def query(self) -> S.Query:
        parts, kinds = [self.single()], set()
        while self.word("UNION"):
            kinds.add(self.word("ALL"))
            parts.append(self.single())
        if len(kinds) > 1:
            raise QueryError("UNION and UNION ALL can't be mixed")
        return S.Query(parts, kinds == {True})

    def single(self) -> list:
        clauses = []
        while clause := self.clause():
            clauses.append(clause)
            if isinstance(clause, S.Return):
                break
        if not clauses:
            raise self.error("expected a clause")
        return clauses

    def clause(self) -> Any:
        if self.is_word("OPTIONAL", "MATCH") or self.is_word("MATCH"):
            optional = self.word("OPTIONAL")
            self.need_word("MATCH")
            patterns = self.patterns()
            where = self.expr() if self.word("WHERE") else None
            hint = self.hint() if self.word("HINT") else None
            return S.Match(patterns, where, optional, hint)
        if self.word("UNWIND"):
            e = self.expr()
            self.need_word("AS")
            return S.Unwind(e, self.name())
        if self.word("WITH"):
            body = self.projection()
            body.where = self.expr() if self.word("WHERE") else None
            return S.With(body)
        if self.word("RETURN"):
            return S.Return(self.projection())
        if self.word("LOAD"):
            return self.load_from()
        if self.word("CALL"):
            name = self.name()
            self.need("(")
            args = self.some(self.argument)
            where = self.expr() if self.word("WHERE") else None
            yields = []
            if self.word("YIELD"):
                yields = [self.yield_item()]
                while self.op(","):
                    yields.append(self.yield_item())
            where = self.expr() if self.word("WHERE") else where
            return S.InCall(name, args, yields, where)
        if self.word("CREATE"):
            return S.Create(self.patterns())
        if self.word("MERGE"):
            pattern, on_match, on_create = self.patterns(), [], []
            while self.is_word("ON"):
                self.i += 1
                into = on_match if self.word("MATCH") else on_create if self.word("CREATE") else None
                if into is None:
                    raise self.error("expected MATCH or CREATE")
                self.need_word("SET")
                into += self.set_items()
            return S.Merge(pattern, on_match, on_create)
        if self.word("SET"):
            return S.SetItems(self.set_items())
        if self.is_word("DETACH", "DELETE") or self.is_word("DELETE"):
            detach = self.word("DETACH")
            self.need_word("DELETE")
            exprs = [self.expr()]
            while self.op(","):
                exprs.append(self.expr())
            return S.Delete(exprs, detach)
        return None

    def yield_item(self) -> tuple[str, str]:
        name = self.name()
        return name, self.name() if self.word("AS") else name

    def argument(self) -> S.Expr:
        """A function argument of CALL; `name := value` keeps its name."""
        if self.tok.kind == "word" and self.is_op(":=", 1):
            name = self.name()
            self.need(":=")
            return S.StructOf({name: self.expr()})
        return self.expr()

    def load_from(self) -> S.LoadFrom:
        columns = []
        if self.word("WITH", "HEADERS"):
            self.need("(")
            columns = self.some(lambda: (self.name(), self.type_name()))
        self.need_word("FROM")
        source = self.source()
        options = self.options() if self.is_op("(") else {}
        where = self.expr() if self.word("WHERE") else None
        return S.LoadFrom(source, columns, options, where)

    def source(self) -> Any:
        """A path, a list of paths, a glob, a subquery, a parameter, or a name."""
        if self.tok.kind == "string":
            self.i += 1
            return self.toks[self.i - 1].value
        if self.tok.kind == "param":
            self.i += 1
            return S.Param(self.toks[self.i - 1].value)
        if self.op("["):
            return self.some(self.source, "]")
        if self.is_word("GLOB"):
            self.i += 1
            self.need("(")
            found = self.source()
            self.need(")")
            return found
        if self.op("("):
            if self.tok.kind == "string":
                return self.some(self.source)
            q = self.query()
            self.need(")")
            return q
        return S.Var(self.name())

    def options(self) -> dict[str, Any]:
        self.need("(")

        def one() -> tuple[str, Any]:
            key = self.name().lower()
            if not self.op("="):
                return key, True
            return key, literal(self.expr())

        return dict(self.some(one))

    def set_items(self) -> list[tuple[S.Expr, S.Expr]]:
        found = []
        while True:
            target = self.postfix(self.atom())
            self.need("=")
            found.append((target, self.expr()))
            if not self.op(","):
                return found

    def projection(self) -> S.Projection:
        body = S.Projection([], self.word("DISTINCT"))
        body.items.append(self.item())
        while self.op(","):
            body.items.append(self.item())
        if self.word("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                body.order.append((e, down))
                if not self.op(","):
                    break
        while self.is_word("SKIP") or self.is_word("LIMIT"):
            if self.word("SKIP"):
                body.skip = self.expr()
            else:
                self.need_word("LIMIT")
                body.limit = self.expr()
        return body

    def item(self) -> S.Item:
        if self.op("*"):
            return S.Item(S.Star(), None)
        start = self.tok.at
        e = self.expr()
        if isinstance(e, S.Var) and self.is_op(".") and self.is_op("*", 1):
            self.i += 2
            return S.Item(S.Star(e.name), None)
        e.text = self.text[start : self.toks[self.i - 1].end].strip()
        return S.Item(e, self.name() if self.word("AS") else None)

    def hint(self) -> Any:
        def one() -> Any:
            if self.op("("):
                inner = joined()
                self.need(")")
                return inner
            return self.name()

        def joined() -> Any:
            left = one()
            while self.is_word("JOIN") or self.is_word("MULTI_JOIN"):
                kind = self.name().upper()
                left = [left, kind, one()]
            return left

        return joined()

    # --- patterns
    def patterns(self) -> list[S.Path]:
        found = [self.path()]
        while self.op(","):
            found.append(self.path())
        return found

    def path(self) -> S.Path:
        var = None
        if self.tok.kind in ("word", "quoted") and self.is_op("=", 1):
            var = self.name()
            self.need("=")
        if self.is_op("(") and self.is_op("(", 1):
            self.need("(")
            inner = self.path()
            self.need(")")
            return inner
        nodes, rels = [self.node()], []
        while self.is_op("-") or self.is_op("<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        return S.Path(var, nodes, rels)

    def labels(self) -> list[str]:
        found = []
        if self.op(":"):
            found.append(self.name())
            while self.op(":") or self.op("|"):
                self.op(":")
                found.append(self.name())
        return found

    def props(self) -> dict[str, S.Expr]:
        if not self.op("{"):
            return {}

        def one() -> tuple[str, S.Expr]:
            key = self.name()
            self.need(":")
            return key, self.expr()

        return dict(self.some(one, "}"))

    def node(self) -> S.NodePattern:
        self.need("(")
        named = self.tok.kind in ("word", "quoted")
        var = self.name() if named else f"_n{next(self.fresh)}"
        labels, props = self.labels(), self.props()
        self.need(")")
        return S.NodePattern(var, labels, props, named)

    def rel(self) -> S.RelPattern:
        left = self.op("<-")
        if not left:
            self.need("-")
        var, named, types, props, recursion = f"_r{next(self.fresh)}", False, [], {}, None
        if self.op("["):
            if self.tok.kind in ("word", "quoted"):
                var, named = self.name(), True
            types = self.labels()
            if self.op("*"):
                recursion = self.recursion()
            props = self.props()
            self.need("]")
        right = self.op("->")
        if not right:
            self.need("-")
        if left and right:
            raise QueryError("a relationship has one direction")
        return S.RelPattern(var, types, props, "<-" if left else "->" if right else "--", recursion, named)

    def recursion(self) -> S.Recursion:
        r = S.Recursion(1, None)
        for words, mode in _MODES.items():
            if self.word(*words):
                r.mode = mode
                if mode.endswith("WSHORTEST"):
                    self.need("(")
                    r.weight = self.name()
                    self.need(")")
                break
        if self.tok.kind == "int" or self.is_op(".."):
            low = self.tok.kind == "int"
            if low:
                r.low = int(self.tok.value)
                self.i += 1
            if self.op(".."):
                if self.tok.kind == "int":
                    r.high = int(self.tok.value)
                    self.i += 1
            elif low:
                r.high = r.low
        elif self.tok.kind == "float":  # "1..3" never lexes so, but "1." does not occur either
            raise self.error("bounds are whole numbers")
        if self.op("("):
            r.rel_var = self.name()
            self.need(",")
            r.node_var = self.name()
            if self.op("|"):
                if self.word("WHERE"):
                    r.where = self.expr()
                if self.op("|") or self.is_op("{"):
                    r.rel_items = self.braces()
                    self.need(",")
                    r.node_items = self.braces()
            self.need(")")
        return r

    def braces(self) -> list[S.Item]:
        self.need("{")
        return self.some(self.item, "}")

    # --- expressions, loosest first
    def expr(self) -> S.Expr:
        start = self.tok.at
        e = self.binary_word("OR", lambda: self.binary_word("XOR", lambda: self.binary_word("AND", self.negation)))
        if not e.text:
            e.text = self.text[start : self.toks[self.i - 1].end].strip()
        return e

    def binary_word(self, word: str, below) -> S.Expr:
        left = below()
        while self.word(word):
            left = S.Call(word, [left, below()])
        return left

    def negation(self) -> S.Expr:
        if self.word("NOT"):
            return S.Call("NOT", [self.negation()])
        return self.comparison()

    def comparison(self) -> S.Expr:
        left = self.bit_or()
        if self.tok.kind == "op":
            sign = self.tok.value
            if sign == "!=":
                if self.dialect != "follower":
                    raise QueryError("Unknown operation '!=' (you probably meant to use '<>', which is the operator for inequality testing.)")
                sign = "<>"
            if sign in _COMPARE:
                self.i += 1
                left = S.Call(sign, [left, self.bit_or()])
                if self.tok.kind == "op" and self.tok.value in _COMPARE:
                    raise QueryError("comparisons can't be chained")
        return left

    def _left(self, ops: dict[str, str], below) -> S.Expr:
        left = below()
        while self.tok.kind == "op" and self.tok.value in ops:
            name = ops[self.tok.value]
            self.i += 1
            left = S.Call(name, [left, below()])
        return left

    def bit_or(self) -> S.Expr:
        if self.no_pipe:
            return self.bit_and()
        return self._left({"|": "BITWISE_OR"}, self.bit_and)

    no_pipe = False

    def bit_and(self) -> S.Expr:
        return self._left({"&": "BITWISE_AND"}, self.shift)

    def shift(self) -> S.Expr:
        return self._left({"<<": "BITSHIFT_LEFT", ">>": "BITSHIFT_RIGHT"}, self.additive)

    def additive(self) -> S.Expr:
        return self._left({"+": "+", "-": "-"}, self.multiplicative)

    def multiplicative(self) -> S.Expr:
        return self._left({"*": "*", "/": "/", "%": "%"}, self.power)

    def power(self) -> S.Expr:
        return self._left({"^": "POW"}, self.unary)

    def unary(self) -> S.Expr:
        if self.op("-"):
            e = self.unary()
            return S.Lit(-e.value) if isinstance(e, S.Lit) and isinstance(e.value, int | float) and not isinstance(e.value, bool) else S.Call("NEGATE", [e])
        if self.op("+"):
            return self.unary()
        e = self.operators()
        if self.op("!"):
            e = S.Call("FACTORIAL", [e])
        return e

    def operators(self) -> S.Expr:
        e = self.postfix(self.atom())
        while True:
            if self.word("IN"):
                e = S.Call("LIST_CONTAINS", [self.postfix(self.atom()), e])
            elif self.word("STARTS", "WITH"):
                e = S.Call("STARTS_WITH", [e, self.postfix(self.atom())])
            elif self.word("ENDS", "WITH"):
                e = S.Call("ENDS_WITH", [e, self.postfix(self.atom())])
            elif self.is_word("CONTAINS"):
                self.i += 1
                e = S.Call("CONTAINS", [e, self.postfix(self.atom())])
            elif self.op("=~"):
                e = S.Call("REGEXP_FULL_MATCH", [e, self.postfix(self.atom())])
            elif self.word("IS", "NULL"):
                e = S.Call("IS NULL", [e])
            elif self.word("IS", "NOT", "NULL"):
                e = S.Call("IS NOT NULL", [e])
            else:
                return e

    def postfix(self, e: S.Expr) -> S.Expr:
        while True:
            if self.is_op(".") and not self.is_op("*", 1):
                self.i += 1
                e = S.Prop(e, self.name())
            elif self.op("["):
                low = None if self.is_op(":") or self.is_op("..") else self.expr()
                if self.op(":") or self.op(".."):
                    high = None if self.is_op("]") else self.expr()
                    self.need("]")
                    e = S.Slice(e, low, high)
                else:
                    self.need("]")
                    e = S.Index(e, low)
            elif self.op("::"):
                e = S.CastTo(e, self.type_name())
            else:
                return e

    def type_name(self) -> str:
        """The text of a type: a name, its parameters, and list brackets."""
        start = self.tok.at
        self.name()
        depth = 0
        if self.is_op("("):
            while True:
                depth += self.is_op("(") - self.is_op(")")
                self.i += 1
                if depth == 0:
                    break
        while self.is_op("[") and (self.is_op("]", 1) or self.ahead().kind == "int" and self.is_op("]", 2)):
            self.i += 2 + (not self.is_op("]", 1))
        return self.text[start : self.toks[self.i - 1].end]

    def _is_pattern(self) -> bool:
        """Whether a parenthesis opens a path of at least one relationship."""
        at, depth = self.i, 0
        for k in range(at, len(self.toks)):
            t = self.toks[k]
            if t.kind == "op" and t.value in "([{":
                depth += 1
            elif t.kind == "op" and t.value in ")]}":
                depth -= 1
                if depth == 0:
                    n, m, o = self.toks[k + 1 : k + 4] + [self.toks[-1]] * (3 - len(self.toks[k + 1 : k + 4]))
                    inner = self.toks[at + 1 : k]
                    plain = all(t.kind in ("word", "quoted") or t.value in (":", "|") for t in inner) or any(t.value == "{" for t in inner)
                    arrow = n.value == "-" and (m.value in ("[", "-", "->") or m.value == ">" ) or n.value == "<-" and m.value in ("[", "-")
                    return plain and arrow and not (n.value == "-" and m.value == "[" and self.no_pattern)
        return False

    no_pattern = False

    def atom(self) -> S.Expr:
        t = self.tok
        if t.kind == "int":
            self.i += 1
            return S.Lit(int(t.value))
        if t.kind == "float":
            self.i += 1
            return S.Lit(float(t.value))
        if t.kind == "string":
            self.i += 1
            return S.Lit(t.value)
        if t.kind == "param":
            self.i += 1
            return S.Param(t.value)
        if self.op("["):
            return S.ListOf(self.some(self.expr, "]"))
        if self.is_op("{"):
            self.i += 1

            def pair() -> tuple[str, S.Expr]:
                key = self.tok.value
                self.i += 1
                self.need(":")
                return key, self.expr()

            return S.StructOf(dict(self.some(pair, "}")))
        if self.is_op("("):
            if self._is_pattern():
                return S.Subquery("EXISTS", [self.path()], None)
            self.i += 1
            kept, self.no_pipe = self.no_pipe, False
            e = self.expr()
            self.no_pipe = kept
            self.need(")")
            return e
        if t.kind == "quoted":
            self.i += 1
            return S.Var(t.value)
        if t.kind != "word":
            raise self.error("expected an expression")
        up = t.upper
        if up in ("TRUE", "FALSE"):
            self.i += 1
            return S.Lit(up == "TRUE")
        if up == "NULL":
            self.i += 1
            return S.Lit(None)
        if up == "CASE":
            return self.case()
        if up in ("EXISTS", "COUNT") and self.is_op("{", 1):
            self.i += 2
            self.word("MATCH")
            patterns = self.patterns()
            where = self.expr() if self.word("WHERE") else None
            self.need("}")
            return S.Subquery(up, patterns, where)
        if up in ("ANY", "ALL", "NONE", "SINGLE") and self.is_op("(", 1) and self.ahead(3).upper == "IN":
            self.i += 2
            var = self.name()
            self.need_word("IN")
            of = self.expr()
            self.need_word("WHERE")
            body = self.expr()
            self.need(")")
            return S.Call(up, [of, S.Lambda([var], body)])
        if self.is_op("(", 1):
            return self.call()
        self.i += 1
        return S.Var(t.value)

    def case(self) -> S.Case:
        self.need_word("CASE")
        subject = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.word("WHEN"):
            c = self.expr()
            self.need_word("THEN")
            whens.append((c, self.expr()))
        otherwise = self.expr() if self.word("ELSE") else None
        self.need_word("END")
        return S.Case(subject, whens, otherwise)

    def call(self) -> S.Expr:
        name = self.name().upper()
        self.need("(")
        if name == "CAST":
            e = self.expr()
            if self.word("AS"):
                kind = self.type_name()
            else:
                self.need(",")
                kind = self.tok.value
                self.i += 1
            self.need(")")
            return S.CastTo(e, kind)
        if name == "COUNT" and self.op("*"):
            self.need(")")
            return S.Call("COUNT_STAR", [])
        distinct = self.word("DISTINCT")
        named: dict[str, S.Expr] = {}

        def one() -> S.Expr:
            if self.tok.kind == "word" and self.is_op(":=", 1):
                key = self.name()
                self.need(":=")
                named[key] = self.expr()
                return named[key]
            return self.lambda_or_expr()

        return S.Call(name, self.some(one), distinct, named)

    def lambda_or_expr(self) -> S.Expr:
        at = self.i
        if self.tok.kind in ("word", "quoted") and self.is_op("->", 1):
            var = self.name()
            self.need("->")
            return S.Lambda([var], self.expr())
        if self.is_op("("):
            k, names = 1, []
            while self.ahead(k).kind in ("word", "quoted"):
                names.append(self.ahead(k).value)
                k += 1
                if not self.is_op(",", k):
                    break
                k += 1
            if names and self.is_op(")", k) and self.is_op("->", k + 1) and len(names) > 0:
                nxt = self.ahead(k + 2)
                if not (nxt.kind == "op" and nxt.value == "(" and len(names) == 1):
                    self.i = at + k + 2
                    return S.Lambda(names, self.expr())
        return self.expr()


def literal(e: S.Expr) -> Any:
    """The value of a constant: options and defaults."""
    if isinstance(e, S.Lit):
        return e.value
    if isinstance(e, S.ListOf):
        return [literal(x) for x in e.items]
    if isinstance(e, S.StructOf):
        return {k: literal(v) for k, v in e.items.items()}
    if isinstance(e, S.Var):
        return e.name
    if isinstance(e, S.Call) and e.name == "NEGATE":
        return -literal(e.args[0])
    raise QueryError("expected a constant")


def parse(text: str, dialect: str = "analytics") -> list:
    return Parser(text, dialect).statements()
