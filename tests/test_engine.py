"""Small graphs, one per trap of the language."""

import datetime as dt
import pathlib

import pytest

from weftgraph.plans.lexer import QueryError
from weftgraph.plans.parser import parse
from weftgraph.session import Session


def graph(spark, *statements):
    s = Session(spark)
    for t in statements:
        s.query(t)
    return s


def values(df):
    return [tuple(r) for r in df.collect()]


def one(session, text, **params):
    (row,) = values(session.query(text, params))
    return row[0] if len(row) == 1 else row


@pytest.fixture(scope="module")
def plain(spark):
    return Session(spark)


@pytest.fixture(scope="module")
def diamond(spark):
    """a->b->d, a->c->d, a->d with weights 5, 1, 1, 1, 9."""
    return graph(
        spark, "CREATE NODE TABLE N(id STRING, x INT64, PRIMARY KEY(id)); CREATE REL TABLE R(FROM N TO N, w INT64, z DECIMAL(5,2))",
        "UNWIND [{i: 'a', x: 1}, {i: 'b', x: 2}, {i: 'c', x: 3}, {i: 'd', x: 4}] AS r CREATE (n:N {id: r.i, x: r.x})",
        "UNWIND [{s: 'a', t: 'b', w: 5}, {s: 'b', t: 'd', w: 1}, {s: 'a', t: 'c', w: 1}, {s: 'c', t: 'd', w: 1}, {s: 'a', t: 'd', w: 9}] AS r MATCH (p:N {id: r.s}), (q:N {id: r.t}) CREATE (p)-[:R {w: r.w}]->(q)",
    )


@pytest.fixture(scope="module")
def loops(spark):
    """A self-loop on 1 and a cycle between 1 and 2."""
    return graph(
        spark, "CREATE NODE TABLE N(id INT64, PRIMARY KEY(id)); CREATE REL TABLE R(FROM N TO N)", "UNWIND [1, 2] AS x CREATE (:N {id: x})",
        "UNWIND [[1, 1], [1, 2], [2, 1]] AS p MATCH (a:N {id: p[1]}), (b:N {id: p[2]}) CREATE (a)-[:R]->(b)",
    )


# --- expressions
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("round(1e17, 3)", 1e17), ("floor(1e300)", 1e300), ("ceil(-1e300)", -1e300), ("even(1e19)", 1e19), ("even(-2.5)", -4.0), ("round(-2.5, 0)", -3.0), ("round(12345.678, -2)", 12300.0), ("floor(-0.5)", -1.0), ("to_string(ceil(-0.5))", "-0.000000"), ("to_string(floor(0.5))", "0.000000"), ("ceil(0.5)", 1.0), ("ceil(null)", None), ("5.0 / 0", float("inf")), ("-5.0 / 0", float("-inf")), ("to_string(0.0 / 0)", "NaN"), ("to_string(5.0 % 0)", "NaN"), ("7.5 % 2", 1.5), ("null / 0.0", None),
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 2.0", 3.5), ("2 ^ 3", 8.0), ("-7 % 3", -1), ("log(100)", 2.0), ("5!", 120), ("1 + 2 * 3", 7), ("-2 ^ 2", 4.0), ("6 & 3", 2), ("6 | 3", 7), ("1 << 4", 16),
        ("concat('a', null, 'b')", "ab"), ("'x' + null", "x"), ("[1] + [2]", [1, 2]), ("substr('hello', 0, 2)", ""), ("left('hello', -2)", "hel"), ("right('hello', -2)", "llo"), ("initcap('hELLO wO')", "Hello wo"),
        ("string_split('a.b.c', '.')", ["a", "b", "c"]), ("split_part('a-b', '-', 3)", ""), ("array_extract('abc', -1)", "c"), ("regexp_replace('aXbX', 'X', '-')", "a-bX"), ("regexp_replace('aXbX', '(X)', '<\\\\1>', 'g')", "a<X>b<X>"),
        ("regexp_replace('ab12', '([a-z])([0-9])', '\\\\2\\\\1')", "a1b2"), ("'abc' =~ 'b'", False), ("regexp_matches('abc', 'b')", True), ("regexp_extract('a12', '[0-9]+')", "12"), ("levenshtein('kitten', 'sitting')", 3), ("repeat('ab', 3)", "ababab"),
        ("cast(2.5 AS INT64)", 2), ("cast(3.5 AS INT64)", 4), ("cast('12' AS INT8)", 12), ("cast(1.239 AS DECIMAL(5, 2)) = cast('1.24' AS DECIMAL(5, 2))", True), ("to_string([1, 2])", "[1,2]"), ("to_string({a: 1, b: 'x'})", "{a: 1, b: x}"), ("string(true)", "True"),
        ("cast('[1,2]' AS INT64[])", [1, 2]), ("cast('[[1,2],[3]]' AS INT64[][])", [[1, 2], [3]]), ("greatest(date('2020-01-01'), null)", None), ("date('2020-01-31') + interval('1 month')", dt.date(2020, 2, 29)), ("date('2020-03-01') - date('2020-02-01')", 29),
        ("date_part('century', date('2000-05-05'))", 20), ("date_part('decade', date('1999-05-05'))", 199), ("date_trunc('century', date('1999-05-05'))", dt.date(1900, 1, 1)), ("dayname(date('2024-02-29'))", "Thursday"), ("monthname(date('2024-02-29'))", "February"),
        ("interval('1 month') = interval('30 days')", True), ("to_string(interval('1 year 2 days 03:04:05'))", "1 year 2 days 03:04:05"), ("date_part('minute', to_seconds(125))", 2), ("epoch_ms(1000)", dt.datetime(1970, 1, 1, 0, 0, 1)), ("to_epoch_ms(timestamp('1970-01-01 00:00:02'))", 2000),
        ("timestamp('2020-01-02 00:00:00') - timestamp('2020-01-01 00:00:00') > to_hours(23)", True), ("range(1, 5, 2)", [1, 3, 5]), ("range(5, 1)", []), ("range(3, 1, -1)", [3, 2, 1]), ("[1,2,3,4][2:3]", [2, 3]), ("[1,2,3][-1]", 3), ("list_slice([1,2,3], -2, -1)", [2, 3]),
        ("list_sort([3, null, 1])", [None, 1, 3]), ("list_sort([3, null, 1], 'DESC', 'NULLS LAST')", [3, 1, None]), ("list_distinct([1, null, 1, 2])", [1, 2]), ("list_unique([1, null, 1])", 1), ("list_sum([1, null, 2])", 3), ("list_product([2, 3])", 6), ("3 IN [1, 2]", False), ("list_contains([1, null], 2)", False),
        ("list_position([1, 2], 'x')", 0), ("list_has_all([1, 2, 3], [3, 1])", True), ("list_any_value([null, 4])", 4), ("list_reduce([1, 2, 3], (a, b) -> a * b)", 6), ("list_transform([1, 2], x -> x * 10)", [10, 20]), ("list_filter([1, 2, 3], x -> x > 1)", [2, 3]),
        ("any(x IN [1, 2] WHERE x > 1)", True), ("all(x IN [1, 2] WHERE x > 1)", False), ("none(x IN [1, 2] WHERE x > 5)", True), ("single(x IN [1, 2] WHERE x > 1)", True), ("map_extract(map([1, 2], ['a', 'b']), 2)", ["b"]), ("map_extract(map([1], ['a']), 9)", []), ("union_tag(union_value(q := 1))", "q"),
        ("count_if(3 > 2)", 1), ("constant_or_null(1, null)", None), ("nullif(1, 1)", None), ("ifnull(null, 2)", 2), ("typeof([1])", "INT64[]"), ("typeof({a: 1.5})", "STRUCT(a DOUBLE)"), ("md5('a')", "0cc175b9c0f1b6a831c399e269772661"), ("octet_length(encode('é'))", 2), ("even(2.1)", 4.0), ("even(-2.1)", -4.0), ("sign(-2.5)", -1), ("round(2.5, 0)", 3.0), ("round(-2.567, 2)", -2.57),
        ("null = null", None), ("false AND null", False), ("true OR null", True), ("true XOR null", None), ("NOT null", None), ("null IS NULL", True), ("CASE WHEN false THEN 1 END", None), ("CASE 2 WHEN 2 THEN 'b' ELSE 'c' END", "b"), ("array_cross_product([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])", [0.0, 0.0, 1.0]), ("array_distance([0.0, 3.0], [4.0, 0.0])", 5.0),
        ("size('héllo')", 5), ("gamma(5.0)", 24.0), ("pi() > 3.14", True), ("cast('{a: 1}' AS STRUCT(a INT64)).a", 1), ("cast('\\\\x41' AS BLOB)", bytearray(b"A")), ("uuid('{A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11}')", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), 
    ],
)
def test_expressions(plain, text, want):
    got = one(plain, f"RETURN {text} AS v")
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize("text", ["1 / 0", "cast(300 AS INT8)", "cast(-1 AS UINT8)", "[1, 2][5]", "range(1, 2, 0)", "error('x')", "list_reduce(list_filter([1], x -> x > 1), (a, b) -> a + b)", "9223372036854775807 + 1"])
def test_expressions_that_raise(plain, text):
    with pytest.raises(Exception):
        plain.query(f"RETURN {text} AS v").collect()


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) RETURN a.x != 1", "RETURN 1 < 2 < 3", "RETURN *", "MATCH (n:N) RETURN n.nope", "MATCH (n:Nope) RETURN n", "MATCH (a:N)-[e:R]->(b)-[e:R]->(c) RETURN a", "MATCH (n:N) WITH n ORDER BY n.x RETURN n", "MATCH (n:N) RETURN n ORDER BY n",
        "RETURN 1 AS a UNION RETURN 2 AS a UNION ALL RETURN 3 AS a", "RETURN 1 AS a UNION RETURN 1 AS a, 2 AS b", "MATCH (n:N) RETURN sum(count(*))", "MATCH (a:N)-[e:R*3..2]->(b) RETURN a", "MATCH (a:N)-[e:R* SHORTEST 2..3]->(b) RETURN a", "MATCH (a:N)-[e:R*1..99]->(b) RETURN a",
        "MATCH (a:N)-[e:R* WSHORTEST(z) 1..3]->(b) RETURN a", "MATCH (a:N)-[e:R*1..2 (r, n | WHERE r.w > n.x)]->(b) RETURN a", "MATCH (n:N) RETURN x", "RETURN nothing(1)", "MATCH (n:N)", "RETURN $x", "MATCH (n:N) RETURN n LIMIT -1", "CREATE (n:N {id: 'a'})", "CREATE (n:N {nope: 1})", "RETURN greatest(1, 2)",
    ],
)
def test_queries_that_are_rejected(diamond, text):
    with pytest.raises(QueryError):
        diamond.query(text).collect()


# --- patterns
def test_undirected_and_loops(loops):
    assert one(loops, "MATCH (a)-[:R]->(b) RETURN count(*)") == 3
    assert one(loops, "MATCH (a)-[:R]-(b) RETURN count(*)") == 6
    assert one(loops, "MATCH (a)-[:R]->(a) RETURN a.id") == 1
    assert one(loops, "MATCH (a {id: 1})-[:R*TRAIL 1..4]->(b) RETURN count(*)") == 1 + 1 + 2 + 2  # loop; out; loop-out, out-back; loop-out-back, out-back-loop
    assert one(loops, "MATCH (a {id: 1})-[:R*ACYCLIC 1..4]->(b) RETURN count(*)") == 1
    assert one(loops, "MATCH (a {id: 2})-[:R*0..1]->(b) RETURN count(*)") == 2
    assert one(loops, "MATCH (a)-[:R* SHORTEST 1..4]->(b) RETURN count(*)") == 2


def test_shortest_paths(diamond):
    q = lambda mode: sorted(values(diamond.query(f"MATCH (a:N {{id: 'a'}})-[e:R* {mode} 1..5]->(b:N {{id: 'd'}}) RETURN length(e)")))
    assert q("SHORTEST") == [(1,)] and q("ALL SHORTEST") == [(1,)] and q("WSHORTEST(w)") == [(2,)] and q("WALK") == [(1,), (2,), (2,)]
    assert one(diamond, "MATCH (a:N {id: 'a'})-[e:R* WSHORTEST(w) 1..5]->(b:N {id: 'd'}) RETURN cost(e), list_to_string('', properties(nodes(e), 'id'))") == (2.0, "c")
    assert one(diamond, "MATCH p = (a:N {id: 'a'})-[e:R* ALL WSHORTEST(w) 1..5]->(b:N {id: 'd'}) RETURN length(p), size(nodes(p)), is_acyclic(p)") == (2, 3, True)
    # the node predicate holds for nodes between only
    assert values(diamond.query("MATCH (a:N {id: 'a'})-[e:R*1..3 (r, n | WHERE n.x = 3)]->(b:N {id: 'd'}) RETURN length(e) AS n ORDER BY n")) == [(1,), (2,)]
    assert values(diamond.query("MATCH (a:N)<-[e:R*2..2]-(b:N) RETURN a.id, b.id, list_to_string('', properties(nodes(e), 'id')) AS m ORDER BY m")) == [("d", "a", "b"), ("d", "a", "c")]


def test_recursion_invariants(diamond):
    n = {m: one(diamond, f"MATCH (a:N)-[e:R* {m} 1..4]->(b:N) RETURN count(*)") for m in ("WALK", "TRAIL", "ACYCLIC", "SHORTEST", "ALL SHORTEST")}
    assert n["WALK"] >= n["TRAIL"] >= n["ACYCLIC"] >= n["ALL SHORTEST"] >= n["SHORTEST"]
    assert one(diamond, "MATCH (a:N)-[e:R*1..4]->(b:N) RETURN sum(length(e)) = sum(size(rels(e)))")


def test_elements_as_values(diamond):
    row = one(diamond, "MATCH (a:N {id: 'a'})-[e:R]->(b:N {id: 'c'}) RETURN a, e, label(a), label(e), start_node(e).id, end_node(e).id, keys(e), id(a) = id(b), a <> b")
    assert row[0]["x"] == 1 and row[0]["_LABEL"] == "N" and row[1]["w"] == 1 and row[2:] == ("N", "R", "a", "c", ["w", "z"], False, True)


def test_several_labels(spark):
    s = graph(spark, "CREATE NODE TABLE A(id INT64, v INT64, PRIMARY KEY(id)); CREATE NODE TABLE B(id INT64, v DOUBLE, w STRING, PRIMARY KEY(id)); CREATE REL TABLE T(FROM A TO B, FROM B TO A, k INT64)", "CREATE (:A {id: 1, v: 2})-[:T {k: 7}]->(:B {id: 1, v: 2.5, w: 'x'})", "MATCH (a:A), (b:B) CREATE (b)-[:T {k: 8}]->(a)")
    assert values(s.query("MATCH (n) RETURN label(n) AS l, n.v, n.w ORDER BY l")) == [("A", 2.0, None), ("B", 2.5, "x")]
    assert values(s.query("MATCH (a)-[t:T]->(b) RETURN label(a), t.k, label(b) ORDER BY t.k")) == [("A", 7, "B"), ("B", 8, "A")]
    assert one(s, "MATCH (a:A)-[e:T*2..2]->(b) RETURN label(b), length(e)") == ("A", 2)


def test_order_and_nulls(spark):
    s = graph(spark, "CREATE NODE TABLE N(id INT64, x INT64, PRIMARY KEY(id))", "UNWIND [1, 2, 3] AS i CREATE (:N {id: i, x: nullif(i, 2)})")
    ids = lambda t: [r[0] for r in values(s.query(t))]
    assert ids("MATCH (n:N) RETURN n.id ORDER BY n.x") == [1, 3, 2] and ids("MATCH (n:N) RETURN n.id ORDER BY n.x DESC") == [2, 3, 1]
    assert ids("MATCH (n:N) RETURN n.id ORDER BY n.x DESC SKIP 1 LIMIT 1") == [3] and ids("MATCH (n:N) RETURN n.id AS k ORDER BY -k") == [3, 2, 1]
    assert values(s.query("MATCH (n:N) RETURN count(*), count(n.x), collect(n.x), sum(n.x), avg(n.x), count(DISTINCT n)")) == [(3, 2, [1, 3], 4, 2.0, 3)]
    assert one(s, "MATCH (n:N) WHERE n.x > 5 RETURN count(*), sum(n.x), collect(n.id)") == (0, None, [])
    assert values(s.query("UNWIND [] AS x RETURN x")) == [] and values(s.query("OPTIONAL MATCH (n:N {id: 9}) RETURN n.x")) == [(None,)]


def test_subqueries(diamond):
    assert [r[0] for r in values(diamond.query("MATCH (n:N) WHERE EXISTS { MATCH (n)-[r:R]->(m) WHERE r.w > n.x + 3 } RETURN n.id ORDER BY n.id"))] == ["a"]
    assert values(diamond.query("MATCH (n:N) RETURN n.id, COUNT { MATCH (n)-[:R]->(m) WHERE m.x > 2 } AS c, (n)-[:R]->() AS e ORDER BY n.id")) == [("a", 2, True), ("b", 1, True), ("c", 1, True), ("d", 0, False)]
    assert values(diamond.query("MATCH (n:N) WHERE NOT EXISTS { MATCH (n)-[:R]->(:N) } OR n.x = 1 RETURN n.id ORDER BY n.id")) == [("a",), ("d",)]
    assert values(diamond.query("MATCH (n:N) OPTIONAL MATCH (n)-[r:R]->(m) WHERE r.w > n.x RETURN n.id, count(m) ORDER BY n.id")) == [("a", 2), ("b", 0), ("c", 0), ("d", 0)]


def test_counting_without_matches(diamond):
    """A query that only counts gives what one that makes every match gives."""
    for pattern in ("(a:N)-[:R]->(b)-[:R]->(c)", "(a:N)-[:R]->(b), (a)-[:R]->(c)", "(a:N)<-[:R]-(b:N)-[:R]->(c:N)-[:R]->(d)", "(a:N)-[:R]->(b)-[:R]->(c), (a)-[:R]->(c)", "(a:N)-[:R]-(b)-[:R]-(c)"):
        want = dict(values(diamond.query(f"MATCH {pattern} RETURN a.id, count(b.x)")))
        assert dict(values(diamond.query(f"MATCH {pattern} RETURN a.id, count(*)"))) == want
        assert one(diamond, f"MATCH {pattern} RETURN count(*)") == sum(want.values())
        assert one(diamond, f"MATCH {pattern} WHERE a.x > 1 RETURN count(*)") == sum(n for k, n in want.items() if k != "a")
    assert one(diamond, "MATCH (a:N {id: 'd'})-[:R]->(b) RETURN count(*)") == 0


# --- changes
def test_merge_set_delete(spark):
    s = graph(spark, "CREATE NODE TABLE P(id INT64, n INT64 DEFAULT 5, s STRING, PRIMARY KEY(id)); CREATE REL TABLE K(FROM P TO P, since INT64, MANY_ONE)")
    s.query("UNWIND [1, 2, 1] AS x MERGE (p:P {id: x}) ON CREATE SET p.s = 'new' ON MATCH SET p.s = 'again'")
    assert values(s.query("MATCH (p:P) RETURN p.id, p.n, p.s ORDER BY p.id")) == [(1, 5, "again"), (2, 5, "new")]
    s.query("MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (a)-[k:K]->(b) ON CREATE SET k.since = 1; MATCH (a:P {id: 1}), (b:P {id: 2}) MERGE (a)-[k:K]->(b) ON MATCH SET k.since = k.since + 1")
    assert values(s.query("MATCH (a)-[k:K]->(b) RETURN a.id, b.id, k.since")) == [(1, 2, 2)]
    with pytest.raises(QueryError, match="multiplicity"):
        s.query("MATCH (a:P {id: 1}) CREATE (a)-[:K]->(a)")
    with pytest.raises(QueryError, match="connected edges"):
        s.query("MATCH (a:P {id: 2}) DELETE a")
    assert one(s, "MATCH (p:P {id: 1}) SET p.n = null, p.s = p.s + '!' RETURN p.n, p.s") == (None, "again!")
    s.query("MATCH (p:P {id: 1}) SET p.id = 10")
    assert values(s.query("MATCH (a)-[k:K]->(b) RETURN a.id, b.id")) == [(10, 2)]
    with pytest.raises(QueryError, match="duplicated"):
        s.query("MATCH (p:P {id: 10}) SET p.id = 2")
    s.query("BEGIN TRANSACTION; MATCH (a:P {id: 10}) DETACH DELETE a")
    assert one(s, "MATCH (p:P) RETURN count(*)") == 1
    s.query("ROLLBACK")
    assert one(s, "MATCH (a)-[k:K]->(b) RETURN count(*)") == 1
    s.query("MATCH (a)-[k:K]->(b) DELETE k; MATCH (a:P) DELETE a")
    assert one(s, "MATCH (p:P) RETURN count(*)") == 0
    with pytest.raises(QueryError, match="read-only"):
        s.query("BEGIN TRANSACTION READ ONLY; CREATE (:P {id: 1})")


def test_definitions(spark):
    s = graph(spark, "CREATE NODE TABLE A(id SERIAL, v STRING, PRIMARY KEY(id)); CREATE NODE TABLE IF NOT EXISTS A(id INT64, PRIMARY KEY(id)); CREATE REL TABLE E(FROM A TO A)")
    s.query("UNWIND ['x', 'y', 'z'] AS v CREATE (:A {v: v}); CREATE (:A {v: 'w'})")
    assert values(s.query("MATCH (a:A) RETURN a.id, a.v ORDER BY a.id"))[0::3] == [(0, "x"), (3, "w")]
    for bad in ("DROP TABLE A", "DROP TABLE Nope", "CREATE NODE TABLE A(id INT64, PRIMARY KEY(id))", "CREATE NODE TABLE B(id INT64)", "ALTER TABLE A DROP id", "ALTER TABLE A ADD v INT64", "CREATE USER bob", "LOAD EXTENSION nope", "CALL nope=1", "CREATE NODE TABLE C(id WHAT, PRIMARY KEY(id))"):
        with pytest.raises(QueryError):
            s.query(bad)
    s.query("ALTER TABLE A ADD n INT64 DEFAULT 3; ALTER TABLE A RENAME v TO name; ALTER TABLE A RENAME TO B; COMMENT ON TABLE B IS 'hello'")
    assert one(s, "MATCH (b:B {id: 0}) RETURN b.name, b.n") == ("x", 3)
    assert one(s, "CALL show_tables() WHERE type = 'NODE' RETURN name, comment") == ("B", "hello")
    assert one(s, "CALL show_connection('E') RETURN *")[:2] == ("B", "B")
    s.query("CREATE SEQUENCE q START 2 INCREMENT 3 MAXVALUE 6")
    assert one(s, "RETURN nextval('q') AS a, currval('q') AS b, nextval('q') AS c") == (2, 2, 5)
    with pytest.raises(QueryError):
        s.query("RETURN nextval('q')")
    s.query("CREATE MACRO twice(x, y := 1) AS x * 2 + y; CREATE TYPE money AS DECIMAL(10, 2)")
    assert one(s, "RETURN twice(3), twice(3, 0), typeof(cast(1 AS money))") == (7, 6, "DECIMAL(10, 2)")
    s.create_function("plus_one", lambda x: x + 1, "long")
    assert one(s, "RETURN plus_one(4)") == 5
    p = s.prepare("RETURN $a + 1 AS v")
    assert values(p.execute(a=1)) + values(p.execute(a=5)) == [(2,), (6,)]
    assert "Scan" in one(s, "EXPLAIN MATCH (b:B) RETURN b.name") and one(s, "PROFILE MATCH (b:B) RETURN b.name")[2] == 4
    for f in ("show_functions", "show_macros", "show_sequences", "show_indexes", "db_version", "catalog_version", "bm_info", "show_warnings", "show_attached_databases", "show_loaded_extensions", "fsm_info", "storage_info", "show_projected_graphs"):
        s.query(f"CALL {f}() RETURN *").collect()
    assert one(s, "CALL stats_info('B') RETURN cardinality") == 4


def test_projected_graphs(diamond):
    from weftgraph.statements import projected_session

    diamond.query("CALL project_graph('g', {N: 'n.x < 4'}, {R: 'r.w < 5'})")
    p = projected_session(diamond, "g")
    assert values(p.query("MATCH (a)-[r:R]->(b) RETURN a.id, b.id")) == [("a", "c")]
    assert one(diamond, "CALL projected_graph_info('g') WHERE `table type` = 'REL' RETURN predicate") == "r.w < 5"
    diamond.query("CALL drop_projected_graph('g')")


# --- files
def test_csv_dialects_and_errors(spark, tmp_path):
    (tmp_path / "semi.csv").write_text("id;name;tags\n1;'a;b';[x,y]\n2;c;[]\n")
    (tmp_path / "bad.csv").write_text("1,5\n2,x\n1,7\n,8\n")
    s = graph(spark, "CREATE NODE TABLE T(id INT64, name STRING, tags STRING[], PRIMARY KEY(id)); CREATE NODE TABLE U(id INT64, v INT64, PRIMARY KEY(id)); CREATE REL TABLE E(FROM T TO T, w INT64)")
    s.query(f"COPY T FROM '{tmp_path}/semi.csv'")
    assert values(s.query("MATCH (t:T) RETURN t.id, t.name, t.tags ORDER BY t.id")) == [(1, "a;b", ["x", "y"]), (2, "c", [])]
    with pytest.raises(Exception):
        s.query(f"COPY U FROM '{tmp_path}/bad.csv' (HEADER=false)")
    s.query(f"COPY U FROM '{tmp_path}/bad.csv' (HEADER=false, IGNORE_ERRORS=true)")
    assert values(s.query("MATCH (u:U) RETURN count(*)")) == [(1,)] and one(s, "CALL show_warnings() RETURN count(*)") >= 3
    (tmp_path / "rel.csv").write_text("1,2,9\n")
    (tmp_path / "lost.csv").write_text("1,77,9\n")
    s.query(f"COPY E FROM '{tmp_path}/rel.csv' (HEADER=false)")
    with pytest.raises(QueryError, match="Unable to find primary key value"):
        s.query(f"COPY E FROM '{tmp_path}/lost.csv' (HEADER=false)")
    with pytest.raises(QueryError, match="duplicated"):
        s.query(f"COPY T FROM '{tmp_path}/semi.csv'")
    s.query(f"COPY (MATCH (t:T) RETURN t.id AS id, t.name AS name) TO '{tmp_path}/out.parquet'; COPY (MATCH (t:T) RETURN t.*) TO '{tmp_path}/out.csv' (HEADER=true, DELIM='|')")
    assert values(s.query(f"LOAD FROM '{tmp_path}/out.parquet' WHERE id > 1 RETURN name")) == [("c",)]
    assert one(s, f"LOAD FROM '{tmp_path}/out.csv' (HEADER=true, DELIM='|') RETURN count(*)") == 2
    s.query(f"EXPORT DATABASE '{tmp_path}/db'")
    other = Session(spark)
    other.query(f"IMPORT DATABASE '{tmp_path}/db'")
    assert values(other.query("MATCH (a)-[e:E]->(b) RETURN a.name, e.w, b.name")) == [("a;b", 9, "c")]
    third = Session(spark)
    third.query(f"ATTACH '{tmp_path}/db' AS o; USE DATABASE o")
    assert one(third, "MATCH (t:T) RETURN count(*)") == 2


def test_npy_and_frames(spark, tmp_path):
    import numpy as np
    import pandas as pd

    np.save(tmp_path / "a.npy", np.arange(5, dtype=np.int64))
    np.save(tmp_path / "b.npy", np.arange(10, dtype=np.float32).reshape(5, 2))
    s = graph(spark, "CREATE NODE TABLE V(id INT64, e FLOAT[2], PRIMARY KEY(id))", f"COPY V FROM ('{tmp_path}/a.npy', '{tmp_path}/b.npy') BY COLUMN")
    assert values(s.query("MATCH (v:V) WHERE v.id = 3 RETURN v.e")) == [([6.0, 7.0],)]
    assert one(s, "LOAD FROM $df RETURN sum(x) AS s", df=pd.DataFrame({"x": [1, 2]})) == 3
    spark.range(4).createOrReplaceTempView("four")
    assert one(s, "LOAD FROM four WHERE id > 1 RETURN count(*)") == 2


def test_registered_frames_push_down(spark, tmp_path):
    from weftgraph.graphs import commerce

    s = commerce(spark, "/root/testdata/sf0.001")
    plan = s.query("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 RETURN count(*)")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "customer" not in plan.replace("o_custkey", "")[plan.find("Scan") :].split("ReadSchema")[1][:200]
    assert one(s, "MATCH (o:Orders)-[:CONTAINS]->(p) RETURN count(*)") == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_parser_positions():
    with pytest.raises(QueryError, match="at 7"):
        parse("RETURN ;")
    assert len(parse("RETURN 1; RETURN 2;")) == 2


def test_line_breaks_in_quotes_anywhere_in_any_file(spark, tmp_path):
    from weftgraph.catalog import GraphCatalog
    from weftgraph.session import Session
    from weftgraph.sources.files import read_csv

    late = "".join(f"{i},x\n" for i in range(600)) + '600,"two\nlines"\n'
    (tmp_path / "a.csv").write_text("".join(f"{i},y\n" for i in range(10)))
    (tmp_path / "b.csv").write_text(late)
    s = Session(spark, GraphCatalog(spark))
    for names, n in ((["b.csv"], 601), (["a.csv", "b.csv"], 611)):
        got = read_csv(s, [str(tmp_path / x) for x in names], {"header": False}, []).collect()
        assert len(got) == n and ("two\nlines" in {r[1] for r in got})


# --- sizes
def test_copied_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """Keys in order take far less in Parquet than in memory: ends are looked up without broadcasting their table."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    s = graph(spark, "CREATE NODE TABLE A(id INT64, PRIMARY KEY(id)); CREATE NODE TABLE B(id INT64, PRIMARY KEY(id)); CREATE REL TABLE R(FROM A TO B)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        s.query("COPY A FROM (UNWIND range(0, 9) AS x RETURN x)")
        s.query("COPY B FROM (UNWIND range(0, 299999) AS x RETURN x)")
        s.query("COPY R FROM (UNWIND range(0, 299999) AS x RETURN x % 10, x)")
        a, b, r = s.catalog.nodes["A"].df, s.catalog.nodes["B"].df, s.catalog.rels["R"].frames["A", "B"]
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert sum(f.stat().st_size for f in map(pathlib.Path, (x.removeprefix("file://") for x in b.inputFiles()))) < 1 << 20
        assert "Broadcast" not in plan(r.join(b, r["_dst"] == b["id"], "left_anti"))
        assert "Broadcast" in plan(r.join(a, r["_src"] == a["id"], "left_anti"))  # a small one still is, also beside a large one
        assert one(s, "MATCH (a:A)-[:R]->(b:B) WHERE b.id > 299997 RETURN count(*) AS n, min(a.id) AS low") == (2, 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    with pytest.raises(QueryError, match="Unable to find primary key value"):
        s.query("COPY R FROM (RETURN 3, 300000)")


def test_pairs_with_two_neighbours_in_common_are_not_made_for_one_alone(spark):
    """300 nodes of one group, each with an item of its own and two with a further one: no join gives all pairs of the group."""
    s = graph(
        spark, "CREATE NODE TABLE G(id INT64, PRIMARY KEY(id)); CREATE NODE TABLE A(id INT64, PRIMARY KEY(id)); CREATE NODE TABLE I(id INT64, PRIMARY KEY(id)); CREATE REL TABLE OF(FROM A TO G, MANY_ONE); CREATE REL TABLE HAS(FROM A TO I)",
        "COPY G FROM (UNWIND [1, 2] AS x RETURN x); COPY A FROM (UNWIND range(0, 299) AS x RETURN x); COPY I FROM (UNWIND range(0, 300) AS x RETURN x)",
        "COPY OF FROM (UNWIND range(0, 299) AS x RETURN x, CASE WHEN x = 299 THEN 2 ELSE 1 END)", "COPY HAS FROM (UNWIND range(0, 299) AS x RETURN x AS s, x AS t UNION ALL UNWIND [7, 9, 299] AS x RETURN x AS s, 300 AS t)",
    )
    match = "MATCH (a:A)-[:OF]->(g:G)<-[:OF]-(b:A), (a)-[:HAS]->(i:I)<-[:HAS]-(b) WHERE a.id < b.id"
    assert values(s.query(f"{match} RETURN g.id AS g, a.id AS a, b.id AS b, i.id AS i")) == [(1, 7, 9, 300)]
    assert one(s, f"{match} RETURN g.id AS g, count(*) AS n") == (1, 1)
    assert one(s, match.replace("(a:A)-[:OF]->(g:G)<-[:OF]-(b:A)", "(a:A)-[x:OF]->(g:G)<-[y:OF]-(b:A)") + " RETURN count(DISTINCT x) AS n, label(y) AS l") == (1, "OF")
    assert one(s, "MATCH (g:G {id: 1})<-[:OF]-(b:A)-[:HAS]->(i:I)<-[:HAS]-(a:A)-[:OF]->(g) WHERE a.id < b.id RETURN a.id AS a, b.id AS b, i.id AS i") == (7, 9, 300)
    profile = s.query(f"PROFILE {match} RETURN a.id AS a, b.id AS b").first()
    assert max(o.rows or 0 for o in profile.operators) < 1000
