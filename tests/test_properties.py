"""Expressions and recursion against plain Python, on generated cases."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.plans import syntax as S
from weftgraph.plans.lexer import QueryError, tokens
from weftgraph.plans.parser import Parser, parse
from weftgraph.session import Session


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_lexer_never_hangs_and_covers_the_text(text):
    try:
        found = tokens(text)
    except QueryError:
        return
    assert all(a.end <= b.at for a, b in itertools.pairwise(found)) and found[-1].kind == "end"


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.integers(0, 9).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})") | x.map(lambda e: f"-{e}"), max_leaves=12))
def test_arithmetic_parses_like_python(text):
    def value(e):
        if isinstance(e, S.Lit):
            return e.value
        args = [value(a) for a in e.args]
        return {"+": lambda: args[0] + args[1], "-": lambda: args[0] - args[1], "*": lambda: args[0] * args[1], "NEGATE": lambda: -args[0]}[e.name]()

    assert value(Parser(text).expr()) == eval(text)  # noqa: S307


@pytest.mark.parametrize("text", ["MATCH", "MATCH (a", "MATCH (a)-[", "RETURN", "RETURN 1 +", "RETURN [1", "UNWIND 1", "MATCH (a)<-[]->(b) RETURN a", "CREATE", "RETURN 'a", "CASE", "CREATE NODE TABLE", "COPY x", "RETURN CASE WHEN 1 END"])
def test_broken_texts_raise(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.fixture(scope="module")
def random_graph(spark):
    r = random.Random(5)
    edges = [(r.randrange(7), r.randrange(7), r.randint(1, 9)) for _ in range(14)]
    from weftgraph.catalog import GraphCatalog

    g = GraphCatalog(spark)
    g.add_nodes("N", spark.range(7).withColumnRenamed("id", "k"), "k")
    g.add_rels("R", spark.createDataFrame([(a, b, w, i) for i, (a, b, w) in enumerate(edges)], "a long, b long, w long, i long"), ("N", "a"), ("N", "b"), ["w"], rid="i")
    return Session(spark, g), edges


def walks(edges, most):
    level = [((a,), ()) for a in range(7)]
    for _ in range(most):
        level = [(nodes + (b,), rels + (i,)) for nodes, rels in level for i, (a, b, _) in enumerate(edges) if a == nodes[-1]]
        yield from level


def count(session, pattern):
    return {(r.a, r.b): r.n for r in session.query(f"MATCH (a:N)-[e:R*{pattern}]->(b:N) RETURN a.k AS a, b.k AS b, count(*) AS n").collect()}


def tally(pairs):
    out = {}
    for p in pairs:
        out[p] = out.get(p, 0) + 1
    return out


def test_walks_trails_and_acyclic_paths(random_graph):
    s, edges = random_graph
    every = list(walks(edges, 3))
    assert count(s, "1..3") == tally((n[0], n[-1]) for n, _ in every)
    assert count(s, "TRAIL 1..3") == tally((n[0], n[-1]) for n, r in every if len(set(r)) == len(r))
    assert count(s, "ACYCLIC 1..3") == tally((n[0], n[-1]) for n, r in every if len(set(n)) == len(n))


def test_shortest_and_cheapest_paths(random_graph):
    s, edges = random_graph
    every = [(n, r) for n, r in walks(edges, 6) if n[0] != n[-1]]
    hops = {}
    for n, r in every:
        hops[n[0], n[-1]] = min(len(r), hops.get((n[0], n[-1]), 99))
    assert count(s, "SHORTEST 1..6") == dict.fromkeys(hops, 1)
    assert count(s, "ALL SHORTEST 1..6") == tally((n[0], n[-1]) for n, r in every if len(r) == hops[n[0], n[-1]])
    cost = {}
    for n, r in every:
        c = sum(edges[i][2] for i in r)
        cost[n[0], n[-1]] = min(c, cost.get((n[0], n[-1]), 999))
    got = {(r.a, r.b): r.c for r in s.query("MATCH (a:N)-[e:R* WSHORTEST(w) 1..6]->(b:N) RETURN a.k AS a, b.k AS b, cost(e) AS c").collect()}
    assert got == cost
    ties = tally((n[0], n[-1]) for n, r in every if sum(edges[i][2] for i in r) == cost[n[0], n[-1]])
    assert count(s, "ALL WSHORTEST(w) 1..6") == ties


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_paths_within_hops(spark, seed):
    """Every bound against all walks: a cheap detour with many hops must not hide a dear path with few."""
    from weftgraph.catalog import GraphCatalog

    r = random.Random(seed)
    edges = [(0, 1, 10), (0, 2, 1), (2, 3, 1), (3, 1, 1), (1, 4, 1)] if seed == 0 else [(r.randrange(7), r.randrange(7), r.choice([1, 2, 3, 20, 50])) for _ in range(12)]
    g = GraphCatalog(spark)
    g.add_nodes("N", spark.range(7).withColumnRenamed("id", "k"), "k")
    g.add_rels("R", spark.createDataFrame([(a, b, w, i) for i, (a, b, w) in enumerate(edges)], "a long, b long, w long, i long"), ("N", "a"), ("N", "b"), ["w"], rid="i")
    s = Session(spark, g)
    for most in (1, 3, 4) if seed else (2, 3, 4):
        every = [(n, rels, sum(edges[i][2] for i in rels)) for n, rels in walks(edges, most) if n[0] != n[-1]]
        cost = {}
        for n, _, c in every:
            cost[n[0], n[-1]] = min(c, cost.get((n[0], n[-1]), 10**9))
        got = s.query(f"MATCH p = (a:N)-[e:R* WSHORTEST(w) 1..{most}]->(b:N) RETURN a.k AS a, b.k AS b, cost(e) AS c, properties(rels(p), 'w') AS ws, properties(nodes(p), 'k') AS ks").collect()
        assert {(x.a, x.b): x.c for x in got} == cost
        assert all(sum(x.ws) == x.c and (x.ks[0], x.ks[-1]) == (x.a, x.b) and all((u, v, w) in edges for u, v, w in zip(x.ks, x.ks[1:], x.ws)) for x in got)
        assert count(s, f"ALL WSHORTEST(w) 1..{most}") == tally((n[0], n[-1]) for n, _, c in every if c == cost[n[0], n[-1]])


def test_relationships_keep_their_identity_over_shuffles(spark):
    from weftgraph.catalog import GraphCatalog

    g = GraphCatalog(spark)
    g.add_nodes("N", spark.range(50).withColumnRenamed("id", "k"), "k")
    pairs = spark.range(2000).selectExpr("id % 50 AS a", "(id * 7) % 50 AS b", "id AS w").repartition(16).dropDuplicates(["w"])
    g.add_rels("R", pairs, ("N", "a"), ("N", "b"), ["w"])
    s = Session(spark, g)
    once, twice = ({r.w: r.i for r in s.query("MATCH (a:N)-[e:R]->(b:N) RETURN e.w AS w, id(e) AS i").collect()} for _ in range(2))
    assert once == twice and len(set(map(str, once.values()))) == 2000
    assert s.query("MATCH (a:N)-[e:R]->(b:N), (a)-[f:R]->(b) WHERE e <> f AND e.w = f.w RETURN count(*) AS n").first().n == 0


def test_rows_that_stand_for_several_walks(random_graph):
    """Counts by weights, over walks written out, in subqueries and beside other patterns, against all walks."""
    s, edges = random_graph
    every = [(n[0], n[-1], len(r)) for n, r in walks(edges, 4)]
    by_length = {(r.n, r.c, r.few, r.ends, r.hi) for r in s.query("MATCH (a:N)-[e:R*1..4]->(b:N) RETURN length(e) AS n, count(*) AS c, count(b) AS few, count(DISTINCT b.k) AS ends, max(b.k) AS hi").collect()}
    want = {n: [b for _, b, m in every if m == n] for n in {m for _, _, m in every}}
    assert by_length == {(n, len(bs), len(bs), len(set(bs)), max(bs)) for n, bs in want.items()}
    out = tally(a for a, _, _ in every)
    rows = s.query("MATCH (a:N) RETURN a.k AS k, COUNT { MATCH (a)-[:R*1..4]->(b:N) } AS n").collect()
    assert {r.k: r.n for r in rows} == {k: out.get(k, 0) for k in range(7)}
    some = s.query("MATCH (a:N) WHERE EXISTS { MATCH (a)-[:R*2..3]->(b:N) } RETURN count(*) AS n").first().n
    assert some == len({a for a, _, m in every if m in (2, 3)})
    degree = tally(a for a, _, _ in edges)
    both = s.query("MATCH (a:N)-[:R*1..2]->(b:N)-[:R]->(c:N) RETURN count(*) AS n").first().n
    assert both == sum(degree.get(b, 0) for _, b, m in every if m <= 2)
    listed = s.query("MATCH (a:N)-[e:R*1..4]->(b:N) RETURN a.k AS a, b.k AS b").collect()
    assert tally((r.a, r.b) for r in listed) == tally((a, b) for a, b, _ in every)


def test_many_walks_are_written_out_in_runs(spark):
    """Two nodes with 10 parallel relationships each way: 10,000 walks of four hops from each."""
    from weftgraph.catalog import GraphCatalog

    g = GraphCatalog(spark)
    g.add_nodes("N", spark.range(2).withColumnRenamed("id", "k"), "k")
    g.add_rels("R", spark.range(20).selectExpr("id % 2 AS a", "1 - id % 2 AS b", "id AS i"), ("N", "a"), ("N", "b"), rid="i")
    s = Session(spark, g)
    rows = s.query("MATCH (a:N)-[e:R*4..4]->(b:N) RETURN a.k AS a, b.k AS b, sum(1) AS n").collect()
    assert sorted((r.a, r.b, int(r.n)) for r in rows) == [(0, 0, 10_000), (1, 1, 10_000)]
    assert s.query("MATCH (a:N)-[e:R*1..9]->(b:N) WHERE a.k = 0 RETURN count(*) AS n").first().n == sum(10**h for h in range(1, 10))


def test_the_search_starts_where_the_condition_fixes_a_key(random_graph):
    s, edges = random_graph
    plan = s.query("EXPLAIN LOGICAL MATCH (a:N)-[e:R]->(b:N) WHERE b.k = 3 RETURN a.k").first()[0]
    got = sorted(r.k for r in s.query("MATCH (a:N)-[e:R]->(b:N) WHERE b.k = 3 RETURN a.k AS k").collect())
    assert got == sorted(a for a, b, _ in edges if b == 3) and "= 3" in plan


def test_profile_counts_the_rows_of_operators(random_graph):
    s, edges = random_graph
    r = s.query("PROFILE MATCH (a:N)-[e:R]->(b:N) WHERE e.w > 3 RETURN a.k, e.w").first()
    assert r.rows == sum(w > 3 for _, _, w in edges)
    assert any(o.rows == r.rows for o in r.operators) and [o.depth for o in r.operators][0] == 0
