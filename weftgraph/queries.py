"""The registered queries of the graph engine, each with SQL that says the same over the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graphs, more_queries
from .statements import projected_session
from .storage import shared_dir
from .streaming.follower import FollowerStore

_TRADES = """
flows AS (
  SELECT c_nationkey, s_nationkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2),
t AS (SELECT c_nationkey AS f, s_nationkey AS d, n, quantity, c_nationkey * 1000 + s_nationkey AS rid FROM flows)"""

_TURNS = """
turn AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role FROM conversations),
nxt AS (SELECT id AS f, lead(id) OVER (PARTITION BY conv_id ORDER BY turn) AS d FROM turn),
e AS (SELECT f, d FROM nxt WHERE d IS NOT NULL)"""



def _rounds(most: int) -> str:
    """Least costs within 0, 1, ... hops."""
    first = "b0 AS (SELECT n_nationkey AS f, n_nationkey AS d, CAST(0 AS DOUBLE) AS c FROM nation)"
    return ", ".join([first, *(f"b{k} AS (SELECT f, d, min(c) AS c FROM (SELECT * FROM b{k - 1} UNION ALL SELECT b.f, t.d, b.c + t.n FROM b{k - 1} b JOIN t ON t.f = b.d) GROUP BY 1, 2)" for k in range(1, most + 1))])


def _levels(most: int) -> str:
    """Pairs by their least number of hops, with the number of ways."""
    first = "l0 AS (SELECT n_nationkey AS f, n_nationkey AS d, 0 AS n, 1 AS c FROM nation)"
    step = "SELECT l.f, t.d, {k} AS n, CAST(sum(l.c) AS BIGINT) AS c FROM l{j} l JOIN t ON t.f = l.d WHERE l.n = {j} AND NOT EXISTS (SELECT 1 FROM l{j} o WHERE o.f = l.f AND o.d = t.d) GROUP BY 1, 2"
    return ", ".join([first, *(f"l{k} AS (SELECT * FROM l{k - 1} UNION ALL {step.format(k=k, j=k - 1)})" for k in range(1, most + 1))])


#: name -> (graph, query, SQL)
TEXTS: dict[str, tuple[Callable, str, str]] = {
    "match_1hop_agg": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment AS seg, count(*) AS n, round(sum(o.o_totalprice), 2) AS s ORDER BY n DESC",
        "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "match_3hop": (
        graphs.commerce,
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_IN]-(c)-[:PLACED]->(o) RETURN r.r_name AS name, round(sum(o.o_totalprice), 2) AS total, count(DISTINCT n) AS nations",
        "SELECT r_name AS name, round(sum(o_totalprice), 2) AS total, count(DISTINCT n_nationkey) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "match_edge_properties": (
        graphs.commerce,
        "MATCH (o:Orders)-[l:CONTAINS]->(p:Part) WHERE l.shipdate <= timestamp('1998-09-02') RETURN l.returnflag AS flag, l.linestatus AS status, round(sum(l.quantity), 2) AS qty, round(sum(l.extendedprice * (1 - l.discount)), 2) AS revenue, round(avg(l.discount), 6) AS disc, count(*) AS n",
        "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "match_inline_properties": (
        graphs.commerce,
        "MATCH (n:Nation {n_nationkey: 7})<-[:CUST_IN]-(c:Customer)-[:PLACED]->(o:Orders {o_orderstatus: 'F'}) RETURN c.c_custkey AS k, count(*) AS n",
        "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderstatus = 'F' GROUP BY 1",
    ),
    "match_point_lookup": (graphs.commerce, "MATCH (p:Part {p_partkey: 42}) RETURN p.*", 'SELECT p_partkey AS "p.p_partkey", p_name AS "p.p_name", p_brand AS "p.p_brand", p_type AS "p.p_type", p_size AS "p.p_size", p_retailprice AS "p.p_retailprice" FROM part WHERE p_partkey = 42'),
    "match_undirected": (
        graphs.trade,
        "MATCH (a:Nation)-[t:TRADES]-(b:Nation) RETURN a.n_name AS name, count(*) AS n, CAST(sum(t.n) AS INT64) AS s",
        f"WITH {_TRADES}, u AS (SELECT f AS a, n FROM t UNION ALL SELECT d, n FROM t) SELECT n_name AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS s FROM u JOIN nation ON n_nationkey = a GROUP BY 1",
    ),
    "match_multilabel": (
        graphs.commerce,
        "MATCH (x:Customer:Supplier)-[:CUST_IN|:SUPP_IN]->(n) RETURN label(x) AS lab, n.n_name AS name, count(*) AS n",
        "SELECT 'Customer' AS lab, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2 UNION ALL SELECT 'Supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 2",
    ),
    "match_label_inference": (
        graphs.commerce,
        "MATCH (a)-[e]->(n:Nation) RETURN label(a) AS a, label(e) AS e, count(*) AS n",
        "SELECT 'Customer' AS a, 'CUST_IN' AS e, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', 'SUPP_IN', count(*) FROM supplier",
    ),
    "match_triangle": (
        graphs.trade,
        "MATCH (a)-[:TRADES]->(b)-[:TRADES]->(c)-[:TRADES]->(a) RETURN count(*) AS n",
        f"WITH {_TRADES} SELECT count(*) AS n FROM t x JOIN t y ON x.d = y.f JOIN t z ON y.d = z.f AND z.d = x.f",
    ),
    "match_repeated_variable": (
        graphs.trade,
        "MATCH (a)-[t:TRADES]->(a) RETURN a.n_nationkey AS k, t.n AS n",
        f"WITH {_TRADES} SELECT f AS k, n FROM t WHERE f = d",
    ),
    "match_homomorphism": (
        graphs.trade,
        "MATCH (a)-[:TRADES]->(b), (a)-[:TRADES]->(c) RETURN a.n_nationkey AS k, count(*) AS n",
        f"WITH {_TRADES} SELECT x.f AS k, count(*) AS n FROM t x JOIN t y ON x.f = y.f GROUP BY 1",
    ),
    "match_star_counts": (
        graphs.commerce,
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(s2:Supplier) WHERE s.s_suppkey < s2.s_suppkey RETURN count(*) AS pairs, count(DISTINCT p) AS parts",
        "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT count(*) AS pairs, count(DISTINCT a.p) AS parts FROM x a JOIN x b ON a.p = b.p AND a.s < b.s",
    ),
    "cross_product_theta": (
        graphs.commerce,
        "MATCH (s:Supplier), (c:Customer) WHERE s.s_acctbal > c.c_acctbal + 9000 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM supplier, customer WHERE s_acctbal > c_acctbal + 9000",
    ),
    "optional_match": (
        graphs.commerce,
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.o_orderstatus = 'F' AND o.o_totalprice > 200000 RETURN c.c_custkey AS k, count(o) AS n",
        "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1",
    ),
    "optional_match_correlated": (
        graphs.commerce,
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 40 RETURN c.c_mktsegment AS seg, count(o) AS n, count(*) AS m",
        "SELECT c_mktsegment AS seg, count(o_orderkey) AS n, count(*) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40 GROUP BY 1",
    ),
    "exists_sub": (
        graphs.commerce,
        "MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 400000 } RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    ),
    "not_exists_sub": (
        graphs.commerce,
        "MATCH (p:Part) WHERE NOT (p)<-[:CONTAINS]-(:Orders) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    ),
    "exists_mark": (
        graphs.commerce,
        "MATCH (c:Customer) RETURN c.c_custkey AS k, EXISTS { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > c.c_acctbal * 45 } AS big",
        "SELECT c_custkey AS k, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 45) AS big FROM customer",
    ),
    "count_sub": (
        graphs.commerce,
        "MATCH (c:Customer) WHERE COUNT { MATCH (c)-[:PLACED]->(:Orders) } > 12 RETURN c.c_custkey AS k, COUNT { MATCH (c)-[:PLACED]->(o:Orders) WHERE o.o_orderstatus = 'O' } AS n",
        "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 12",
    ),
    "with_topk": (
        graphs.commerce,
        "MATCH (n:Nation)<-[:CUST_IN]-(c) WITH n, sum(c.c_acctbal) AS s ORDER BY s DESC LIMIT 5 MATCH (n)<-[:SUPP_IN]-(s2) RETURN n.n_name AS name, round(s, 2) AS s, count(*) AS n",
        "WITH x AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer GROUP BY 1 ORDER BY 2 DESC LIMIT 5) SELECT n_name AS name, round(s, 2) AS s, count(*) AS n FROM x JOIN nation ON n_nationkey = k JOIN supplier ON s_nationkey = k GROUP BY 1, 2",
    ),
    "with_where": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, count(*) AS n, max(o.o_totalprice) AS m WHERE n > 12 AND c.c_acctbal > 0 RETURN c.c_name AS name, n, m",
        "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS m FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey, c_name HAVING count(*) > 12",
    ),
    "order_nulls_asc": (
        graphs.commerce,
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, nullif(n.n_regionkey, 2) AS x ORDER BY x, k SKIP 3 LIMIT 20",
        "SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS x FROM nation ORDER BY x ASC NULLS LAST, k OFFSET 3 LIMIT 20",
    ),
    "order_nulls_desc": (
        graphs.commerce,
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, nullif(n.n_regionkey, 2) AS x ORDER BY x DESC, k SKIP 2 LIMIT 9",
        "SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS x FROM nation ORDER BY x DESC NULLS FIRST, k OFFSET 2 LIMIT 9",
    ),
    "distinct_projection": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN DISTINCT c.c_mktsegment AS seg, o.o_orderpriority AS pri",
        "SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS pri FROM customer JOIN orders ON o_custkey = c_custkey",
    ),
    "union_distinct": (
        graphs.commerce,
        "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "union_all": (
        graphs.commerce,
        "MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) WHERE s.s_acctbal < 0 RETURN s.s_nationkey AS k",
        "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    ),
    "unwind_collect": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_mktsegment AS s, collect(c.c_custkey) AS l UNWIND l AS k RETURN s, count(k) AS n, CAST(sum(k) AS INT64) AS t",
        "SELECT c_mktsegment AS s, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS t FROM customer GROUP BY 1",
    ),
    "unwind_range": (graphs.commerce, "UNWIND range(1, 10) AS x WITH x WHERE x % 3 = 1 RETURN x, x * x AS y", "SELECT x, x * x AS y FROM (SELECT unnest(range(1, 11)) AS x) WHERE x % 3 = 1"),
    "agg_distinct": (
        graphs.commerce,
        "MATCH (o:Orders) RETURN o.o_orderstatus AS st, count(DISTINCT o.o_custkey) AS c, CAST(sum(DISTINCT o.o_custkey) AS INT64) AS s, round(avg(o.o_totalprice), 4) AS a, min(o.o_orderdate) AS lo, max(o.o_orderdate) AS hi",
        "SELECT o_orderstatus AS st, count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1",
    ),
    "agg_expressions": (
        graphs.commerce,
        "MATCH (c:Customer) RETURN c.c_nationkey AS k, round(sum(c.c_acctbal) / count(*), 4) AS mean, max(c.c_acctbal) - min(c.c_acctbal) AS span, CAST(sum(count_if(c.c_acctbal < 0)) AS INT64) AS neg",
        "SELECT c_nationkey AS k, round(sum(c_acctbal) / count(*), 4) AS mean, max(c_acctbal) - min(c_acctbal) AS span, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM customer GROUP BY 1",
    ),
    "agg_empty": (graphs.commerce, "MATCH (c:Customer) WHERE c.c_custkey < 0 RETURN count(*) AS n, sum(c.c_acctbal) AS s, max(c.c_name) AS m", "SELECT count(*) AS n, sum(c_acctbal) AS s, max(c_name) AS m FROM customer WHERE c_custkey < 0"),
    "three_valued_logic": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, nullif(n.n_regionkey, 1) AS x RETURN k, x > 2 AND k > 5 AS a, x > 2 OR k > 5 AS o, x > 2 XOR k > 5 AS e, NOT x > 2 AS m, x IS NULL AS z, k IN [1, 2, 3] AS i",
        "WITH t AS (SELECT n_nationkey AS k, nullif(n_regionkey, 1) AS x FROM nation) SELECT k, x > 2 AND k > 5 AS a, x > 2 OR k > 5 AS o, (x > 2) <> (k > 5) AS e, NOT x > 2 AS m, x IS NULL AS z, k IN (1, 2, 3) AS i FROM t",
    ),
    "case_forms": (
        graphs.commerce,
        "MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size < 10 THEN 'small' WHEN p.p_size < 30 THEN 'mid' ELSE 'big' END AS s, CASE p.p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS w",
        "SELECT p_partkey AS k, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS s, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS w FROM part",
    ),
    "string_predicates": (
        graphs.commerce,
        "MATCH (p:Part) WHERE p.p_name CONTAINS 'i' AND (p.p_name STARTS WITH 'r' OR p.p_name ENDS WITH 'ring') RETURN p.p_partkey AS k, p.p_name =~ '.*[a-m]' AS r",
        "SELECT p_partkey AS k, regexp_full_match(p_name, '.*[a-m]') AS r FROM part WHERE contains(p_name, 'i') AND (starts_with(p_name, 'r') OR ends_with(p_name, 'ring'))",
    ),
    "quantifiers": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, range(0, n.n_nationkey % 5) AS l RETURN k, any(x IN l WHERE x > 3) AS a, all(x IN l WHERE x < 4) AS b, none(x IN l WHERE x = 2) AS c, single(x IN l WHERE x = 1) AS d",
        "SELECT n_nationkey AS k, n_nationkey % 5 > 3 AS a, n_nationkey % 5 < 4 AS b, n_nationkey % 5 < 2 AS c, n_nationkey % 5 >= 1 AS d FROM nation",
    ),
    "lambda_list": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, range(1, n.n_nationkey % 4 + 1) AS l RETURN k, list_to_string('-', list_transform(l, x -> x * k)) AS t, size(list_filter(l, x -> x % 2 = 0)) AS f, CAST(list_reduce(l, (a, b) -> a + b) AS INT64) AS r",
        "WITH t AS (SELECT n_nationkey AS k, range(1, n_nationkey % 4 + 2) AS l FROM nation) SELECT k, array_to_string([x * k FOR x IN l], '-') AS t, len([x FOR x IN l IF x % 2 = 0]) AS f, CAST(list_sum(l) AS BIGINT) AS r FROM t",
    ),
    "fn_math": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, CAST(n.n_nationkey AS DOUBLE) / 4 AS x RETURN k, k / 4 AS d, -k / 4 AS nd, k % 7 AS m, -k % 7 AS nm, round(k ^ 2, 3) AS p, abs(-k) AS a, ceil(x) AS c, floor(x) AS f, round(x, 1) AS r, sign(k - 5) AS s, round(sqrt(x), 9) AS q, round(log(x + 1), 9) AS l10, round(ln(x + 1), 9) AS l, round(log2(x + 1), 9) AS l2, round(cbrt(x), 9) AS cb, round(sin(x) + cos(x), 9) AS sc, round(atan2(x, 2.0), 9) AS at, even(x) AS e, bitwise_and(k, 6) AS ba, bitwise_or(k, 6) AS bo, bitwise_xor(k, 6) AS bx, bitshift_left(k, 2) AS sl, bitshift_right(k, 1) AS sr, round(degrees(x), 6) AS dg, round(radians(x), 9) AS rd, factorial(k % 10) AS fa, round(gamma(x + 1), 6) AS g, round(lgamma(x + 1), 6) AS lg",
        "WITH t AS (SELECT n_nationkey AS k, n_nationkey / 4.0::DOUBLE AS x FROM nation) SELECT k, k // 4 AS d, (-k) // 4 AS nd, k % 7 AS m, (-k) % 7 AS nm, round(pow(k, 2), 3) AS p, abs(-k) AS a, ceil(x) AS c, floor(x) AS f, round(x, 1) AS r, CAST(sign(k - 5) AS BIGINT) AS s, round(sqrt(x), 9) AS q, round(log10(x + 1), 9) AS l10, round(ln(x + 1), 9) AS l, round(log2(x + 1), 9) AS l2, round(cbrt(x), 9) AS cb, round(sin(x) + cos(x), 9) AS sc, round(atan2(x, 2.0), 9) AS at, even(x) AS e, CAST(k & 6 AS BIGINT) AS ba, CAST(k | 6 AS BIGINT) AS bo, CAST(xor(k, 6) AS BIGINT) AS bx, CAST(k << 2 AS BIGINT) AS sl, CAST(k >> 1 AS BIGINT) AS sr, round(degrees(x), 6) AS dg, round(radians(x), 9) AS rd, CAST(factorial(k % 10) AS BIGINT) AS fa, round(gamma(x + 1), 6) AS g, round(lgamma(x + 1), 6) AS lg FROM t",
    ),
    "fn_string": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_name AS s, c.c_mktsegment AS g RETURN k, lower(s) AS lo, upper(g) AS up, left(s, 3) AS l, left(s, -3) AS ln, right(s, 4) AS r, right(s, -4) AS rn, substr(s, 2, 5) AS su, lpad(g, 12, '*') AS lp, rpad(g, 12, '.') AS rp, reverse(g) AS re, repeat('ab', 2) AS rr, trim('  x ') AS t, initcap(g) AS ic, concat(g, '-', s) AS cc, g + '/' + s AS pl, string_split(s, '#')[1] AS sp, split_part(s, '#', 2) AS s2, split_part(s, '#', 9) AS s9, levenshtein(g, 'BUILDING') AS le, size(s) AS z, contains(s, '1') AS co, starts_with(s, 'C') AS st, s[2] AS ch, s[2:4] AS sl, concat_ws('+', g, 'z') AS cw",
        "WITH t AS (SELECT c_custkey AS k, c_name AS s, c_mktsegment AS g FROM customer) SELECT k, lower(s) AS lo, upper(g) AS up, left(s, 3) AS l, left(s, -3) AS ln, right(s, 4) AS r, right(s, -4) AS rn, substr(s, 2, 5) AS su, lpad(g, 12, '*') AS lp, rpad(g, 12, '.') AS rp, reverse(g) AS re, 'abab' AS rr, 'x' AS t, upper(g[1]) || lower(g[2:]) AS ic, g || '-' || s AS cc, g || '/' || s AS pl, string_split(s, '#')[1] AS sp, split_part(s, '#', 2) AS s2, '' AS s9, levenshtein(g, 'BUILDING') AS le, length(s) AS z, contains(s, '1') AS co, starts_with(s, 'C') AS st, s[2] AS ch, s[2:4] AS sl, concat_ws('+', g, 'z') AS cw FROM t",
    ),
    "fn_regex": (
        graphs.commerce,
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_type AS s RETURN k, regexp_matches(s, '[AEIOU]{2}') AS m, regexp_full_match(s, '[A-Z ]+') AS f, regexp_replace(s, '[AEIOU]', '_') AS r1, regexp_replace(s, '[AEIOU]', '_', 'g') AS rg, regexp_extract(s, '([A-Z])([A-Z])', 2) AS e, regexp_extract(s, '[0-9]+') AS e0, list_to_string(',', regexp_extract_all(s, '[AEIOU]')) AS ea, list_to_string('|', regexp_split_to_array(s, ' ')) AS sp",
        "WITH t AS (SELECT p_partkey AS k, p_type AS s FROM part) SELECT k, regexp_matches(s, '[AEIOU]{2}') AS m, regexp_full_match(s, '[A-Z ]+') AS f, regexp_replace(s, '[AEIOU]', '_') AS r1, regexp_replace(s, '[AEIOU]', '_', 'g') AS rg, regexp_extract(s, '([A-Z])([A-Z])', 2) AS e, regexp_extract(s, '[0-9]+') AS e0, array_to_string(regexp_extract_all(s, '[AEIOU]'), ',') AS ea, array_to_string(regexp_split_to_array(s, ' '), '|') AS sp FROM t",
    ),
    "fn_list": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, [3, 1, n.n_nationkey % 4, 2, 1] AS l RETURN k, size(l) AS z, l[3] AS e, l[-1] AS last, list_to_string(',', l[2:3]) AS sl, list_to_string(',', list_sort(l)) AS so, list_to_string(',', list_reverse_sort(l)) AS rs, list_to_string(',', list_sort(list_distinct(l))) AS di, list_unique(l) AS un, list_position(l, 2) AS po, list_contains(l, 0) AS co, list_to_string(',', list_append(l, 9)) AS ap, list_to_string(',', list_prepend(l, 9)) AS pr, list_to_string(',', list_concat(l, [7])) AS cc, list_to_string(',', list_reverse(l)) AS re, CAST(list_sum(l) AS INT64) AS su, CAST(list_product(l) AS INT64) AS pd, list_has_all(l, [1, 2]) AS ha, list_any_value(l) AS av, list_to_string(',', range(5, 1, -2)) AS rg, size(range(5, 1)) AS rw",
        "WITH t AS (SELECT n_nationkey AS k, [3, 1, n_nationkey % 4, 2, 1]::BIGINT[] AS l FROM nation) SELECT k, len(l) AS z, l[3] AS e, l[-1] AS last, array_to_string(l[2:3], ',') AS sl, array_to_string(list_sort(l), ',') AS so, array_to_string(list_reverse_sort(l), ',') AS rs, array_to_string(list_sort(list_distinct(l)), ',') AS di, list_unique(l) AS un, CAST(list_position(l, 2) AS BIGINT) AS po, list_contains(l, 0) AS co, array_to_string(list_append(l, 9), ',') AS ap, array_to_string(list_prepend(9, l), ',') AS pr, array_to_string(list_concat(l, [7]), ',') AS cc, array_to_string(list_reverse(l), ',') AS re, CAST(list_sum(l) AS BIGINT) AS su, CAST(list_product(l) AS BIGINT) AS pd, list_has_all(l, [1, 2]) AS ha, list_any_value(l) AS av, '5,3,1' AS rg, 0 AS rw FROM t",
    ),
    "fn_date": (
        graphs.commerce,
        "MATCH (o:Orders) WITH o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_orderdate AS t RETURN k, date_part('year', d) AS y, date_part('month', d) AS m, date_part('day', d) AS dd, date_part('quarter', d) AS q, date_part('week', d) AS w, date_part('dow', d) AS dow, date_part('doy', d) AS doy, date_part('decade', d) AS de, date_part('century', d) AS ce, date_part('hour', t) AS h, date_trunc('month', d) AS tm, date_trunc('year', d) AS ty, CAST(date_trunc('decade', d) AS DATE) AS td, dayname(d) AS dn, monthname(d) AS mn, last_day(d) AS ld, d + 10 AS pl, d - 3 AS mi, d - date('1995-01-01') AS df, greatest(d, date('1995-06-01')) AS g, least(d, date('1995-06-01')) AS l, make_date(2020, date_part('month', d), 1) AS md",
        "WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t FROM orders) SELECT k, year(d) AS y, month(d) AS m, day(d) AS dd, quarter(d) AS q, week(d) AS w, dayofweek(d) AS dow, dayofyear(d) AS doy, date_part('decade', d) AS de, date_part('century', d) AS ce, hour(t) AS h, CAST(date_trunc('month', d) AS DATE) AS tm, CAST(date_trunc('year', d) AS DATE) AS ty, CAST(date_trunc('decade', d) AS DATE) AS td, dayname(d) AS dn, monthname(d) AS mn, last_day(d) AS ld, CAST(d + 10 AS DATE) AS pl, CAST(d - 3 AS DATE) AS mi, d - DATE '1995-01-01' AS df, greatest(d, DATE '1995-06-01') AS g, least(d, DATE '1995-06-01') AS l, make_date(2020, month(d), 1) AS md FROM x",
    ),
    "fn_interval": (
        graphs.commerce,
        "MATCH (o:Orders) WITH o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_orderdate AS t RETURN k, d + interval('1 month') AS a, d - interval('2 years 3 days') AS b, t + to_hours(5) AS c, t - to_minutes(90) AS e, d + to_months(k % 12) AS f, date_part('day', t - timestamp('1992-01-01 00:00:00')) AS g, interval('1 month') > interval('29 days') AS h, to_days(40) > interval('1 month') AS i, t + interval('1 day 02:30:00') AS j",
        "WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t FROM orders) SELECT k, CAST(d + INTERVAL 1 MONTH AS DATE) AS a, CAST(d - INTERVAL 2 YEAR - INTERVAL 3 DAY AS DATE) AS b, t + INTERVAL 5 HOUR AS c, t - INTERVAL 90 MINUTE AS e, CAST(d + to_months(CAST(k % 12 AS INTEGER)) AS DATE) AS f, date_part('day', t - TIMESTAMP '1992-01-01 00:00:00') AS g, true AS h, true AS i, t + INTERVAL 1 DAY + INTERVAL 150 MINUTE AS j FROM x",
    ),
    "fn_struct_map": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, {a: n.n_nationkey, b: n.n_name} AS s, map([1, 2], [n.n_name, 'z']) AS m RETURN k, s.a AS a, struct_extract(s, 'b') AS b, map_extract(m, 1)[1] AS e, size(map_extract(m, 7)) AS z, list_to_string(',', map_keys(m)) AS mk, list_to_string(',', map_values(m)) AS mv, union_tag(union_value(q := k)) AS t, union_extract(union_value(q := k), 'q') AS x, coalesce(nullif(k, 3), -1) AS c, ifnull(nullif(k, 4), -2) AS i, constant_or_null(1, nullif(k, 5)) AS cn",
        "SELECT n_nationkey AS k, n_nationkey AS a, n_name AS b, n_name AS e, 0 AS z, '1,2' AS mk, n_name || ',z' AS mv, 'q' AS t, n_nationkey AS x, coalesce(nullif(n_nationkey, 3), -1) AS c, coalesce(nullif(n_nationkey, 4), -2) AS i, CASE WHEN n_nationkey <> 5 THEN 1 END AS cn FROM nation",
    ),
    "fn_cast": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS x RETURN k, CAST(x AS INT64) AS i, CAST(k AS DOUBLE) AS d, CAST(k AS STRING) AS s, CAST(CAST(x AS DECIMAL(12, 1)) AS DOUBLE) AS de, to_bool('true') AS b, to_string(k > 3) AS ts, CAST('2020-02-03' AS DATE) AS dt, to_int32(x / 100) AS i32, to_float(1.5) AS f, to_string([k, 1]) AS l",
        "SELECT c_custkey AS k, CAST(round_even(c_acctbal, 0) AS BIGINT) AS i, CAST(c_custkey AS DOUBLE) AS d, CAST(c_custkey AS VARCHAR) AS s, CAST(CAST(c_acctbal AS DECIMAL(12, 1)) AS DOUBLE) AS de, true AS b, CASE WHEN c_custkey > 3 THEN 'True' ELSE 'False' END AS ts, DATE '2020-02-03' AS dt, CAST(round_even(c_acctbal / 100, 0) AS INTEGER) AS i32, CAST(1.5 AS FLOAT) AS f, '[' || c_custkey || ',1]' AS l FROM customer",
    ),
    "fn_hash": (
        graphs.commerce,
        "MATCH (c:Customer) RETURN c.c_custkey AS k, md5(c.c_name) AS m, sha256(c.c_name) AS s, octet_length(encode(c.c_name)) AS o, decode(encode(c.c_name)) AS d",
        "SELECT c_custkey AS k, md5(c_name) AS m, sha256(c_name) AS s, strlen(c_name) AS o, c_name AS d FROM customer",
    ),
    "fn_array_vec": (
        graphs.activity,
        "MATCH (a:Vec {vec_id: 0}), (b:Vec) RETURN b.vec_id AS k, round(array_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d, round(array_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS p, round(array_squared_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS q, round(array_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS c",
        "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT b.vec_id AS k, round(list_distance(a.v, b.v), 6) AS d, round(list_inner_product(a.v, b.v), 6) AS p, round(list_distance(a.v, b.v) ^ 2, 5) AS q, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM x a, x b WHERE a.vec_id = 0",
    ),
    "parameters_and_macros": (
        graphs.commerce,
        "CREATE MACRO discounted(price, share := 0.1) AS price * (1 - share); MATCH (p:Part) WHERE p.p_size > 40 RETURN p.p_partkey AS k, round(discounted(p.p_retailprice), 4) AS d, round(discounted(p.p_retailprice, share := 0.5), 4) AS h",
        "SELECT p_partkey AS k, round(p_retailprice * (1 - 0.1::DOUBLE), 4) AS d, round(p_retailprice * 0.5::DOUBLE, 4) AS h FROM part WHERE p_size > 40",
    ),
    "rec_walk_1_3": (
        graphs.talk,
        "MATCH (a:Turn)-[e:NEXT_TURN*1..3]->(b:Turn) RETURN a.role AS ra, b.role AS rb, length(e) AS n, count(*) AS c",
        f"WITH {_TURNS}, w AS (SELECT f, d, 1 AS n FROM e UNION ALL SELECT x.f, y.d, 2 FROM e x JOIN e y ON x.d = y.f UNION ALL SELECT x.f, z.d, 3 FROM e x JOIN e y ON x.d = y.f JOIN e z ON y.d = z.f) SELECT a.role AS ra, b.role AS rb, n, count(*) AS c FROM w JOIN turn a ON a.id = f JOIN turn b ON b.id = d GROUP BY 1, 2, 3",
    ),
    "rec_walk_dense": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES*1..4]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, count(*) AS n",
        f"WITH {_TRADES}, w AS (SELECT f, d FROM t UNION ALL SELECT x.f, y.d FROM t x JOIN t y ON x.d = y.f UNION ALL SELECT x.f, z.d FROM t x JOIN t y ON x.d = y.f JOIN t z ON y.d = z.f UNION ALL SELECT x.f, v.d FROM t x JOIN t y ON x.d = y.f JOIN t z ON y.d = z.f JOIN t v ON z.d = v.f) SELECT f AS a, d AS b, count(*) AS n FROM w GROUP BY 1, 2",
    ),
    "rec_path_values": (
        graphs.talk,
        "MATCH p = (a:Turn)-[e:NEXT_TURN*2..2]->(b:Turn) WHERE a.turn = 0 RETURN a.id AS k, length(p) AS n, size(nodes(p)) AS ns, size(nodes(e)) AS inner, size(rels(p)) AS rs, list_to_string(',', properties(nodes(p), 'turn')) AS ts, is_trail(p) AS tr, is_acyclic(p) AS ac",
        f"WITH {_TURNS} SELECT a.id AS k, 2 AS n, 3 AS ns, 1 AS inner, 2 AS rs, '0,1,2' AS ts, true AS tr, true AS ac FROM turn a JOIN e x ON x.f = a.id JOIN e y ON y.f = x.d WHERE a.turn = 0",
    ),
    "rec_trail": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES*TRAIL 1..3]->(b:Nation) RETURN a.n_nationkey AS a, length(e) AS n, count(*) AS c",
        f"WITH RECURSIVE {_TRADES}, w AS (SELECT f, d, [rid] AS seen, 1 AS n FROM t UNION ALL SELECT w.f, t.d, list_append(w.seen, t.rid), w.n + 1 FROM w JOIN t ON t.f = w.d WHERE w.n < 3 AND NOT list_contains(w.seen, t.rid)) SELECT f AS a, n, count(*) AS c FROM w GROUP BY 1, 2",
    ),
    "rec_acyclic": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES*ACYCLIC 1..3]->(b:Nation) RETURN a.n_nationkey AS a, length(e) AS n, count(*) AS c",
        f"WITH RECURSIVE {_TRADES}, w AS (SELECT f, d, [f, d] AS seen, 1 AS n FROM t WHERE f <> d UNION ALL SELECT w.f, t.d, list_append(w.seen, t.d), w.n + 1 FROM w JOIN t ON t.f = w.d WHERE w.n < 3 AND NOT list_contains(w.seen, t.d)) SELECT f AS a, n, count(*) AS c FROM w GROUP BY 1, 2",
    ),
    "rec_predicates": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES*1..3 (r, n | WHERE n.n_nationkey > 5 AND r.n > 20)]->(b:Nation) RETURN a.n_nationkey AS a, count(*) AS c",
        f"WITH {_TRADES}, g AS (SELECT * FROM t WHERE n > 20), w AS (SELECT f FROM g UNION ALL SELECT x.f FROM g x JOIN g y ON x.d = y.f WHERE x.d > 5 UNION ALL SELECT x.f FROM g x JOIN g y ON x.d = y.f JOIN g z ON y.d = z.f WHERE x.d > 5 AND y.d > 5) SELECT f AS a, count(*) AS c FROM w GROUP BY 1",
    ),
    "rec_shortest": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES* SHORTEST 1..8]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(e) AS n",
        f"WITH RECURSIVE {_TRADES}, w AS (SELECT DISTINCT f, d, 1 AS n FROM t UNION SELECT w.f, t.d, w.n + 1 FROM w JOIN t ON t.f = w.d WHERE w.n < 8) SELECT f AS a, d AS b, min(n) AS n FROM w WHERE f <> d GROUP BY 1, 2",
    ),
    "rec_all_shortest": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES* ALL SHORTEST 1..8]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(e) AS n, count(*) AS c",
        f"WITH {_TRADES}, {_levels(8)} SELECT f AS a, d AS b, n, c FROM l8 WHERE f <> d AND n > 0",
    ),
    "rec_wshortest": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES* WSHORTEST(n) 1..8]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, cost(e) AS c",
        f"WITH {_TRADES}, {_rounds(8)} SELECT f AS a, d AS b, c FROM b8 WHERE f <> d",
    ),
    "rec_wshortest_bounded": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES* WSHORTEST(n) 1..2]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, cost(e) AS c",
        f"WITH {_TRADES}, {_rounds(2)} SELECT f AS a, d AS b, c FROM b2 WHERE f <> d",
    ),
    "rec_all_wshortest_bounded": (
        graphs.trade,
        "MATCH (a:Nation)-[e:TRADES* ALL WSHORTEST(n) 1..3]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, cost(e) AS c, length(e) AS n, count(*) AS m",
        f"WITH {_TRADES}, w AS (SELECT f, d, CAST(n AS DOUBLE) AS c, 1 AS n FROM t UNION ALL SELECT x.f, y.d, x.n + y.n, 2 FROM t x JOIN t y ON x.d = y.f UNION ALL SELECT x.f, z.d, x.n + y.n + z.n, 3 FROM t x JOIN t y ON x.d = y.f JOIN t z ON y.d = z.f), r AS (SELECT *, min(c) OVER (PARTITION BY f, d) AS least FROM w WHERE f <> d) SELECT f AS a, d AS b, c, n, count(*) AS m FROM r WHERE c = least GROUP BY 1, 2, 3, 4",
    ),
    "call_show_tables": (graphs.trade, "CALL show_tables() RETURN name, type", "SELECT 'Nation' AS name, 'NODE' AS type UNION ALL SELECT 'TRADES', 'REL'"),
    "call_table_info": (graphs.commerce, "CALL table_info('Region') RETURN name, type, `primary key` AS pk", "SELECT 'r_regionkey' AS name, 'INT32' AS type, true AS pk UNION ALL SELECT 'r_name', 'STRING', false"),
    "merge_create": (
        graphs.commerce,
        "CREATE NODE TABLE Tag(id INT64, n INT64 DEFAULT 0, PRIMARY KEY(id)); MATCH (c:Customer) MERGE (t:Tag {id: c.c_custkey % 7}) ON CREATE SET t.n = 1; MATCH (t:Tag) RETURN t.id AS id, t.n AS n",
        "SELECT DISTINCT c_custkey % 7 AS id, 1 AS n FROM customer",
    ),
    "set_delete": (
        graphs.commerce,
        "MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n.n_name = lower(n.n_name); MATCH (n:Nation) WHERE n.n_regionkey = 3 DETACH DELETE n; MATCH (n:Nation) OPTIONAL MATCH (n)<-[:CUST_IN]-(c) RETURN n.n_nationkey AS k, n.n_name AS name, count(c) AS c",
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 3 GROUP BY 1, 2",
    ),
    "create_paths": (
        graphs.commerce,
        "CREATE REL TABLE NEAR(FROM Nation TO Nation, w INT64); MATCH (a:Nation), (b:Nation) WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey CREATE (a)-[:NEAR {w: b.n_nationkey - a.n_nationkey}]->(b); MATCH (a)-[x:NEAR]->(b) RETURN a.n_nationkey AS a, b.n_nationkey AS b, x.w AS w",
        "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(b.n_nationkey - a.n_nationkey AS BIGINT) AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "alter_table": (
        graphs.commerce,
        "ALTER TABLE Region ADD score INT64 DEFAULT 7; ALTER TABLE Region RENAME r_name TO title; MATCH (r:Region) RETURN r.r_regionkey AS k, r.title AS title, r.score AS score",
        "SELECT r_regionkey AS k, r_name AS title, 7 AS score FROM region",
    ),
    "transaction_rollback": (
        graphs.commerce,
        "BEGIN TRANSACTION; MATCH (r:Region) WHERE r.r_regionkey > 0 DETACH DELETE r; ROLLBACK; MATCH (r:Region)<-[:IN_REGION]-(n) RETURN r.r_name AS name, count(*) AS n",
        "SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
}


TEXTS |= {
    "join_hint": (
        graphs.commerce,
        "MATCH (s:Supplier)-[e:SUPP_IN]->(n:Nation)<-[f:CUST_IN]-(c:Customer) HINT ((n JOIN e) JOIN s) JOIN (f JOIN c) RETURN n.n_nationkey AS k, count(*) AS n",
        "SELECT n_nationkey AS k, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "rec_undirected": (
        graphs.talk,
        "MATCH (a:Turn {turn: 1})-[e:NEXT_TURN*TRAIL 1..2]-(b:Turn) RETURN a.id AS k, count(*) AS n",
        f"WITH {_TURNS}, u AS (SELECT f, d, f AS r FROM e UNION ALL SELECT d, f, f FROM e), w AS (SELECT f FROM u UNION ALL SELECT x.f FROM u x JOIN u y ON x.d = y.f AND x.r <> y.r) SELECT f AS k, count(*) AS n FROM w JOIN turn ON id = f AND turn = 1 GROUP BY 1",
    ),
    "rec_all_wshortest": (
        graphs.activity,
        "MATCH (a:Event)-[e:NEXT_EVENT* ALL WSHORTEST(gap_s) 1..3]->(b:Event) RETURN a.event_id AS a, b.event_id AS b, cost(e) AS c, length(e) AS n",
        "WITH x AS (SELECT event_id AS f, user_id, lead(event_id) OVER w AS d, epoch_us(date_trunc('second', lead(ts) OVER w)) // 1000000 - epoch_us(date_trunc('second', ts)) // 1000000 AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), e AS (SELECT * FROM x WHERE d IS NOT NULL), w AS (SELECT f, d, g AS c, 1 AS n FROM e UNION ALL SELECT a.f, b.d, a.g + b.g, 2 FROM e a JOIN e b ON a.d = b.f UNION ALL SELECT a.f, c.d, a.g + b.g + c.g, 3 FROM e a JOIN e b ON a.d = b.f JOIN e c ON b.d = c.f) SELECT f AS a, d AS b, CAST(c AS DOUBLE) AS c, n FROM w",
    ),
    "rec_zero_length": (
        graphs.talk,
        "MATCH (a:Turn)-[e:NEXT_TURN*0..2]->(b:Turn) RETURN length(e) AS n, count(*) AS c",
        f"WITH {_TURNS} SELECT 0 AS n, count(*) AS c FROM turn UNION ALL SELECT 1, count(*) FROM e UNION ALL SELECT 2, count(*) FROM e x JOIN e y ON x.d = y.f",
    ),
    "union_over_patterns": (
        graphs.commerce,
        "MATCH (o:Orders)-[:SHIPPED_BY]->(s:Supplier) RETURN s.s_suppkey AS k, count(DISTINCT o) AS n UNION ALL MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.s_suppkey AS k, count(*) AS n",
        "SELECT l_suppkey AS k, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, count(DISTINCT l_partkey) FROM lineitem GROUP BY 1",
    ),
    "dependent_group_keys": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) WITH c, sum(o.o_totalprice) AS s RETURN c.c_name AS name, c.c_acctbal AS b, round(s, 2) AS s ORDER BY s DESC LIMIT 20",
        "SELECT c_name AS name, c_acctbal AS b, round(sum(o_totalprice), 2) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_acctbal ORDER BY sum(o_totalprice) DESC LIMIT 20",
    ),
    "nested_values": (
        graphs.commerce,
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect({k: n.n_nationkey, name: n.n_name}) AS l RETURN r.r_name AS name, size(l) AS z, list_to_string(',', list_sort(list_transform(l, x -> x.k))) AS ks",
        "SELECT r_name AS name, count(*) AS z, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS ks FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads a file by LOAD FROM, copies it into a node table, writes and reads it as CSV."""
    s = graphs.Session(spark)
    out = f"{shared_dir(spark)}/copied-{uuid.uuid4().hex}.csv"
    s.query("CREATE NODE TABLE Cust(id INT64, name STRING, bal DOUBLE, PRIMARY KEY(id))")
    s.query(f"COPY Cust FROM (LOAD FROM '{sf_dir}/customer.parquet' WHERE c_acctbal > 0 RETURN c_custkey, c_name, c_acctbal)")
    s.query(f"COPY (MATCH (c:Cust) RETURN c.id AS id, c.name AS name, c.bal AS bal) TO '{out}' (HEADER=true, DELIM='|')")
    return s.query(f"LOAD WITH HEADERS (id INT64, name STRING, bal DOUBLE) FROM '{out}' (HEADER=true, DELIM='|') RETURN id, name, bal")


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projected graph: some tables under predicates."""
    s = graphs.commerce(spark, sf_dir)
    s.query("CALL project_graph('rich', {Customer: 'n.c_acctbal > 5000', Orders: ''}, {PLACED: ''})")
    return projected_session(s, "rich").query("MATCH (c)-[:PLACED]->(o) RETURN c.c_mktsegment AS seg, count(*) AS n")


def _database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports a database, attaches the copy and queries it."""
    s, path = graphs.trade(spark, sf_dir), f"{shared_dir(spark)}/db-{uuid.uuid4().hex}"
    s.query(f"EXPORT DATABASE '{path}'")
    other = graphs.Session(spark)
    return other.query(f"ATTACH '{path}' AS copy; USE DATABASE copy; MATCH (a:Nation)-[t:TRADES]->(b:Nation) RETURN a.n_name AS a, b.n_name AS b, t.n AS n")


def _follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follower store: nations as nodes of the log, then one deleted, then a query under its rules."""
    store = FollowerStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    store.insert_nodes([(f"n{r.n_nationkey}", "Nation", {"name": r.n_name, "region": r.n_regionkey if r.n_regionkey != 2 else None}) for r in rows])
    store.delete_node("n3")
    return store.query("MATCH (n:Nation) WHERE n.region = NULL OR n.region <> 1 RETURN id(n) AS id, n.name AS name, n.region AS region")


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "files_copy_and_load": (_files, "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 0"),
    "projected_graph": (_projected, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1"),
    "export_attach_database": (_database, f"WITH {_TRADES} SELECT a.n_name AS a, b.n_name AS b, t.n FROM t JOIN nation a ON a.n_nationkey = f JOIN nation b ON b.n_nationkey = d"),
    # the follower's equality with NULL is true or false, its OR is NULL only if a side is, and neither is here
    "follower_store": (_follower, "SELECT 'n' || n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey <> 2 THEN CAST(n_regionkey AS BIGINT) END AS region FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 3"),
}

TEXTS |= more_queries.TEXTS
OTHERS |= more_queries.OTHERS


def _query(graph: Callable, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: graph(spark, sf_dir).query(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(graph, text) for name, (graph, text, _) in TEXTS.items()} | {name: f for name, (f, _) in OTHERS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, _, sql) in TEXTS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
