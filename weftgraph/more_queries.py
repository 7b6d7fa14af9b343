"""Registered queries of functions, table functions, files, statements and the follower store, each with SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graphs
from .storage import shared_dir
from .streaming.follower import FollowerStore, Schema

#: name -> (graph, query, SQL)
TEXTS: dict[str, tuple[Callable, str, str]] = {
    "fn_trigonometry": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, CAST(n.n_nationkey AS DOUBLE) / 30 AS x RETURN k, round(acos(x), 9) AS ac, round(asin(x), 9) AS si, round(atan(x), 9) AS ta, round(cot(x + 1), 9) AS co, round(tan(x), 9) AS tn, round(pi(), 9) AS p",
        "WITH t AS (SELECT n_nationkey AS k, n_nationkey / 30.0::DOUBLE AS x FROM nation) SELECT k, round(acos(x), 9) AS ac, round(asin(x), 9) AS si, round(atan(x), 9) AS ta, round(cot(x + 1), 9) AS co, round(tan(x), 9) AS tn, round(pi(), 9) AS p FROM t",
    ),
    "fn_rounding_of_large_values": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal * CASE WHEN c.c_custkey % 2 = 0 THEN 1.0e18 ELSE 0.125 END AS x RETURN k, floor(x) AS f, ceil(x) AS c, round(x, 1) = x AS r, even(x) >= x OR x < 0 AS e",
        "WITH t AS (SELECT c_custkey AS k, c_acctbal * CASE WHEN c_custkey % 2 = 0 THEN 1e18::DOUBLE ELSE 0.125::DOUBLE END AS x FROM customer) SELECT k, floor(x) AS f, ceil(x) AS c, (abs(x) * 10 >= 4503599627370496 OR floor(abs(x) * 10 + 0.5) / 10 * sign(x) = x) AS r, true AS e FROM t",
    ),
    "fn_division_by_zero": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS x, CAST(c.c_custkey % 3 AS DOUBLE) AS y RETURN k, x / y > 1.0e300 AS inf, x / y < -1.0e300 AS ninf, to_string(x % y) = 'NaN' OR to_string(x % y) = 'nan' AS nan",
        "SELECT c_custkey AS k, c_custkey % 3 = 0 AND c_acctbal > 0 AS inf, c_custkey % 3 = 0 AND c_acctbal < 0 AS ninf, c_custkey % 3 = 0 AS nan FROM customer",
    ),
    "fn_random": (graphs.commerce, "MATCH (c:Customer) RETURN count(*) AS n, CAST(sum(count_if(random() >= 0 AND random() < 1)) AS INT64) AS inside, count(DISTINCT gen_random_uuid()) AS ids", "SELECT count(*) AS n, count(*) AS inside, count(*) AS ids FROM customer"),
    "fn_setseed": (graphs.commerce, "RETURN setseed(0.5); MATCH (c:Customer) RETURN count(*) AS n, max(random()) < 1 AS below", "SELECT count(*) AS n, true AS below FROM customer"),
    "fn_string_more": (
        graphs.commerce,
        "MATCH (p:Part) WITH p.p_partkey AS k, p.p_name AS s RETURN k, array_extract(s, 2) AS e, ltrim('  ' + s) AS l, rtrim(s + '  ') AS r, ends_with(s, 'g') AS w, suffix(s, 'g') AS sf, prefix(s, 'b') AS pf, ucase(s) AS u, lcase(s) AS lc, toupper(s) AS tu, tolower(s) AS tl, substring(s, 1, 3) AS sb, size(str_split(s, ' ')) AS n, string_to_array(s, ' ')[1] AS a",
        "SELECT p_partkey AS k, p_name[2] AS e, p_name AS l, p_name AS r, ends_with(p_name, 'g') AS w, ends_with(p_name, 'g') AS sf, starts_with(p_name, 'b') AS pf, upper(p_name) AS u, lower(p_name) AS lc, upper(p_name) AS tu, lower(p_name) AS tl, substr(p_name, 1, 3) AS sb, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS a FROM part",
    ),
    "fn_array": (
        graphs.commerce,
        "MATCH (p:Part) WITH p.p_partkey AS k, array_value(CAST(p.p_size AS DOUBLE), 2.0, p.p_retailprice) AS a, array_value(1.0, CAST(p.p_partkey % 7 AS DOUBLE), 3.0) AS b RETURN k, round(array_dot_product(a, b), 4) AS d, round(array_cross_product(a, b)[1], 4) AS x, round(array_cross_product(a, b)[2], 4) AS y, round(array_cross_product(a, b)[3], 4) AS z",
        "WITH t AS (SELECT p_partkey AS k, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS c, (p_partkey % 7)::DOUBLE AS m FROM part) SELECT k, round(a + 2 * m + 3 * c, 4) AS d, round(2 * 3 - c * m, 4) AS x, round(c - a * 3, 4) AS y, round(a * m - 2, 4) AS z FROM t",
    ),
    "fn_array_spellings": (
        graphs.commerce,
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 7, p.p_partkey] AS l RETURN k, list_to_string(',', array_concat(l, [1])) AS c, list_to_string(',', array_append(l, 2)) AS a, list_to_string(',', array_prepend(l, 3)) AS p, array_position(l, 7) AS o, array_contains(l, 8) AS h, list_to_string(',', array_slice(l, 2, 3)) AS s",
        "WITH t AS (SELECT p_partkey AS k, [p_size, 7, p_partkey]::BIGINT[] AS l FROM part) SELECT k, array_to_string(list_concat(l, [1]), ',') AS c, array_to_string(list_append(l, 2), ',') AS a, array_to_string(list_prepend(3, l), ',') AS p, CAST(list_position(l, 7) AS BIGINT) AS o, list_contains(l, 8) AS h, array_to_string(l[2:3], ',') AS s FROM t",
    ),
    "fn_casts_to_integers": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS x RETURN k, to_int8(k % 100) AS i8, to_int16(k % 30000) AS i16, to_int32('12') AS i32, to_int64(x) AS i64, to_uint8(k % 200) AS u8, to_uint16(k % 60000) AS u16, to_uint32(k) AS u32, to_string(to_uint64(k)) AS u64, to_string(to_int128(k)) AS i128, to_string(to_uint128(k)) AS u128, to_serial(k) AS se",
        "SELECT c_custkey AS k, CAST(c_custkey % 100 AS TINYINT) AS i8, CAST(c_custkey % 30000 AS SMALLINT) AS i16, 12 AS i32, CAST(round_even(c_acctbal, 0) AS BIGINT) AS i64, CAST(c_custkey % 200 AS INTEGER) AS u8, CAST(c_custkey % 60000 AS INTEGER) AS u16, CAST(c_custkey AS BIGINT) AS u32, CAST(c_custkey AS VARCHAR) AS u64, CAST(c_custkey AS VARCHAR) AS i128, CAST(c_custkey AS VARCHAR) AS u128, CAST(c_custkey AS BIGINT) AS se FROM customer",
    ),
    "fn_casts_to_others": (
        graphs.commerce,
        "MATCH (c:Customer) WITH c.c_custkey AS k, c.c_acctbal AS x RETURN k, to_double(to_string(k)) AS d, octet_length(to_blob('abc')) AS b, to_string(to_uuid('a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11')) AS u, to_date('1995-03-04') AS dt, to_string(to_interval('2 days')) = to_string(interval('2 days')) AS i, typeof(k) AS ty, typeof(x) AS tx",
        "SELECT c_custkey AS k, CAST(c_custkey AS DOUBLE) AS d, 3 AS b, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' AS u, DATE '1995-03-04' AS dt, true AS i, 'INT64' AS ty, 'DOUBLE' AS tx FROM customer",
    ),
    "fn_timestamp": (
        graphs.commerce,
        "MATCH (o:Orders) WITH o.o_orderkey AS k, o.o_orderdate AS t RETURN k, century(t) AS c, epoch_ms(k * 1000 + 7) AS e, to_timestamp(k) AS ts, to_epoch_ms(t) AS ms, t + to_years(2) AS y, t + to_seconds(k) AS s, t - to_milliseconds(k) AS m, t + to_microseconds(k) AS u, t + to_hours(3) AS h",
        "SELECT o_orderkey AS k, date_part('century', o_orderdate) AS c, CAST(epoch_ms(CAST(o_orderkey AS BIGINT) * 1000 + 7) AS TIMESTAMP) AS e, TIMESTAMP '1970-01-01' + to_seconds(o_orderkey) AS ts, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 YEAR AS y, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey) AS s, CAST(o_orderdate AS TIMESTAMP) - to_milliseconds(o_orderkey) AS m, CAST(o_orderdate AS TIMESTAMP) + to_microseconds(CAST(o_orderkey AS BIGINT)) AS u, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 HOUR AS h FROM orders",
    ),
    "fn_current_time": (graphs.commerce, "MATCH (r:Region) RETURN r.r_regionkey AS k, current_date() > date('2020-01-01') AS d, current_timestamp() IS NOT NULL AS t", "SELECT r_regionkey AS k, true AS d, true AS t FROM region"),
    "fn_hash_values": (graphs.commerce, "MATCH (c:Customer) RETURN count(DISTINCT hash(c.c_custkey)) AS n, min(hash('a') = hash('a')) AS same", "SELECT count(DISTINCT c_custkey) AS n, true AS same FROM customer"),
    "fn_element": (
        graphs.commerce,
        "MATCH (c:Customer)-[e:CUST_IN]->(n:Nation) RETURN c.c_custkey AS k, start_node(e).c_name AS s, end_node(e).n_name AS d, label(e) AS l, list_to_string(',', keys(n)) AS ks, offset(id(n)) = offset(id(end_node(e))) AS o",
        "SELECT c_custkey AS k, c_name AS s, n_name AS d, 'CUST_IN' AS l, 'n_nationkey,n_name,n_regionkey' AS ks, true AS o FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "fn_struct_pack_error": (
        graphs.commerce,
        "MATCH (n:Nation) WITH n.n_nationkey AS k, struct_pack(a := n.n_nationkey, b := n.n_name) AS s RETURN k, s.b AS b, CASE WHEN k < 0 THEN error('never') ELSE 1 END AS e",
        "SELECT n_nationkey AS k, n_name AS b, 1 AS e FROM nation",
    ),
    "sequences": (graphs.commerce, "CREATE SEQUENCE q START 2 INCREMENT 3; RETURN nextval('q'); RETURN nextval('q'); RETURN currval('q') AS c, nextval('q') AS n", "SELECT 5 AS c, 8 AS n"),
    "sequence_of_rows": (
        graphs.commerce,
        "CREATE SEQUENCE q START 10 INCREMENT 5; MATCH (c:Customer) WITH c, nextval('q') AS v RETURN count(DISTINCT v) AS n, min(v) AS lo, max(v) AS hi, currval('q') - max(v) AS gap",
        "SELECT count(*) AS n, 10 AS lo, 5 + 5 * count(*) AS hi, 0 AS gap FROM customer",
    ),
    "sequence_cycles": (
        graphs.commerce,
        "CREATE SEQUENCE q START 3 INCREMENT 2 MINVALUE 1 MAXVALUE 8 CYCLE; MATCH (c:Customer) WITH nextval('q') AS v RETURN v, count(*) AS n",
        "WITH t AS (SELECT row_number() OVER () - 1 AS p FROM customer) SELECT CASE WHEN p < 3 THEN 3 + 2 * p ELSE 1 + 2 * ((p - 3) % 4) END AS v, count(*) AS n FROM t GROUP BY 1",
    ),
    "sequence_as_default": (
        graphs.commerce,
        "CREATE NODE TABLE Mark(id SERIAL, k INT64, PRIMARY KEY(id)); MATCH (c:Customer) CREATE (:Mark {k: c.c_custkey}); MATCH (m:Mark) RETURN count(DISTINCT m.id) AS n, min(m.id) AS lo, max(m.id) AS hi, count(DISTINCT m.k) AS ks",
        "SELECT count(*) AS n, 0 AS lo, count(*) - 1 AS hi, count(*) AS ks FROM customer",
    ),
    "types_and_comments": (
        graphs.commerce,
        "CREATE TYPE money AS DECIMAL(12, 2); CREATE NODE TABLE Paid(id INT64, v money, PRIMARY KEY(id)); COMMENT ON TABLE Paid IS 'what was paid'; CALL show_tables() WHERE name = 'Paid' RETURN name, comment",
        "SELECT 'Paid' AS name, 'what was paid' AS comment",
    ),
    "drop_objects": (graphs.trade, "CREATE NODE TABLE Gone(id INT64, PRIMARY KEY(id)); CREATE SEQUENCE sq; DROP TABLE Gone; DROP SEQUENCE sq; CALL show_tables() RETURN name", "SELECT 'Nation' AS name UNION ALL SELECT 'TRADES'"),
    "merge_on_match": (
        graphs.commerce,
        "CREATE NODE TABLE Seg(id STRING, n STRING, PRIMARY KEY(id)); MATCH (c:Customer) WHERE c.c_acctbal > 0 MERGE (s:Seg {id: c.c_mktsegment}) ON CREATE SET s.n = 'new'; MATCH (r:Nation) MERGE (s:Seg {id: r.n_name}) ON CREATE SET s.n = 'nation'; UNWIND ['BUILDING', 'OTHER'] AS x MERGE (s:Seg {id: x}) ON MATCH SET s.n = 'again' ON CREATE SET s.n = 'late'; MATCH (s:Seg) RETURN s.id AS id, s.n AS n",
        "SELECT DISTINCT c_mktsegment AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'again' ELSE 'new' END AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT 'OTHER', 'late'",
    ),
    "transaction_commit": (
        graphs.commerce,
        "BEGIN TRANSACTION; MATCH (r:Region) WHERE r.r_regionkey = 0 SET r.r_name = 'changed'; COMMIT; CHECKPOINT; MATCH (r:Region) RETURN r.r_regionkey AS k, r.r_name AS name",
        "SELECT r_regionkey AS k, CASE WHEN r_regionkey = 0 THEN 'changed' ELSE r_name END AS name FROM region",
    ),
    "order_by_aggregate": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_nationkey AS k, count(*) AS n ORDER BY n DESC, k LIMIT 7",
        "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7",
    ),
    # shapes of a subgraph-matching benchmark: chain, cycle, star, shared neighbours, optional star, missing edge
    "shape_long_chain": (
        graphs.commerce,
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:CUST_IN]-(c:Customer)-[:PLACED]->(o:Orders)-[:SHIPPED_BY]->(s:Supplier)-[:SUPP_IN]->(m:Nation) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN customer ON c_nationkey = a.n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey",
    ),
    "shape_cycle": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:SHIPPED_BY]->(s:Supplier)-[:SUPP_IN]->(n:Nation)<-[:CUST_IN]-(c) RETURN n.n_name AS name, count(*) AS n",
        "SELECT n_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey AND n_nationkey = c_nationkey GROUP BY 1",
    ),
    "shape_star": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders), (o)-[:CONTAINS]->(p:Part), (o)-[:SHIPPED_BY]->(s:Supplier) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN part ON p_partkey = a.l_partkey JOIN lineitem b ON b.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = b.l_suppkey",
    ),
    "shape_shared_neighbour": (
        graphs.commerce,
        "MATCH (a:Part)<-[:CONTAINS]-(o:Orders)-[:CONTAINS]->(b:Part) WHERE a.p_partkey <> b.p_partkey RETURN count(*) AS n",
        "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey",
    ),
    "shape_two_pairs": (
        graphs.commerce,
        "MATCH (a:Supplier)-[:SUPP_IN]->(n:Nation)<-[:SUPP_IN]-(b:Supplier), (a)-[:SUPPLIES]->(p:Part)<-[:SUPPLIES]-(b) WHERE a.s_suppkey < b.s_suppkey RETURN n.n_nationkey AS k, count(*) AS n",
        "WITH x AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, s_nationkey AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT a.k, count(*) AS n FROM x a JOIN x b ON a.p = b.p AND a.k = b.k AND a.s < b.s GROUP BY 1",
    ),
    "shape_optional_star": (
        graphs.commerce,
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Orders) OPTIONAL MATCH (o)-[:SHIPPED_BY]->(s:Supplier) RETURN count(*) AS n, count(o) AS os, count(s) AS ss",
        "SELECT count(*) AS n, count(o_orderkey) AS os, count(s_suppkey) AS ss FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, s_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_orderkey = o_orderkey",
    ),
    "shape_missing_edge": (
        graphs.commerce,
        "MATCH (c:Customer)-[:PLACED]->(o:Orders)-[:SHIPPED_BY]->(s:Supplier) WHERE NOT EXISTS { MATCH (c)-[:CUST_IN]->(n:Nation)<-[:SUPP_IN]-(s) } RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey",
    ),
    "call_show_functions": (graphs.trade, "CALL show_functions() WHERE name = 'MD5' RETURN name, type", "SELECT 'MD5' AS name, 'scalar function' AS type"),
    "call_show_macros": (graphs.trade, "CREATE MACRO twice(x) AS x * 2; CALL show_macros() RETURN name", "SELECT 'twice' AS name"),
    "call_show_sequences": (graphs.trade, "CREATE SEQUENCE s7 START 7 INCREMENT 2; CALL show_sequences() RETURN name, `start value` AS st, increment AS inc, cycle AS cy", "SELECT 's7' AS name, 7 AS st, 2 AS inc, false AS cy"),
    "call_show_indexes": (graphs.commerce, "CALL show_indexes() RETURN `table name` AS t, list_to_string(',', `property names`) AS p", "SELECT * FROM (VALUES ('Region', 'r_regionkey'), ('Nation', 'n_nationkey'), ('Customer', 'c_custkey'), ('Supplier', 's_suppkey'), ('Part', 'p_partkey'), ('Orders', 'o_orderkey')) v(t, p)"),
    "call_show_connection": (graphs.commerce, "CALL show_connection('CUST_IN') RETURN `source table name` AS a, `destination table name` AS b, `source table primary key` AS ka, `destination table primary key` AS kb", "SELECT 'Customer' AS a, 'Nation' AS b, 'c_custkey' AS ka, 'n_nationkey' AS kb"),
    "call_stats_info": (graphs.commerce, "CALL stats_info('Orders') RETURN cardinality AS n", "SELECT count(*) AS n FROM orders"),
    "call_versions": (graphs.commerce, "CALL db_version() RETURN size(version) > 0 AS v", "SELECT true AS v"),
    "call_catalog_version": (graphs.commerce, "CALL catalog_version() RETURN version >= 0 AS v", "SELECT true AS v"),
    "call_current_setting": (graphs.commerce, "CALL var_length_extend_max_depth=9; CALL current_setting('var_length_extend_max_depth') RETURN var_length_extend_max_depth AS v", "SELECT '9' AS v"),
    "call_storage_info": (graphs.commerce, "CALL storage_info('Orders') RETURN table_name AS t, count(*) > 0 AS some", "SELECT 'Orders' AS t, true AS some"),
    "call_bm_info": (graphs.commerce, "CALL bm_info() RETURN mem_limit > 0 AS l, mem_usage >= 0 AS u", "SELECT true AS l, true AS u"),
    "call_fsm_info": (graphs.commerce, "CALL fsm_info() RETURN count(*) AS n", "SELECT 0 AS n"),
    "call_warnings": (graphs.commerce, "CALL clear_warnings(); CALL show_warnings() RETURN count(*) AS n", "SELECT 0 AS n"),
    "call_show_attached_databases": (graphs.commerce, "CALL show_attached_databases() RETURN count(*) AS n", "SELECT 0 AS n"),
    "call_show_extensions": (graphs.commerce, "CALL show_loaded_extensions() RETURN count(*) AS n", "SELECT 0 AS n"),
    "call_projected_graphs": (
        graphs.commerce,
        "CALL project_graph('rich', {Customer: 'n.c_acctbal > 5000', Orders: ''}, {PLACED: ''}); CALL project_graph('gone', ['Part'], []); CALL drop_projected_graph('gone'); CALL show_projected_graphs() RETURN name, type",
        "SELECT 'rich' AS name, 'NATIVE' AS type",
    ),
    "call_projected_graph_info": (
        graphs.commerce,
        "CALL project_graph('rich', {Customer: 'n.c_acctbal > 5000', Orders: ''}, {PLACED: ''}); CALL projected_graph_info('rich') RETURN `table type` AS t, `table name` AS name, predicate AS p",
        "SELECT * FROM (VALUES ('NODE', 'Customer', 'n.c_acctbal > 5000'), ('NODE', 'Orders', ''), ('REL', 'PLACED', '')) v(t, name, p)",
    ),
}


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}-{name}"


def _copy_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and relationships copied from files; the ends are looked up by their keys."""
    s = graphs.Session(spark)
    s.query("CREATE NODE TABLE Cust(id INT64, name STRING, PRIMARY KEY(id)); CREATE NODE TABLE Ord(id INT64, PRIMARY KEY(id)); CREATE REL TABLE MADE(FROM Cust TO Ord, price DOUBLE)")
    s.query(f"COPY Cust FROM (LOAD FROM '{sf_dir}/customer.parquet' RETURN c_custkey, c_name)")
    s.query(f"COPY Ord FROM (LOAD FROM '{sf_dir}/orders.parquet' RETURN o_orderkey)")
    s.query(f"COPY MADE FROM (LOAD FROM '{sf_dir}/orders.parquet' RETURN o_custkey, o_orderkey, o_totalprice)")
    return s.query("MATCH (c:Cust)-[m:MADE]->(o:Ord) RETURN c.name AS name, count(*) AS n, max(m.price) AS top")


def _dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with semicolons and quotes, read without being told its dialect."""
    out, s = _place(spark, "dialect.csv"), graphs.Session(spark)
    s.query(f"COPY (LOAD FROM '{sf_dir}/customer.parquet' RETURN c_custkey AS id, c_name + ';x' AS name, c_acctbal AS bal) TO '{out}' (HEADER=true, DELIM=';')")
    return s.query(f"LOAD FROM '{out}' RETURN CAST(id AS INT64) AS id, name, CAST(bal AS DOUBLE) AS bal")


def _csv_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader of CSV as a table function, declared lists of paths and a pattern of paths."""
    a, s = _place(spark, "serial.csv"), graphs.Session(spark)
    s.query(f"COPY (LOAD FROM '{sf_dir}/nation.parquet' RETURN n_nationkey AS k, n_name AS name) TO '{a}' (HEADER=true)")
    return s.query(f"CALL read_csv_serial('{a}', {{header: true}}) RETURN CAST(k AS INT64) AS k, name")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and patterns of paths."""
    base, s = _place(spark, "parts"), graphs.Session(spark)
    for half in (0, 1):
        s.query(f"COPY (LOAD FROM '{sf_dir}/nation.parquet' WHERE n_nationkey % 2 = {half} RETURN n_nationkey AS k, n_name AS name) TO '{base}-{half}.parquet'")
    whole = s.query(f"LOAD FROM '{base}-*.parquet' RETURN 'pattern' AS how, k, name")
    return whole.union(s.query(f"LOAD FROM ['{base}-0.parquet', '{base}-1.parquet'] RETURN 'list' AS how, k, name"))


def _npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and their ids from two .npy files in the shared folder, one per column."""
    import numpy as np
    from pyarrow import fs

    base, s = _place(spark, "npy"), graphs.Session(spark)
    keys = np.arange(200_000, dtype=np.int64)
    for name, values in (("id", keys), ("v", np.stack([keys, keys * 2], 1).astype(np.float32))):
        store, path = fs.FileSystem.from_uri(base) if ":" in base else (fs.LocalFileSystem(), base)
        with store.open_output_stream(f"{path}-{name}.npy") as f:
            np.save(f, values)
    s.query("CREATE NODE TABLE V(id INT64, e FLOAT[2], PRIMARY KEY(id))")
    s.query(f"COPY V FROM ('{base}-id.npy', '{base}-v.npy') BY COLUMN")
    return s.query("MATCH (v:V) RETURN v.id % 10 AS k, count(*) AS n, sum(v.e[1]) AS a, sum(v.e[2]) AS b")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A temporary view read by its name, and a frame as a parameter."""
    s, name = graphs.Session(spark), f"weft_{uuid.uuid4().hex}"
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.createOrReplaceTempView(name)
    view = s.query(f"LOAD FROM {name} RETURN 'view' AS how, n_nationkey AS k")
    return view.union(s.query("LOAD FROM $df RETURN 'parameter' AS how, n_nationkey AS k", {"df": nation}))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement run with two values."""
    p = graphs.commerce(spark, sf_dir).prepare("MATCH (c:Customer) WHERE c.c_acctbal > $least RETURN $least AS least, count(*) AS n")
    return p.execute(least=0.0).union(p.execute(least=5000.0))


def _udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function and a table function of one's own."""
    s = graphs.commerce(spark, sf_dir)
    s.create_function("shout", F.pandas_udf(lambda v: v.str.upper() + "!", "string"), "string")
    s.create_table_function("spread", lambda session, n: session.spark.range(n).withColumnRenamed("id", "i"))
    return s.query("CALL spread(3) RETURN i AS k, shout('row') AS name UNION ALL MATCH (n:Nation) RETURN CAST(n.n_nationkey AS INT64) AS k, shout(lower(n.n_name)) AS name")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that PROFILE counts; EXPLAIN gives a plan."""
    s = graphs.commerce(spark, sf_dir)
    plan = s.query("EXPLAIN MATCH (c:Customer) RETURN c.c_custkey").select(F.col("explain result").contains("Scan").alias("scan"))
    return s.query("PROFILE MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_custkey").select("rows").crossJoin(plan)


def _import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database exported as CSV and imported into an empty one."""
    s, path = graphs.trade(spark, sf_dir), _place(spark, "db")
    s.query(f"EXPORT DATABASE '{path}' (format='csv')")
    other = graphs.Session(spark)
    other.query(f"IMPORT DATABASE '{path}'")
    return other.query("MATCH (a:Nation)-[t:TRADES]->(b:Nation) RETURN a.n_name AS a, b.n_name AS b, t.quantity AS q")


def _store(spark: SparkSession, sf_dir: str) -> FollowerStore:
    """Regions and nations as nodes of the log, with edges between."""
    store = FollowerStore(spark, _place(spark, "store"))
    regions, nations = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("region", "nation"))
    store.insert_nodes([(f"r{r.r_regionkey}", "Region", {"name": r.r_name}) for r in regions] + [(f"n{r.n_nationkey}", "Nation", {"name": r.n_name, "k": r.n_nationkey}) for r in nations])
    for r in regions:
        store.insert_edge(f"e{r.r_regionkey}", "HAS", f"r{r.r_regionkey}", next(f"n{n.n_nationkey}" for n in nations if n.n_regionkey == r.r_regionkey), since=2000 + r.r_regionkey)
    return store


def _follower_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).query("MATCH (r:Region)-[e:HAS]->(n:Nation) WHERE e.since != 2003 RETURN r.name AS region, n.name AS nation, e.since AS since ORDER BY since DESC")


def _follower_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).query("MATCH (n:Nation) WHERE n.k > 5 RETURN count(n) AS n")


def _follower_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a controller receives of the log, in order, after a schema was pushed and a node deleted with its edges."""
    store, seen = _store(spark, sf_dir), []

    class Keeper:
        def connect(self) -> None: ...

        def apply(self, mutation: dict) -> None:
            seen.append((mutation["op"],))

        def flush(self) -> None: ...

    store.apply_schema(Schema(2, {"Region": {}, "Nation": {}}, {"HAS": {}}))
    store.delete_node_with_cascade("r0")
    store.sync(Keeper(), f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}-sync")
    return spark.createDataFrame(seen, "op string").groupBy(F.lower("op").alias("op")).agg(F.count("*").alias("n"))


_HAS = "first AS (SELECT n_regionkey AS r, min(n_nationkey) AS k FROM nation GROUP BY 1)"

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "copy_relationships": (_copy_rel, "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "csv_dialect": (_dialect, "SELECT c_custkey AS id, c_name || ';x' AS name, c_acctbal AS bal FROM customer"),
    "read_csv_functions": (_csv_functions, "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "paths_and_patterns": (_paths, "SELECT how, n_nationkey AS k, n_name AS name FROM nation, (VALUES ('pattern'), ('list')) v(how)"),
    "npy_columns": (_npy, "SELECT id % 10 AS k, count(*) AS n, CAST(sum(id) AS DOUBLE) AS a, CAST(sum(id * 2) AS DOUBLE) AS b FROM range(200000) t(id) GROUP BY 1"),
    "scan_replacement": (_frames, "SELECT how, n_nationkey AS k FROM nation, (VALUES ('view'), ('parameter')) v(how)"),
    "prepared_statement": (_prepared, "SELECT CAST(least AS DOUBLE) AS least, count(*) AS n FROM customer, (VALUES (0.0), (5000.0)) v(least) WHERE c_acctbal > least GROUP BY 1"),
    "own_functions": (_udfs, "SELECT i AS k, 'ROW!' AS name FROM (SELECT unnest(range(3)) AS i) UNION ALL SELECT n_nationkey, upper(n_name) || '!' FROM nation"),
    "profile_rows": (_profile, "SELECT count(*) AS rows, true AS scan FROM customer JOIN orders ON o_custkey = c_custkey"),
    "import_database": (_import, "SELECT a.n_name AS a, b.n_name AS b, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY 1, 2"),
    "follower_match": (_follower_match, f"WITH {_HAS} SELECT r_name AS region, n_name AS nation, CAST(2000 + r_regionkey AS BIGINT) AS since FROM region JOIN first ON r = r_regionkey JOIN nation ON n_nationkey = k WHERE r_regionkey <> 3"),
    "follower_delivery": (_follower_delivery, "SELECT * FROM (VALUES ('nodeinsert', 30), ('edgeinsert', 5), ('edgedelete', 1), ('nodedelete', 1), ('schemaapply', 1)) v(op, n)"),
    "follower_aggregate": (_follower_aggregate, "SELECT count(*) AS n FROM nation WHERE n_nationkey > 5"),
}
