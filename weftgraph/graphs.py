"""The property graph over the star-schema tables: lazy views, nothing is copied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import GraphCatalog
from .session import Session

#: lineitem column by property name
LINE = {"suppkey": "l_suppkey", "linenumber": "l_linenumber", "quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "shipdate": "l_shipdate"}


#: By session, graph and folder; a catalog keeps its session alive, so an id stands for one session only.
_opened: dict[tuple[int, str, str], GraphCatalog] = {}


def graph(build: Callable[[SparkSession, str], GraphCatalog]) -> Callable[[SparkSession, str], Session]:
    """Opens a graph once for a session and a folder; each session works on a snapshot of its own."""

    def opened(spark: SparkSession, sf_dir: str) -> Session:
        key = (id(spark), build.__name__, sf_dir)
        if key not in _opened:
            _opened[key] = build(spark, sf_dir)
        return Session(spark, _opened[key].snapshot())

    opened.__doc__ = build.__doc__
    return opened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@graph
def commerce(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Region, Nation, Customer, Supplier, Part and Orders with their relationships, line items as CONTAINS."""
    g = GraphCatalog(spark)
    read = {n: _table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    for label, table, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey")):
        g.add_nodes(label, read[table], key)
    g.add_rels("IN_REGION", read["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), multiplicity="MANY_ONE")
    g.add_rels("CUST_IN", read["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), multiplicity="MANY_ONE")
    g.add_rels("SUPP_IN", read["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), multiplicity="MANY_ONE")
    g.add_rels("PLACED", read["orders"], ("Customer", "o_custkey"), ("Orders", "o_orderkey"), multiplicity="ONE_MANY")
    g.add_rels("CONTAINS", read["lineitem"], ("Orders", "l_orderkey"), ("Part", "l_partkey"), LINE)
    g.add_rels("SHIPPED_BY", read["lineitem"], ("Orders", "l_orderkey"), ("Supplier", "l_suppkey"), {k: v for k, v in LINE.items() if k != "suppkey"})
    supplies = read["lineitem"].select("l_suppkey", "l_partkey").distinct().withColumn("rid", F.shiftleft("l_suppkey", 32).bitwiseOR(F.col("l_partkey")))
    g.add_rels("SUPPLIES", supplies, ("Supplier", "l_suppkey"), ("Part", "l_partkey"), [], rid="rid")
    return g


@graph
def trade(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Nations and what flows between them: customers of one buy from suppliers of the other."""
    g = GraphCatalog(spark)
    nation = _table(spark, sf_dir, "nation")
    g.add_nodes("Nation", nation, "n_nationkey")
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    flows = (
        line.join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    )
    flows = flows.withColumn("rid", F.col("c_nationkey").cast("long") * 1000 + F.col("s_nationkey"))
    g.add_rels("TRADES", flows, ("Nation", "c_nationkey"), ("Nation", "s_nationkey"), ["n", "quantity"], rid="rid")
    return g


@graph
def talk(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Turns of conversations, each followed by the next."""
    g = GraphCatalog(spark)
    turns = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", F.length("text").alias("chars"))
    g.add_nodes("Turn", turns, "id")
    after = turns.select("id", F.lead("id").over(W.partitionBy("conv_id").orderBy("turn")).alias("next")).where("next IS NOT NULL").withColumn("rid", F.col("id"))
    g.add_rels("NEXT_TURN", after, ("Turn", "id"), ("Turn", "next"), rid="rid")
    return g


@graph
def activity(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    """Events of a user, each followed by the next, with the seconds between."""
    g = GraphCatalog(spark)
    events = _table(spark, sf_dir, "events")
    g.add_nodes("Event", events, "event_id")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    after = events.select("event_id", F.lead("event_id").over(w).alias("next"), (F.unix_seconds(F.lead("ts").over(w).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("gap_s")).where("next IS NOT NULL")
    g.add_rels("NEXT_EVENT", after.withColumn("rid", F.col("event_id")), ("Event", "event_id"), ("Event", "next"), ["gap_s"], rid="rid")
    g.add_nodes("Document", _table(spark, sf_dir, "documents"), "doc_id")
    g.add_nodes("Vec", _table(spark, sf_dir, "embeddings"), "vec_id")
    return g
