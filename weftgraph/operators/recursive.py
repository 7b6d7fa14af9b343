"""Recursive relationships: walks, trails, acyclic and shortest paths, hop by hop.

An edge frame has f (from), t (to), r (identity), and, where paths are asked for, rel and mid (structs of the
relationship and of the node it leads to). The driver only loops over hops; every hop is an equi-join of the
frontier with the edges. Frontiers of longer loops are written to the shared folder, so a lost executor costs
one hop at most and plans stay short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Loops up to this many hops stay one lazy plan.
LAZY_HOPS = 3


@dataclass
class Spec:
    low: int
    high: int
    mode: str  # WALK, TRAIL, ACYCLIC, SHORTEST, ALL SHORTEST, WSHORTEST, ALL WSHORTEST
    paths: bool = False
    weighed: bool = False  # walks that nobody looks at may stay one row with their number in m


#: Rows that stand for m walks are written out in runs of this many, so no array grows with m.
RUN = 4096


def traverse(edges: DataFrame, sources: DataFrame, spec: Spec, inner: DataFrame | None = None) -> DataFrame:
    """(s, t, n, cost[, rels, mids]): one row per path; `sources` has the column s, `inner` the allowed mid nodes as k.

    A weighed spec without paths gives rows with a further column m where each stands for m walks (mode WALK only).
    """
    if spec.mode in ("WSHORTEST", "ALL WSHORTEST"):
        return _weighted(edges, sources, spec, inner)
    if spec.mode in ("SHORTEST", "ALL SHORTEST"):
        return _shortest(edges, sources, spec, inner)
    if spec.mode == "WALK" and not spec.paths:
        return _counted(edges, sources, spec, inner)
    return _walks(edges, sources, spec, inner)


def _open(frontier: DataFrame, inner: DataFrame | None, hop: int) -> DataFrame:
    """The frontier's nodes that a path may go on from: the predicate holds for mid nodes only."""
    if inner is None or hop == 0:
        return frontier
    return frontier.join(inner, frontier["t"] == inner["k"], "left_semi")


def _is_over(frontier: DataFrame, hop: int, high: int) -> tuple[DataFrame, bool]:
    if high <= LAZY_HOPS:
        return frontier, False
    frontier = materialise(frontier)
    return frontier, frontier.isEmpty()


def _all(levels: list[DataFrame], like: DataFrame) -> DataFrame:
    out = None
    for level in levels:
        out = level if out is None else out.unionByName(level)
    return out if out is not None else like.limit(0)


def _counted(edges: DataFrame, sources: DataFrame, spec: Spec, inner: DataFrame | None) -> DataFrame:
    """Walks whose paths nobody looks at: ends and multiplicities are added up hop by hop."""
    frontier = sources.select("s", F.col("s").alias("t"), F.lit(1).cast("long").alias("m"))
    e = edges.select("f", F.col("t").alias("to"))
    levels = [frontier.withColumn("n", F.lit(0).cast("long"))] if spec.low == 0 else []
    for hop in range(1, spec.high + 1):
        go = _open(frontier, inner, hop - 1)
        frontier = go.join(e, go["t"] == e["f"]).groupBy("s", F.col("to").alias("t")).agg(F.sum("m").alias("m"))
        frontier, over = _is_over(frontier, hop, spec.high)
        if over:
            break
        if hop >= spec.low:
            levels.append(frontier.withColumn("n", F.lit(hop).cast("long")))
    out = _all(levels, frontier.withColumn("n", F.lit(0).cast("long")))
    if spec.weighed:
        return out.select("s", "t", "n", F.lit(None).cast("double").alias("cost"), "m")
    zero = F.lit(0).cast("long")
    runs = out.withColumn("run", F.explode(F.sequence(zero, F.floor((F.col("m") - 1) / RUN))))
    once = runs.withColumn("again", F.explode(F.sequence(zero, F.least(F.lit(RUN), F.col("m") - F.col("run") * RUN) - 1)))
    return once.select("s", "t", "n", F.lit(None).cast("double").alias("cost"))


def _walks(edges: DataFrame, sources: DataFrame, spec: Spec, inner: DataFrame | None) -> DataFrame:
    e = edges.select("f", F.col("t").alias("to"), F.col("r").alias("rid"), *(["rel", "mid"] if spec.paths else []))
    frontier = sources.select("s", F.col("s").alias("t"), F.lit(0).cast("long").alias("n"))
    if spec.mode == "TRAIL":
        frontier = frontier.withColumn("seen", F.array().cast(f"array<{_kind(e, 'rid')}>"))
    if spec.mode == "ACYCLIC":
        frontier = frontier.withColumn("seen", F.array("s"))
    if spec.paths:
        frontier = _with_paths(frontier, e)
    levels = [frontier] if spec.low == 0 else []
    for hop in range(1, spec.high + 1):
        go = _open(frontier, inner, hop - 1)
        on = go.join(e, go["t"] == e["f"])
        if spec.mode == "TRAIL":
            on = on.where(~F.array_contains("seen", F.col("rid"))).withColumn("seen", F.array_append("seen", F.col("rid")))
        if spec.mode == "ACYCLIC":
            on = on.where(~F.array_contains("seen", F.col("to"))).withColumn("seen", F.array_append("seen", F.col("to")))
        frontier = _step(on, spec.paths, ["seen"] if "seen" in on.columns else [])
        frontier, over = _is_over(frontier, hop, spec.high)
        if over:
            break
        if hop >= spec.low:
            levels.append(frontier)
    return _shaped(_all(levels, frontier), spec.paths)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _with_paths(frontier: DataFrame, e: DataFrame) -> DataFrame:
    return frontier.withColumns({"rels": F.array().cast(f"array<{_kind(e, 'rel')}>"), "mids": F.array().cast(f"array<{_kind(e, 'mid')}>")})


def _step(on: DataFrame, paths: bool, more: list[str]) -> DataFrame:
    kept = [F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("mids", F.col("mid")).alias("mids")] if paths else []
    return on.select("s", F.col("to").alias("t"), (F.col("n") + 1).alias("n"), *more, *kept)


def _shaped(df: DataFrame, paths: bool) -> DataFrame:
    return df.select("s", "t", "n", F.col("cost").cast("double").alias("cost") if "cost" in df.columns else F.lit(None).cast("double").alias("cost"), *(["rels", "mids"] if paths else []))


def _shortest(edges: DataFrame, sources: DataFrame, spec: Spec, inner: DataFrame | None) -> DataFrame:
    """Breadth first: a node is new to a source at one level only. A source never reaches itself."""
    e = edges.select("f", F.col("t").alias("to"), F.col("r").alias("rid"), *(["rel", "mid"] if spec.paths else []))
    frontier = sources.select("s", F.col("s").alias("t"), F.lit(0).cast("long").alias("n"))
    if spec.paths:
        frontier = _with_paths(frontier, e)
    visited = frontier.select("s", "t")
    levels = []
    for hop in range(1, spec.high + 1):
        go = _open(frontier, inner, hop - 1)
        on = _step(go.join(e, go["t"] == e["f"]), spec.paths, ["f", "rid"] if spec.paths and spec.mode == "SHORTEST" else [])
        new = on.join(visited, ["s", "t"], "left_anti")
        if spec.mode == "SHORTEST":
            if spec.paths:
                path = F.min_by(F.struct("rels", "mids"), F.struct("f", "rid"))
                new = new.groupBy("s", "t").agg(F.min("n").alias("n"), path.alias("path")).select("s", "t", "n", "path.rels", "path.mids")
            else:
                new = new.select("s", "t", "n").distinct()
        frontier, over = _is_over(new, hop, spec.high)
        if over:
            break
        visited = visited.unionByName(frontier.select("s", "t").distinct())
        levels.append(frontier)
    return _shaped(_all(levels, frontier), spec.paths)


def _weighted(edges: DataFrame, sources: DataFrame, spec: Spec, inner: DataFrame | None) -> DataFrame:
    """Least cost over the paths within the hops, by rounds of relaxation that carry the paths along.

    After k rounds `best` holds the least cost of each pair within k hops. A path goes on only while it is as cheap as
    any with as few hops; a dearer path with fewer hops has gone on in its own round, so a bound on hops loses nothing.
    """
    one = spec.mode == "WSHORTEST"
    e = materialise(edges.select("f", F.col("t").alias("to"), F.col("r").alias("rid"), F.col("w").cast("double").alias("w"), *(["rel", "mid"] if spec.paths else [])))
    frontier = sources.select("s", F.col("s").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("cost"))
    if spec.paths:
        frontier = _with_paths(frontier, e)
    pathed = ["rels", "mids"] if spec.paths else []
    best = frontier.select("s", "t", F.col("cost").alias("least"))
    levels = []
    for hop in range(1, spec.high + 1):
        go = _open(frontier, inner, hop - 1)
        on = go.join(e, go["t"] == e["f"])
        kept = [F.array_append("rels", F.col("rel")).alias("rels"), F.array_append("mids", F.col("mid")).alias("mids")] if spec.paths else []
        on = on.select("s", F.col("to").alias("t"), (F.col("n") + 1).alias("n"), (F.col("cost") + F.col("w")).alias("cost"), "rid", *kept)
        if one:
            path = [F.min_by(F.struct(*pathed), F.struct("cost", "rid")).alias("path")] if pathed else []
            on = on.groupBy("s", "t").agg(F.min("n").alias("n"), F.min("cost").alias("cost"), *path).join(best, ["s", "t"], "left")
            new = on.where("least IS NULL OR cost < least").select("s", "t", "n", "cost", *[F.col(f"path.{c}").alias(c) for c in pathed])
        else:
            least = on.groupBy("s", "t").agg(F.min("cost").alias("now")).join(best, ["s", "t"], "left").select("s", "t", F.least("now", "least").alias("least"))
            new = on.join(least, ["s", "t"]).where(_as_cheap()).select("s", "t", "n", "cost", *pathed)
        frontier = materialise(new)
        if frontier.isEmpty():
            break
        levels.append(frontier)
        both = best.unionByName(frontier.select("s", "t", F.col("cost").alias("least")))
        best = materialise(both.groupBy("s", "t").agg(F.min("least").alias("least")))
    found = _all(levels, frontier).where("s <> t").join(best, ["s", "t"])
    return _shaped(found.where("cost = least" if one else _as_cheap()), spec.paths)


def _as_cheap():
    """Sums of the same weights in another order count as equal."""
    return F.col("cost") <= F.col("least") + 1e-9 * F.greatest(F.lit(1.0), F.abs("least"))
