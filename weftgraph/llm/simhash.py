"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

Each fingerprint becomes a vector of set bits per segment. Flipping one bit moves one coordinate by one, so the
Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints: cells of the grid
within that distance hold every true link. For a distance of two the range join meets in the middle: each
vector is written to its own cell and to those one step away, and any two vectors two steps apart share one.

Cells with few fingerprints are verified pair by pair. A cell with more (near copies of one text can give
thousands of fingerprints there) is verified without pairs: its fingerprints are written once for themselves
and once for each flipped bit, and those that meet on the same 64-bit value are exactly those that differ by
two bits or fewer, linked to the smallest of them. Both ways are exact, neither grows with a square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, own_name

SEGMENTS, SEGMENT_BITS = 16, 4
#: Cells with more fingerprints are verified by flipped bits instead of pairs.
PAIR_CELL = 48
SEED = 42
#: Fingerprints with more than this share of all rows, fewer than HOT_SHARE of them, are joined by broadcast.
HOT_SHARE = 1024


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for a text without words or a null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n < size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(line[s:e], SEED) for s, e in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist())),
            np.uint64,
            n - size + 1,
        )
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, fp) per row and the named columns of longs, fp as a signed long."""
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    schema = ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *carry))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry).mapInArrow(run, schema)


def cells(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(cell, fp): the cell of each popcount vector and those one step away. A digit of the cell is a segment."""
    width = 64 // segments
    digit = width.bit_length()
    if segments * digit > 63:
        raise ValueError("the cells of so many segments don't fit a long")
    counts = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") for i in range(segments)]
    named = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    own = sum((F.shiftleft(F.col(f"c{i}"), digit * i) for i in range(1, segments)), F.col("c0"))
    named = named.withColumn("own", own)
    steps = [F.col("own")]
    for i in range(segments):
        one = F.lit(1 << (digit * i)).cast("long")
        steps += [F.when(F.col(f"c{i}") < width, F.col("own") + one), F.when(F.col(f"c{i}") > 0, F.col("own") - one)]
    return named.select("fp", F.explode(F.array(*steps)).alias("cell")).where("cell IS NOT NULL")


def links(fps: DataFrame, segments: int = SEGMENTS, pair_cell: int = PAIR_CELL) -> DataFrame:
    """(a, b) over distinct fingerprints: joins everything within two bits, without all pairs of a group.

    Components of these links are those of all pairs within two bits; each link is itself within two bits.
    """
    spread = cells(fps, segments)
    shared = spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(spread.join(shared, "cell"))
    few = met.where(F.col("n") <= pair_cell).select("cell", "fp")
    x, y = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    pairs = x.join(y, "cell").where("a < b AND bit_count(a ^ b) <= 2").select("a", "b").distinct()
    many = met.where(F.col("n") > pair_cell).select("fp").distinct()
    flipped = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)])
    hubs = many.select("fp", F.explode(flipped).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("hub", "least")
    stars = hubs.join(least, "hub").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _components(fps: DataFrame, *least: str) -> DataFrame:
    """(fp, n, component): rows with each fingerprint, and the least struct of the named columns in its component."""
    groups = materialise(fps.groupBy("fp").agg(F.min(F.struct(*least)).alias("least"), F.count("*").alias("n")))
    label = connected_components(links(groups.select("fp")))
    linked = groups.join(label.withColumnRenamed("node", "fp"), "fp")
    root = linked.groupBy("root").agg(F.min("least").alias("least_of_root"))
    named = linked.join(root, "root").select("fp", "least_of_root")
    return groups.join(named, "fp", "left").select("fp", "n", F.coalesce("least_of_root", "least").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the least doc_id reachable.

    A null text counts as empty; texts without words share fingerprint zero and so one component. Rows that
    repeat an id stay repeated. A null id takes part but never names a component that has another id. An empty
    table gives an empty result. Other columns of docs are ignored, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col))
    # a struct of a null id would be the least: nulls last
    least = _components(fps.withColumn("none", F.col("doc_id").isNull()), "none", "doc_id")
    known = materialise(least.select("fp", "n", F.col("component.doc_id").alias("component_id")))
    # a fingerprint of many copies would send their rows to one task: the few that can be so frequent are broadcast
    least_hot = fps.count() / HOT_SHARE
    hot = F.broadcast(known.where(F.col("n") > least_hot).drop("n"))
    cold = known.where(F.col("n") <= least_hot).drop("n")
    found = fps.join(hot, "fp").unionByName(fps.join(hot, "fp", "left_anti").join(cold, "fp"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one row per component, all columns as they were.

    The row that stays has the smallest id of the component and, where rows repeat that id, the smallest hash of
    its text; of rows that are alike in both any one stays. So rows with one id and unlike texts are kept or
    dropped each on its own. A null text counts as empty. Rows with a null id all stay; an empty table gives an
    empty result. Added columns get names that docs doesn't have.
    """
    key, digest = own_name(docs, "kept_id"), own_name(docs, "text_digest")
    marked = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    some = marked.where(F.col(id_col).isNotNull())
    fps = materialise(fingerprints(some, id_col, text_col, [digest]))
    keep = _components(fps, "doc_id", digest).select(F.col("component.doc_id").alias(key), F.col(f"component.{digest}").alias(f"{digest}_kept")).distinct()
    on = (some[id_col] == keep[key]) & (some[digest] == keep[f"{digest}_kept"])
    kept = some.join(keep, on, "left_semi").dropDuplicates([id_col, digest]).drop(digest)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
