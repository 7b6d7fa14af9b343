"""Personal data: fixed patterns, and bootstrapped contextual extraction around them.

Spans of the fixed patterns are the seed entities. Each occurrence gives lexical patterns: the words left of
it, right of it and both, together with the coarse shape of the entity. Other tokens that look like identifiers
(they hold a digit or an @) are candidates with the same kind of patterns. Patterns and instances form a
bipartite graph that Spark scores in rounds: a pattern is trusted by the share of its distinct instances that
are trusted, a candidate by the patterns that it occurs in. Patterns of high confidence are the model; a
candidate outside the fixed spans whose patterns agree becomes a span of the seeds' kind.

All patterns of high confidence count. Up to `BROADCAST_PATTERNS` of them are broadcast and looked up where the texts
are; more are joined, by pattern, with the candidates' patterns, and the spans that come out go back to the texts by a
hash of the text. Both ways give the same spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, own_name

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so many distinct seeds; it is in the model from this confidence; a candidate from this score.
LEAST_SEEDS, LEAST_PATTERN, LEAST_SCORE = 3, 0.6, 0.85
#: A model of more patterns (of at most about 300 bytes) is joined instead of broadcast.
BROADCAST_PATTERNS = 50_000
CONTEXT, LOOK_BACK = 48, 64

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]+")
_EDGE = re.compile(r"[\s\"'(),;<>\[\]{}|=]")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: time in proportion to the text, whatever its runs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found: list[Span] = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def _token_start(text: str, behind: int, at: int) -> int:
    """Where the token that holds `at` begins, at or after `behind`; looks back further and further."""
    reach = LOOK_BACK
    while True:
        low = max(behind, at - reach)
        edges = [x.end() for x in _EDGE.finditer(text, low, at)]
        if edges or low == behind:
            return edges[-1] if edges else low
        reach *= 4


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Tokens of five characters or more with a digit or an @ that touch no span."""
    behind = 0
    starts = sorted(s for s, _, _ in taken)
    reach = list(accumulate((e for _, e, _ in sorted(taken)), max))  # the furthest end of the spans up to each
    for m in _MARK.finditer(text):
        if m.start() < behind:
            continue
        start = _token_start(text, behind, m.start())
        right = _EDGE.search(text, m.end())
        end = behind = right.start() if right else len(text)
        end = start + len(text[start:end].rstrip(".:!?"))
        if end - start < 5:
            continue
        before = bisect_left(starts, end)
        if before == 0 or reach[before - 1] <= start:
            yield start, end


def _word(w: str) -> str:
    return re.sub(r"[0-9]+", "9", w.lower())[:24]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence: shape and the words left, right and around."""
    body = text[start:end]
    shape = "x" if re.search(r"[^\W\d_]", body) else "n"
    left = text[max(0, start - CONTEXT) : start].split()
    right = text[end : end + CONTEXT].split()
    found = []
    if left:
        found.append(f"{shape} {_word(left[-1])} _")
    if len(left) > 1:
        found.append(f"{shape} {_word(left[-2])} {_word(left[-1])} _")
    if right:
        found.append(f"{shape} _ {_word(right[0])}")
    if left and right:
        found.append(f"{shape} {_word(left[-1])} _ {_word(right[0])}")
    return found


def graph(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, instance, kind): the edges; kind is 0 for candidates and 1 to 4 for seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = set()
            for v in batch.column(0):
                text = v.as_py() or ""
                if not _MARK.search(text):
                    continue
                base = base_spans(text)
                for s, e, kind in [*((s, e, k + 1) for s, e, k in base), *((s, e, 0) for s, e in candidates(text, base))]:
                    inst = xxhash.xxh64_intdigest(text[s:e].encode("utf-8", "surrogatepass")) - (1 << 63)
                    edges.update((p, inst, kind) for p in patterns(text, s, e))
            cols = list(zip(*edges)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())], names=["pattern", "instance", "kind"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern string, instance long, kind int").distinct()


def induce(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, conf): the patterns that seeds induce, scored on the pattern-instance graph.

    One row per pattern: of several kinds the one with the higher confidence, of equal ones the first kind. Null and
    empty texts, an empty table, and texts without seeds induce nothing; repeated rows and texts count once.
    """
    edges = materialise(graph(docs, text_col))
    seeded = edges.where("kind > 0").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS)
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    base = materialise(seeded.join(size, "pattern").select("pattern", F.col("kind").alias("k"), "seeds", "n"))
    open_edges = materialise(edges.where("kind = 0").select("pattern", "instance").distinct().join(base.select("pattern").distinct(), "pattern", "left_semi"))
    conf = base.select("pattern", "k", (F.col("seeds") / (F.col("n") + 1)).alias("conf"))
    for _ in range(rounds - 1):
        trusted = conf.where("conf >= 0.3")
        by_instance = open_edges.join(trusted, "pattern").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("s"))
        gained = open_edges.join(by_instance.where("s >= 0.5"), "instance").groupBy("pattern", "k").agg(F.sum("s").alias("gain"))
        conf = base.join(gained, ["pattern", "k"], "left").select("pattern", "k", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("n") + 1)).alias("conf"))
        conf = materialise(conf)
    best = conf.where(F.col("conf") >= LEAST_PATTERN).groupBy("pattern").agg(F.max_by(F.struct("k", "conf"), F.struct("conf", -F.col("k"))).alias("b"))
    return best.select("pattern", (F.col("b.k") - 1).alias("kind"), F.least("b.conf", F.lit(0.999)).alias("conf"))


def _kind(doubt: list[float]) -> int | None:
    """The kind that the patterns of a candidate agree on, from the sums of log(1 - confidence) by kind."""
    k = min(range(len(KINDS)), key=lambda k: (doubt[k], k))
    return k if 1 - math.exp(doubt[k]) >= LEAST_SCORE else None


def added_spans(text: str, base: list[Span], known: dict[str, tuple[int, float]]) -> list[Span]:
    if not known or not _MARK.search(text):
        return []
    found = []
    for s, e in candidates(text, base):
        doubt = [0.0] * len(KINDS)
        for p in patterns(text, s, e):
            if p in known:
                kind, conf = known[p]
                doubt[kind] += math.log1p(-conf)
        k = _kind(doubt)
        if k is not None:
            found.append((s, e, k))
    return found


def _digest(text_col: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)


def joined_spans(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, more): the added spans of each different text that has some, by a join with the table of patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, int, int, str]] = []
            for digest, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = v.as_py() or ""
                if _MARK.search(text):
                    rows += [(digest, s, e, p) for s, e in candidates(text, base_spans(text)) for p in patterns(text, s, e)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "s", "e", "pattern"])

    texts = docs.select(_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    asked = texts.mapInArrow(run, "digest string, s long, e long, pattern string").distinct()
    doubt = asked.join(known, "pattern").groupBy("digest", "s", "e", "kind").agg(F.sum(F.log1p(-F.col("conf"))).alias("doubt"))
    best = doubt.groupBy("digest", "s", "e").agg(F.min(F.struct("doubt", "kind")).alias("b")).where(1 - F.exp("b.doubt") >= LEAST_SCORE)
    return best.groupBy("digest").agg(F.collect_list(F.struct("s", "e", F.col("b.kind").cast("long").alias("k"))).alias("more"))


def with_added(docs: DataFrame, text_col: str, name: str, most: int = BROADCAST_PATTERNS) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """Either docs and the model, or docs with the added spans in a column `name` and an empty model."""
    known = materialise(induce(docs, text_col))
    if known.count() <= most:
        return docs, {r.pattern: (r.kind, r.conf) for r in known.collect()}
    key = own_name(docs, "text_digest")
    spans = joined_spans(docs, known, text_col).withColumnRenamed("digest", key).withColumnRenamed("more", name)
    return docs.withColumn(key, _digest(text_col)).join(spans, key, "left").drop(key), {}


def all_spans(text: str, known: dict[str, tuple[int, float]], more: list[dict] | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), the latter by the model or as they were joined."""
    base = base_spans(text)
    return base, [(x["s"], x["e"], x["k"]) for x in more] if more else added_spans(text, base, known)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_PATTERNS) -> DataFrame:
    """One row per row of docs: doc_id, counts of the base spans by kind, base_sha256 and all spans.

    A null text counts as empty. Repeated rows and null ids are kept as they come, an empty table gives an empty
    result, other columns are ignored. Positions are code points, ends exclusive.
    """
    rows, known = with_added(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "more", most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [], [], []
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for v, more in zip(batch.column(1), given):
                base, added = all_spans(v.as_py() or "", known, more)
                kinds = [k for _, _, k in base]
                counts.append([kinds.count(k) for k in range(len(KINDS))])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + added))
            cols = list(zip(*counts)) or [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span written as its kind; where spans overlap the earlier one names all of it."""
    parts, done = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
        if s >= done:
            parts += [text[done:s], f"<{KINDS[k]}>"]
        done = max(done, e)
    return "".join([*parts, text[done:]])


def mask(docs: DataFrame, text_col: str = "text", most: int = BROADCAST_PATTERNS) -> DataFrame:
    """docs with the spans masked in the text; a column n_chars follows the text. All rows and columns stay.

    Null texts stay null, repeated rows are masked alike, null ids make no difference, an empty table gives an
    empty result. A column that is added on the way has a name that docs doesn't have.
    """
    name = own_name(docs, "more_spans")
    rows, known = with_added(docs, text_col, name, most)
    at, fields = docs.columns.index(text_col), docs.schema.fields
    extra = name in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            given = batch.column(len(fields)).to_pylist() if extra else [None] * batch.num_rows
            for v, more in zip(batch.column(at), given):
                text = v.as_py()
                if text:
                    base, added = all_spans(text, known, more)
                    text = masked(text, base + added) if base or added else text
                texts.append(text)
            columns = list(batch.columns)[: len(fields)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(fields)])

    out = rows.mapInArrow(run, T.StructType(fields))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
