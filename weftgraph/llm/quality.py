"""Quality rules as a short-circuit cascade.

Each rule says whether it rejects a text and which figures it needs; a figure is computed when first asked for. On a
bounded sample, some rows of tasks spread over the whole table, the time of every figure and the set of rules that
reject each text are noted. Rules are then chosen one by one: next is the one with the most rejections, among the
sample's texts that all earlier ones let pass, per second of the figures that those haven't computed. A text leaves at
its first rejection. The verdict is that of all rules together, so the order (and the sample behind it) changes the
cost and nothing else.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sample that costs and rejections are estimated on: tasks, documents of each, and how much of each.
SAMPLE_TASKS, SAMPLE_ROWS, SAMPLE_CHARS = 32, 20, 20_000

SYMBOLS = "#*$%&|<>"
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


class Figures:
    """What the rules look at, each figure computed at most once for a text."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {x for x, n in Counter(windows).items() if n > 1}
        covered = bytearray(len(w))
        for i, x in enumerate(windows):
            if x in often:
                covered[i : i + 3] = b"\1\1\1"
        return sum(covered)


#: What each figure is computed from, in an order in which they can be timed one after the other.
DEPENDS = {"words": (), "n_words": ("words",), "word_chars": (), "n_symbols": (), "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words",)}


@dataclass(frozen=True)
class Rule:
    needs: tuple[str, ...]
    rejects: Callable[[Figures], bool]


#: Base rules first as written; the order that they run in is estimated.
RULES: dict[str, Rule] = {
    "few_words": Rule(("n_words",), lambda f: f.n_words < 50),
    "repeated_windows": Rule(("n_repeat_words", "n_words"), lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    "symbols": Rule(("n_symbols", "n_words"), lambda f: 10 * f.n_symbols > f.n_words),
    "repeated_lines": Rule(("n_dup_lines", "lines"), lambda f: 2 * f.n_dup_lines > len(f.lines)),
    "short_words": Rule(("word_chars", "n_words"), lambda f: f.word_chars < 2 * f.n_words),
    "long_words": Rule(("word_chars", "n_words"), lambda f: f.word_chars > 15 * f.n_words),
}
BASE = ("few_words", "repeated_windows")


@dataclass
class Estimate:
    """Seconds of each figure over the sample, and its texts by the set of rules that reject them."""

    seconds: dict[str, float]
    rejected: dict[frozenset[str], int]


def estimate(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES, rows: int = SAMPLE_ROWS, tasks: int = SAMPLE_TASKS) -> Estimate:
    """Times and rejections on the first rows of `tasks` tasks spread over the table; only sums reach the driver."""
    text = docs.select(F.col(text_col).cast("string").alias("text"))
    every = max(1, text.rdd.getNumPartitions() // tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % every:
            return
        left, seconds, rejected = rows, Counter(), Counter()
        for batch in batches:
            for v in batch.column(0).slice(0, left):
                f = Figures((v.as_py() or "")[:SAMPLE_CHARS])
                for name in DEPENDS:
                    began = time.perf_counter()
                    getattr(f, name)
                    seconds[name] += time.perf_counter() - began
                rejected[",".join(n for n, r in rules.items() if r.rejects(f))] += 1
            left -= batch.num_rows
            if left <= 0:
                break
        parts = [("f", k, x) for k, x in seconds.items()] + [("r", k, float(n)) for k, n in rejected.items()]
        yield pa.RecordBatch.from_pylist([{"what": w, "name": k, "x": x} for w, k, x in parts], pa.schema([("what", pa.string()), ("name", pa.string()), ("x", pa.float64())]))

    sums = text.mapInArrow(run, "what string, name string, x double").groupBy("what", "name").agg(F.sum("x").alias("x")).collect()
    return Estimate({r.name: r.x for r in sums if r.what == "f"}, {frozenset(filter(None, r.name.split(","))): int(r.x) for r in sums if r.what == "r"})


def cascade_order(e: Estimate, rules: dict[str, Rule] = RULES) -> list[str]:
    """Most rejections per second first, given the rules before it; among rules that reject nothing more the cheap ones."""
    order, known = [], set()

    def cost(name: str) -> float:
        todo, all_ = list(rules[name].needs), set()
        while todo:
            f = todo.pop()
            if f not in all_:
                all_.add(f)
                todo += DEPENDS.get(f, ())
        return sum(e.seconds.get(f, 0.0) for f in all_ - known) + 1e-9

    while len(order) < len(rules):
        passed = {k: n for k, n in e.rejected.items() if not k & set(order)}
        gain = lambda name: sum(n for k, n in passed.items() if name in k)  # noqa: B023,E731
        best = min(rules.keys() - set(order), key=lambda name: (-gain(name) / cost(name), cost(name), name))
        order.append(best)
        todo = list(rules[best].needs)
        while todo:
            f = todo.pop()
            known.add(f)
            todo += DEPENDS.get(f, ())
    return order


def plan(docs: DataFrame, text_col: str = "text", rules: dict[str, Rule] = RULES) -> list[str]:
    return cascade_order(estimate(docs, text_col, rules), rules)


def rejected_by(figures: Figures, order: list[str], rules: dict[str, Rule] = RULES) -> str | None:
    """The rule at which a text leaves the cascade; None if it passes all."""
    return next((name for name in order if rules[name].rejects(figures)), None)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the base figures, base_failed, and kept, the cascade's verdict.

    The verdict comes from the cascade; figures that it didn't need are filled in afterwards, as they are asked for
    here. A null text counts as empty and so fails the base rules, as does a text of white space. Repeated rows and
    null ids are kept as they come, an empty table gives an empty result, other columns are ignored.
    """
    order = plan(docs, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed, kept = [], [], []
            for v in batch.column(1):
                f = Figures(v.as_py())
                leaves = rejected_by(f, order)
                kept.append(leaves is None)
                failed.append(leaves is not None and (leaves in BASE or rejected_by(f, BASE) is not None))
                rows.append([getattr(f, n) for n in names])
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["doc_id", *names, "base_failed", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they were; rules run in the estimated order.

    Null and empty texts have too few words and go; repeated rows stay or go together; null ids make no difference;
    an empty table gives an empty result. No column is added, so names can't clash.
    """
    order = plan(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([rejected_by(Figures(t.as_py()), order) is None for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(place, rule, asked, rejected): of how many texts each rule of the cascade was asked, and how many left there."""
    order = plan(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = Counter()
        for batch in batches:
            left.update(rejected_by(Figures(t.as_py()), order) for t in batch.column(0))
        rows = [{"place": i, "rule": n, "asked": sum(left.values()) - sum(left[o] for o in order[:i]), "rejected": left[n]} for i, n in enumerate(order)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("place", pa.int32()), ("rule", pa.string()), ("asked", pa.int64()), ("rejected", pa.int64())]))

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "place int, rule string, asked long, rejected long")
    return counted.groupBy("place", "rule").agg(F.sum("asked").alias("asked"), F.sum("rejected").alias("rejected"))


#: The same figures and verdict in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM keyed WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM d JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
   AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words) AS kept
FROM b
"""
