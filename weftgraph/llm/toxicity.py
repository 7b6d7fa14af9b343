"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer maps each word to a class and a weight: insults (learned words and stems), threats, targets,
negations, reporting verbs, or nothing. Five small machines read the classes of a clause:

* an insult matches where the clause says something else too; a word standing alone is no clause;
* a threat matches together with a target, whichever comes first; without one it is dropped;
* a target in the clause adds its weight to an insult;
* a negation within two words before every attack of the clause, and a reporting verb before every one, add theirs.

They are composed into one machine. The state that it is in at the end of a clause says whether the clause matched and
gives the weight of its pattern (weights are logarithms and add up); the clause's score is that weight and the
strongest insult's. A text's sum over its matched clauses is brought between 0 and 1.

Everything is learned from a bounded sample of labelled training documents, each different text once: the insult
lexicon (words and stems that occur in toxic documents and hardly elsewhere, by a likelihood ratio), the weights of
the patterns (how much more or less often clauses with them are found in toxic documents, drawn towards a prior
where there are few), and the scale of the score. The closed word classes are fixed. Nothing but the text is ever an
input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: At most so many labelled rows are learned from: those with the smallest hash of the id.
TRAINING_ROWS = 12_000
THRESHOLD = 0.3
STEMS = (4, 5, 6)
#: A feature needs this likelihood ratio and this share of toxic documents among those that have it.
LEAST_RATIO, LEAST_PRECISION = 18.0, 0.9
#: What a pattern is taken to add before any clause was seen, and how sure of it (the variance).
PRIOR, PRIOR_VARIANCE = {"threat": 0.0, "target": 0.4, "negation": -0.7, "report": -0.35}, 0.25

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Closed word classes in the four languages (fixed values).
TARGETS = "you your youre u he she they him them tu toi vous te ton votre il elle ils du dich dir sie ihr er ihn usted ustedes él ella ellos"
NEGATIONS = "not never no neither nor isnt arent wasnt ne pas jamais nicht kein keine nie nunca jamás tampoco"
REPORTS = "said says say quoted wrote claimed called dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó"
THREATS = "kill murder strangle tuer tuerai umbringen töten matar mataré"

_UNIT = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_END = frozenset(".!?;:\n")
_CACHE = 400_000


@dataclass
class Machine:
    """A deterministic machine over word classes; missing arcs stay in the state. Each state has a set of marks."""

    arcs: dict[tuple[tuple, int], tuple] = field(default_factory=dict)
    marks: dict[tuple, frozenset[str]] = field(default_factory=lambda: {(0,): frozenset()})
    start: tuple = (0,)

    def arc(self, state: int, reads: tuple[int, ...], to: int) -> Machine:
        for read in reads:
            self.arcs[(state,), read] = (to,)
        for s in (state, to):
            self.marks.setdefault((s,), frozenset())
        return self

    def mark(self, state: int, name: str) -> Machine:
        self.marks[(state,)] = frozenset([name])
        return self

    def step(self, state: tuple, read: int) -> tuple:
        return self.arcs.get((state, read), state)

    def compose(self, other: Machine) -> Machine:
        """Both read the same clause; what either has marked is marked."""
        start = self.start + other.start
        made, todo = Machine({}, {start: self.marks[self.start] | other.marks[other.start]}, start), [(self.start, other.start)]
        while todo:
            a, b = todo.pop()
            for read in range(6):
                x, y = self.step(a, read), other.step(b, read)
                made.arcs[a + b, read] = x + y
                if x + y not in made.marks:
                    made.marks[x + y] = self.marks[x] | other.marks[y]
                    todo.append((x, y))
        return made

    def table(self) -> tuple[list[list[int]], list[frozenset[str]]]:
        """Where each state goes by class, and its marks; the start is state 0."""
        order = [self.start, *sorted(self.marks.keys() - {self.start})]
        number = {s: i for i, s in enumerate(order)}
        return [[number[self.step(s, r)] for r in range(6)] for s in order], [self.marks[s] for s in order]


ATTACK = (INSULT, THREAT)


def insult_machine() -> Machine:
    """1: an insult and nothing else so far; 2: other words; 3: an insult in a clause."""
    other = (OTHER, THREAT, TARGET, NEGATION, REPORT)
    return Machine().arc(0, (INSULT,), 1).arc(0, other, 2).arc(1, other, 3).arc(2, (INSULT,), 3).mark(3, "insult")


def threat_machine() -> Machine:
    """1: a threat that waits for its target; 2: a target; 3: both."""
    return Machine().arc(0, (THREAT,), 1).arc(0, (TARGET,), 2).arc(1, (TARGET,), 3).arc(2, (THREAT,), 3).mark(3, "threat")


def target_machine() -> Machine:
    return Machine().arc(0, (TARGET,), 1).mark(1, "target")


def negation_machine(reach: int = 2) -> Machine:
    """k: a negation reaches k words on, no attack yet; 10 + k: all attacks were negated; 20: one wasn't."""
    m = Machine()
    for base in (0, 10):
        for k in range(reach + 1):
            m.arc(base + k, (NEGATION,), base + reach)
            m.arc(base + k, (OTHER, TARGET, REPORT), base + max(0, k - 1))
            m.arc(base + k, ATTACK, 10 + k - 1 if k else 20)
            if base:
                m.mark(base + k, "negation")
    return m


def report_machine() -> Machine:
    """1: a reporting verb came; 2: and attacks after it only; 3: an attack before it."""
    return Machine().arc(0, ATTACK, 3).arc(0, (REPORT,), 1).arc(1, ATTACK, 2).mark(2, "report")


@cache
def grammar() -> tuple[list[list[int]], list[frozenset[str]]]:
    made = insult_machine()
    for m in (threat_machine(), target_machine(), negation_machine(), report_machine()):
        made = made.compose(m)
    return made.table()


def pattern(marks: frozenset[str]) -> frozenset[str] | None:
    """What counts of a clause's marks: None where neither an insult nor a threat matched."""
    return marks if marks & {"insult", "threat"} else None


def weight(marks: frozenset[str], weights: dict[str, float]) -> float:
    """The logarithm that a pattern adds to its strongest insult."""
    found = sum(weights[m] for m in ("negation", "report") if m in marks)
    if "insult" in marks:
        found += weights["target"] if "target" in marks else 0.0
    return found + (weights["threat"] if "threat" in marks else 0.0)


class Scorer:
    """Sums the weights of the matched clauses of a text."""

    def __init__(self, insults: dict[str, float], weights: dict[str, float] | None = None):
        self.insults, self.cache = insults, {}
        self.rows, marks = grammar()
        self.patterns = [pattern(m) for m in marks]
        self.weights = [weight(m, weights or PRIOR) for m in marks]
        self.closed = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws.split()}

    def classify(self, word: str) -> tuple[int, float]:
        if word in self.insults:
            return INSULT, self.insults[word]
        for n in STEMS:
            if len(word) > n and (w := self.insults.get(word[:n] + "*")) is not None:
                return INSULT, w
        return self.closed.get(word, OTHER), 0.0

    def matches(self, text: str) -> Iterator[tuple[frozenset[str], float]]:
        """(pattern, score) of each clause that matches."""
        cache, kinds = self.cache, []
        for u in _UNIT.findall(text.lower()):
            k = cache.get(u)
            if k is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                k = cache[u] = (-1, 0.0) if u in _END else self.classify(u)
            kinds.append(k)
        if not any(k[0] == INSULT or k[0] == THREAT for k in kinds):
            return
        rows, state, best = self.rows, 0, -math.inf
        for kind, w in (*kinds, (-1, 0.0)):
            if kind < 0:
                found = self.patterns[state]
                if found is not None:
                    yield found, math.exp((best if "insult" in found else 0.0) + self.weights[state])
                state, best = 0, -math.inf
                continue
            state = rows[state][kind]
            if kind == INSULT and w > best:
                best = w

    def clauses(self, text: str) -> float:
        return math.fsum(x for _, x in self.matches(text))


def _held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def _features(text: str) -> set[str]:
    found = set()
    for w in set(_UNIT.findall(text.lower())) - _END:
        if len(w) <= 24:
            found.add(w)
        for n in STEMS:
            if len(w) > n:
                found.add(w[:n] + "*")
    return found


def choose_features(counts: list[tuple[str, int, int]], pos: int, neg: int) -> dict[str, float]:
    """feature -> log weight, from (feature, toxic documents, other documents)."""
    rate = pos / max(1, pos + neg)
    good = {}
    for f, p, n in counts:
        share = p / (p + n)
        if share < LEAST_PRECISION or not 0 < rate < 1:
            continue
        ratio = 2 * (p * math.log(share / rate) + (n * math.log((1 - share) / (1 - rate)) if n else 0))
        if ratio >= LEAST_RATIO:
            good[f] = math.log((p + 0.5) / (p + n + 1))
    return good


def choose_weights(counts: dict[tuple[frozenset[str], int], int]) -> dict[str, float]:
    """The weight of each mark, from the numbers of matched clauses by (pattern, label)."""
    found = {}
    for m, prior in PRIOR.items():
        # threats are held against insults, the others against insults without the mark
        own = [(p, y, n) for (p, y), n in counts.items() if m in p and ("insult" in p or m == "threat")]
        rest = [(p, y, n) for (p, y), n in counts.items() if m not in p and "insult" in p]
        total = lambda rows, label: sum(n for _, y, n in rows if y == label)
        cells = [total(rows, y) + 0.5 for rows in (own, rest) for y in (1, 0)]
        if not own or not rest:
            found[m] = prior
            continue
        gain, variance = math.log(cells[0] * cells[3] / (cells[1] * cells[2])), sum(1 / c for c in cells)
        found[m] = (gain / variance + prior / PRIOR_VARIANCE) / (1 / variance + 1 / PRIOR_VARIANCE)
    return found


@dataclass
class Model:
    insults: dict[str, float]
    weights: dict[str, float]
    scale: float


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Lexicon, weights and scale, from labelled training rows only; copies of a text with one label count once."""
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~_held_out(F.col("id")))
    some = lab.orderBy(F.xxhash64("id"), "id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = materialise(text.join(F.broadcast(some), "id").select("text", "y").distinct())  # at most `rows` short rows are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        docs_of = [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_of[y] += 1
                tally[y].update(_features(t))
            if len(tally[0]) + len(tally[1]) > 400_000:
                yield from _rows(tally)
                tally = (Counter(), Counter())
        yield from _rows(tally)
        yield pa.RecordBatch.from_pydict({"f": ["\n"], "p": [docs_of[1]], "n": [docs_of[0]]})

    def _rows(tally: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        fs = sorted(tally[0].keys() | tally[1].keys())
        if fs:
            yield pa.RecordBatch.from_pydict({"f": fs, "p": [tally[1][f] for f in fs], "n": [tally[0][f] for f in fs]})

    counts = sample.mapInArrow(count, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # a feature of the sample in at least three toxic documents and hardly others: a bounded number, as the sample is
    kept = counts.where(f"f = '\n' OR (p >= 3 AND p >= {LEAST_PRECISION} * (p + n))").collect()
    pos, neg = next(((r.p, r.n) for r in kept if r.f == "\n"), (0, 0))
    insults = choose_features([(r.f, r.p, r.n) for r in kept if r.f != "\n"], pos, neg)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, tally = Scorer(insults), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.update((" ".join(sorted(p)), y) for p, _ in scorer.matches(t))
        yield pa.RecordBatch.from_pydict({"pattern": [p for p, _ in tally], "y": pa.array([y for _, y in tally], pa.int32()), "n": list(tally.values())} if tally else {"pattern": pa.array([], pa.string()), "y": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})

    by_pattern = sample.mapInArrow(patterns, "pattern string, y int, n long").groupBy("pattern", "y").agg(F.sum("n").alias("n")).collect()  # a few dozen
    weights = choose_weights({(frozenset(r.pattern.split()), r.y): r.n for r in by_pattern})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(insults, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.clauses(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], names=["s", "y"])

    seen = sample.mapInArrow(sums, "s double, y int").groupBy(F.round("s", 2).alias("s"), "y").agg(F.count("*").alias("n")).collect()  # no more rows than the sample
    return Model(insults, weights, _scale([(r.s, r.y) for r in seen for _ in range(r.n)]))


def _scale(seen: list[tuple[float, int]]) -> float:
    """The half-score sum, so that a text at the best cut of the sample gets the threshold as its score."""
    total, best, cut, tp, fp = sum(y for _, y in seen), 0.0, 0.5, 0, 0
    order = sorted(seen, reverse=True)
    for i, (s, y) in enumerate(order):
        tp, fp = tp + y, fp + 1 - y
        if s > 0 and (i + 1 == len(order) or order[i + 1][0] < s) and (f1 := 2 * tp / (tp + fp + total)) > best:
            following = order[i + 1][0] if i + 1 < len(order) else 0.0
            best, cut = f1, (s + following) / 2
    return cut * (1 - THRESHOLD) / THRESHOLD


def score(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score at least 0.3).

    A null or empty text scores 0, as does any text without a clause that matches. Without usable labels
    only threats match. Repeated rows are scored alike; a null id isn't held out; an empty table gives an empty
    result; other columns are never read.
    """
    model = learn(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.insults, model.weights)
        for batch in batches:
            sums = [scorer.clauses(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s / (s + model.scale) for s in sums], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
