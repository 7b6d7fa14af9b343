"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds, for each term, the items that contain it with their BM25 impacts, in blocks of items with the
block's largest impact. Impacts are divided by the item's threshold (a share of the score that the item's own text
gets), so that "above threshold" is a score of 1 for every item. Items are indexed by length: a passage is a window of
two strides, and the stride of an index is the power of two that its items fit in, so every occurrence of an item lies
whole in some window and a long item widens the windows of no other.

Block-max WAND in two steps. For all windows of a batch at once: the terms of a window whose maxima together stay under
1 can't make a hit by themselves, so only blocks that hold one of its other terms are looked at; of those the ones
stay where the block maxima of these terms and the maxima of the rest reach 1, and of these the ones where the block
maxima of all its terms do. What is left is searched document-at-a-time with cursors, a pivot by the terms' maxima, and
the block maxima to pass over blocks. Nothing above threshold is lost by any bound. Hits are verified on word n-grams,
the item's question and its answer separately.

Numbers of items with a term, of items, and their mean length are those of the whole benchmark, computed in Spark. The
index is held in sparse arrays and broadcast in passes of `INDEX_BYTES` of benchmark text each (mostly one); an item's
scores and hits don't depend on the pass it is in.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import groups
from .common import materialise

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage needs, and shares of n-grams of question and answer.
SHARE, QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.6, 0.5
BLOCK_ITEMS = 4
LEAST_STRIDE = 32
#: Bytes of benchmark text per pass: what a broadcast holds is in proportion to it.
INDEX_BYTES = 4_000_000
#: Sums of block maxima that are held at once.
MOST_SUMS = 4_000_000
#: Entries of a table of block maxima that a worker may hold beside the sparse arrays (8 bytes each).
MOST_DENSE = 1 << 20
#: Characters of documents whose windows are bounded at once.
GROUP_CHARS = 3_000_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence with a word is the answer; a text of one sentence is split at two thirds of its words."""
    parts = [t for t in map(terms, _SENTENCE.split(text)) if t]
    if not parts:
        return [], []
    if len(parts) == 1:
        cut = (2 * len(parts[0]) + 2) // 3
        return parts[0][:cut], parts[0][cut:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return set(zip(*[words[i:] for i in range(n)])) if n else set()


def stride_of(words: int) -> int:
    return max(LEAST_STRIDE, 1 << (words - 1).bit_length())


@dataclass
class Statistics:
    """What BM25 needs to know of the whole benchmark; df of the terms at hand at least."""

    items: int
    mean: float
    df: dict[str, int]

    @staticmethod
    def of(texts: list[str]) -> Statistics:
        words = [w for w in map(terms, texts) if w]
        return Statistics(len(words), sum(map(len, words)) / max(1, len(words)), Counter(t for w in words for t in set(w)))


class BlockMaxIndex:
    """BM25 impacts of items of one stride, divided by each item's threshold, with maxima by term and block."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics, vocab: dict[str, int], stride: int, share: float = SHARE, block: int = BLOCK_ITEMS):
        self.ids, self.block, self.stride = [i for i, _ in items], block, stride
        halves = [question_and_answer(t) for _, t in items]
        self.parts = [tuple(map(grams, h)) for h in halves]
        rows: list[tuple[int, int, float]] = []
        for i, (_, text) in enumerate(items):
            ws = terms(text)
            hits = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (stats.items - stats.df[w] + 0.5) / (stats.df[w] + 0.5))
                hits[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / stats.mean))
            least = share * math.fsum(hits.values())
            rows += [(vocab[w], i, x / least) for w, x in hits.items()]
        rows.sort()
        term = np.array([t for t, _, _ in rows], np.int64)
        self.item = np.array([i for _, i, _ in rows], np.int32)
        self.impact = np.array([x for _, _, x in rows])
        every = np.arange(len(vocab) + 1)
        self.first = np.searchsorted(term, every)  # of each term's postings
        keys, at = np.unique(term * (len(items) // block + 1) + self.item // block, return_index=True)
        self.blocks = (keys % (len(items) // block + 1)).astype(np.int32)
        self.maxima = np.maximum.reduceat(self.impact, at) if len(at) else self.impact
        self.first_block = np.searchsorted(keys // (len(items) // block + 1), every)  # of each term's blocks
        self.keys = keys  # term and block of each maximum, ascending
        self.term_max = np.zeros(len(vocab))
        np.maximum.at(self.term_max, term, self.impact)
        self._lists: dict[int, tuple[list[int], list[float], dict[int, float]]] = {}

    def postings(self, t: int) -> tuple[list[int], list[float], dict[int, float]]:
        """A term's items, their impacts, and its maxima by block."""
        if t not in self._lists:
            if len(self._lists) > 20_000:
                self._lists.clear()
            a, b = self.first[t : t + 2].tolist()
            c, d = self.first_block[t : t + 2].tolist()
            self._lists[t] = self.item[a:b].tolist(), self.impact[a:b].tolist(), dict(zip(self.blocks[c:d].tolist(), self.maxima[c:d].tolist()))
        return self._lists[t]

    def search(self, query: list[int], blocks: set[int] | None = None) -> list[tuple[int, float]]:
        """(item, score) of all items with a score of 1 or more; `blocks` holds those that may have some."""
        end = len(self.ids)
        held = {t: self.postings(t) for t in query}
        cursors = [[held[t][0][0], 0, t] for t in query if held[t][0]]
        peak = {t: float(self.term_max[t]) for t in query}
        found = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (at, _, t) in enumerate(cursors):
                if at >= end:
                    break
                bound += peak[t]
                if bound >= 0.9999:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if blocks is not None and block not in blocks or sum(held[t][2].get(block, 0.0) for _, _, t in cursors[: pivot + 1]) < 0.9999:
                # no item up to the end of this block can do with these terms alone; the next cursor may add to it
                upto = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][0])
                self._advance(held, cursors[: pivot + 1], max(upto, item + 1))
            elif cursors[0][0] == item:
                score = math.fsum(held[t][1][p] for _, p, t in cursors[: pivot + 1])
                if score >= 0.9999:
                    found.append((item, score))
                self._advance(held, cursors[: pivot + 1], item + 1)
            else:
                self._advance(held, cursors[:pivot], item)

    def _advance(self, held: dict[int, tuple], cursors: list[list[int]], item: int) -> None:
        end = len(self.ids)
        for c in cursors:
            if c[0] < item:
                items = held[c[2]][0]
                c[1] = bisect_left(items, item, c[1])
                c[0] = items[c[1]] if c[1] < len(items) else end

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and the answer's n-grams that the passage has."""
        shares = []
        for gs in self.parts[item]:
            n = len(next(iter(gs), ()))
            have = set(zip(*[passage[i:] for i in range(n)])) if n else set()
            shares.append(len(gs & have) / len(gs) if gs else 1.0)
        return shares[0], shares[1]

    def _bounds(self, number: np.ndarray, block: np.ndarray, start: np.ndarray, size: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The sums of the block maxima of all terms of each window, for pairs of windows and blocks."""
        n_blocks, out = len(self.ids) // self.block + 1, np.zeros(len(number))
        ends = np.cumsum(size[number])
        low = 0
        while low < len(number):  # bounded memory for the terms of the windows
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MOST_SUMS, "right")))
            w = size[number[low:high]]
            first = np.cumsum(w) - w
            t = term[np.arange(int(w.sum())) + np.repeat(start[number[low:high]] - first, w)]
            if self.table is not None:
                found = self.table[t, np.repeat(block[low:high], w)]
            else:
                key = t * n_blocks + np.repeat(block[low:high], w)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = np.where(self.keys[at] == key, self.maxima[at], 0.0)
            out[low:high] = np.add.reduceat(found, first)
            low = high
        return out

    @cached_property
    def table(self) -> np.ndarray | None:
        """The maxima by term and block where that is a small table; larger ones are searched in the sparse arrays."""
        n_blocks = len(self.ids) // self.block + 1
        if len(self.term_max) * n_blocks > MOST_DENSE:
            return None
        out = np.zeros((len(self.term_max), n_blocks))
        out[self.keys // n_blocks, self.keys % n_blocks] = self.maxima
        return out

    def candidates(self, window: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """(window, its terms, blocks that may hold a hit) from pairs in order of windows."""
        mine = self.term_max[term] > 0
        window, term = window[mine], term[mine]
        order = np.lexsort((self.term_max[term], window))
        term = term[order]
        peak = self.term_max[term]
        start = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1]))[: len(window)])
        size = np.diff(start, append=len(window))
        total = np.cumsum(peak)
        total -= np.repeat(total[start] - peak[start], size)  # of a window's terms up to here, low maxima first
        weak = total < 0.9998
        rest = np.add.reduceat(np.where(weak, peak, 0.0), start) if len(start) else total
        strong = np.flatnonzero(~weak)
        if not len(strong):
            return
        number = np.repeat(np.arange(len(start)), size)[strong]  # windows counted from 0
        width = (self.first_block[term[strong] + 1] - self.first_block[term[strong]]).astype(np.int64)
        cuts = np.searchsorted(np.cumsum(width), np.arange(MOST_SUMS, int(width.sum()) + MOST_SUMS, MOST_SUMS))
        low, n_blocks = 0, len(self.ids) // self.block + 1
        for cut in cuts.tolist():
            high = min(cut + 1, len(strong))
            while high < len(strong) and number[high] == number[high - 1]:  # whole windows
                high += 1
            if high <= low:
                continue
            w = width[low:high]
            at = np.repeat(self.first_block[term[strong[low:high]]] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
            key, back = np.unique(np.repeat(number[low:high], w) * n_blocks + self.blocks[at], return_inverse=True)
            bound = np.bincount(back, self.maxima[at]) + rest[key // n_blocks]
            key = key[bound >= 0.9998]
            key = key[self._bounds(key // n_blocks, key % n_blocks, start, size, term) >= 0.9998]
            blocks: dict[int, set[int]] = defaultdict(set)
            for n, b in zip((key // n_blocks).tolist(), (key % n_blocks).tolist()):
                blocks[n].add(b)
            for n, some in blocks.items():
                yield int(window[start[n]]), term[start[n] : start[n] + size[n]], some
            low = high

    def hits(self, words: list[list[str]], sizes: np.ndarray, tid: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share), the best window of each text and item.

        `tid` are the numbers of all words of the texts, one text after the other, -1 for words of no item.
        """
        stride = self.stride
        segs = np.maximum(1, (sizes + stride - 1) // stride)
        first = np.concatenate(([0], np.cumsum(segs)))  # of each text
        known = np.flatnonzero(tid >= 0)
        text = np.repeat(np.arange(len(words)), sizes)[known]
        seg = first[text] + (known - (np.cumsum(sizes) - sizes)[text]) // stride
        # a window is a stride and the next one; the last stride of a text is in the window before it
        ahead, behind = (seg < first[text + 1] - 1) | (segs[text] == 1), seg > first[text]
        n_terms = len(self.first) - 1
        pairs = np.sort(np.concatenate((seg[ahead] * n_terms + tid[known[ahead]], (seg[behind] - 1) * n_terms + tid[known[behind]])))
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)]]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for window, query, blocks in self.candidates(pairs // n_terms, pairs % n_terms):
            d = int(np.searchsorted(first, window, "right")) - 1
            begin = (window - int(first[d])) * stride
            passage = words[d][begin : begin + 2 * stride]
            for item, score in self.search(query.tolist(), blocks):
                q, a = self.verify(item, passage)
                if q >= QUESTION_SHARE and a >= ANSWER_SHARE and score > best.get((d, item), (0.0,))[0]:
                    best[d, item] = score, q, a
        for (d, item), (score, q, a) in best.items():
            yield d, item, score, q, a


class Benchmark:
    """The indexes of some items, one for each stride, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None):
        items = sorted((i, t) for i, t in items if terms(t))
        stats = stats or Statistics.of([t for _, t in items])
        self.vocab = {w: n for n, w in enumerate(sorted({w for _, t in items for w in terms(t)}))}
        by_stride: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, t in items:
            by_stride[stride_of(len(terms(t)))].append((i, t))
        self.indexes = [BlockMaxIndex(some, stats, self.vocab, stride) for stride, some in sorted(by_stride.items())]

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item_id, score, question share, answer share)."""
        look = self.vocab.get
        words = [terms(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tid = np.fromiter((look(w, -1) for ws in words for w in ws), np.int64, int(sizes.sum()))
        for index in self.indexes:
            for d, item, *shares in index.hits(words, sizes, tid):
                yield (d, index.ids[item], *shares)


def benchmarks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_bytes: int = INDEX_BYTES) -> Iterator[Benchmark]:
    """Indexes over parts of the benchmark, each of about `most_bytes` of text, with the statistics of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array(map(len, words), pa.int64())], names=["id", "t", "terms", "n"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    items = materialise(items.mapInArrow(run, "id long, t string, terms array<string>, n long").where("n > 0"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("size"), F.count("*").alias("items"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).first()
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    parts = math.ceil(total.size / most_bytes)
    df = materialise(df) if parts > 1 else df
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part) if parts > 1 else items
        some = df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi") if parts > 1 else df
        yield Benchmark([(r.id, r.t) for r in mine.select("id", "t").collect()], Statistics(total["items"], total.mean, {r.term: r.df for r in some.collect()}))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, score (1 is the threshold), and the shares
    of the question's and the answer's n-grams. Documents without a hit have no row.

    Null and empty texts and items match nothing; repeated documents or items are reported once each time they
    occur; empty tables give an empty result; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in benchmarks(benchmark):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, texts in groups(batch.column(1), GROUP_CHARS):
                    hits = list(shared.value.hits(texts))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([start + h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.int64()), *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]],
                        names=["doc_id", "item_id", "score", "question_share", "answer_share"],
                    )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a verified hit, all columns as they were; nothing is shuffled.

    Null and empty texts stay, repeated rows stay or go together, an empty table gives an empty result, and without
    items every row stays. No column is added, so names can't clash.
    """
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)
    for index in benchmarks(benchmark):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, texts in groups(batch.column(at), GROUP_CHARS):
                    clean[[start + h[0] for h in shared.value.hits(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
