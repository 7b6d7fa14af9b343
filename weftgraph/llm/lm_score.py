"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and of all pairs of neighbouring words are gathered from the training texts and quantised on a
log scale. An n-gram of level q is put into the filter once for each level 1..q, so its quantised count is found by
probing level after level until one is missing.

The filter has `BITS_PER_ENTRY` bits for each entry, however many there are, so it grows with the corpus and can't be
broadcast whole. N-grams that hold at least one token in `HOT_SHARE` (at most so many words and so many pairs can)
have a filter of their own, which is broadcast: a few megabytes at any size of the corpus. The others lie in segments
by key, rows of a table of about `SEGMENT_KEYS` keys each. The texts are coded once, a block of texts at a time; a
block's distinct keys that the broadcast filter doesn't have are joined with the segments, probed there, and the
levels go back to the block. So texts are read once, work is in proportion to them, and nothing is left out.

Probabilities are interpolated: a word's unigram probability is the mean count of its level, less an absolute
discount, over all tokens; what is discounted is the probability of an unknown word. After a known word, the pair's
discounted share of that word's count is added to the unigram probability times the mass that discounting took from
pairs. Both discounts are estimated from the numbers of n-grams that occur once and twice.

The base score needs exact counts of words. They are kept beside the filter's segments by the words' 64-bit hashes and
go back to the blocks in the same join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import materialise

HASHES, BITS_PER_ENTRY, LEVEL_BASE = 3, 10, 1.5
HOT_SHARE = 1 << 17
#: Distinct keys of all blocks per segment, and characters of texts per block: what a task holds at once.
SEGMENT_KEYS, BLOCK_CHARS = 1 << 20, 8_000_000

PAIR_BITS = 48
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.unique(np.ceil(LEVEL_BASE ** np.arange(108) - 1e-9))

CODED = "block long, ids array<long>, held binary, keys binary, idx binary, n_keys long, n_train long, n_texts long"


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


END_KEY, START_KEY = word_key(b""), word_key(b"\n")  # no word is empty or holds white space


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of one, one more for each step by the factor LEVEL_BASE that contains whole counts."""
    return np.searchsorted(_STEPS, counts, "right").astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of pairs of words, given by the words' keys."""
    return _mixed(first * _MIX + second + np.uint64(1)) >> np.uint64(64 - PAIR_BITS)


def _pack(values: np.ndarray) -> bytes:
    """As few bytes a value as the greatest one needs, how many comes first; all lowest bytes, then all next ones."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpack(raw: bytes | None) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, then the steps from one to the next."""
    return keys[:1].astype("<u8").tobytes() + _pack(np.diff(keys))


def _unpack_keys(raw: bytes | None) -> np.ndarray:
    if not raw or len(raw) < 9:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1), _unpack(raw[8:]))), dtype=np.uint64)


class LogFrequencyFilter:
    """Quantised counts of words and pairs by repeated membership probes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.size = bits, 8 * len(bits)

    @staticmethod
    def positions(keys: np.ndarray, at_level: int, pairs: bool, size: int) -> Iterator[np.ndarray]:
        h = _mixed(keys + np.uint64((2 * at_level + pairs) * int(_MIX) & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (((h + np.uint64(i) * step) % np.uint64(size)).astype(np.int64) for i in range(HASHES))

    @classmethod
    def build(cls, words: np.ndarray, word_levels: np.ndarray, pairs: np.ndarray, pair_levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> LogFrequencyFilter:
        entries = int(word_levels.sum(dtype=np.int64) + pair_levels.sum(dtype=np.int64))
        size = 8 * max(8, -(-entries * bits_per_entry // 8))
        bits = np.zeros(size, bool)
        for keys, levels, kind in ((words, word_levels, False), (pairs, pair_levels, True)):
            for j in range(1, int(levels.max(initial=0)) + 1):
                keys, levels = keys[levels >= j], levels[levels >= j]
                for at in cls.positions(keys, j, kind, size):
                    bits[at] = True
        return cls(np.packbits(bits, bitorder="little"))

    def levels(self, keys: np.ndarray, pairs: bool) -> np.ndarray:
        found, left, j = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1
        while len(left) and j <= len(_STEPS):
            there = np.ones(len(left), bool)
            for at in self.positions(keys[left], j, pairs, self.size):
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[there]
            found[left] = j
            j += 1
        return found


@dataclass
class Model:
    """What all workers get; its size has a fixed bound."""

    tokens: int
    kinds: int
    texts: int
    segments: int
    hot: LogFrequencyFilter
    least_hot: int  # the level that hot n-grams have at least
    hot_keys: np.ndarray  # words, ascending
    hot_counts: np.ndarray
    unigram: np.ndarray  # probabilities by level; level 0 is the unknown word
    word_mean: np.ndarray  # mean counts by level
    pair_mean: np.ndarray
    pair_discount: float
    reserved: float  # the mass that the discount takes from pairs

    def shift(self, bits: int) -> np.uint64:
        return np.uint64(bits - (self.segments.bit_length() - 1))

    def hot_levels(self, keys: np.ndarray, pairs: bool) -> np.ndarray:
        """Levels of hot n-grams; 0 for others, also where a probe or two are false."""
        found = self.hot.levels(keys, pairs)
        return np.where(found >= self.least_hot, found, 0).astype(np.uint8)


class Block:
    """Some texts, coded: the keys of their words by number, and the texts one after the other, each with its end."""

    def __init__(self, keys: bytes, idx: bytes, held: bytes):
        self.keys = np.frombuffer(keys, "<u8")
        self.idx = _unpack(idx).astype(np.int64)
        ends = np.flatnonzero(self.idx == 0)
        self.held = np.frombuffer(held, bool)
        self.sizes = np.diff(ends, prepend=-1)
        self.starts = ends - self.sizes + 1
        self.prev = np.concatenate(([0], self.idx[:-1])) if len(self.idx) else self.idx
        before = self.keys[self.prev]
        before[self.starts] = START_KEY
        self.pairs, self.pair = np.unique(pair_keys(before, self.keys[self.idx]), return_inverse=True)

    def train_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each word and of each pair in training texts."""
        train = np.repeat(~self.held, self.sizes).astype(np.float64)
        return np.bincount(self.idx, train, len(self.keys)).astype(np.int64), np.bincount(self.pair, train, len(self.pairs)).astype(np.int64)


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def code(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of texts; words are numbered by falling frequency within it, 0 is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start, texts in groups(batch.column(2), block_chars):
                words = [t.encode("utf-8").lower().split() for t in texts]
                number: dict[bytes, int] = {b"": 0}
                idx = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in (*ws, b"")), np.int64, sum(map(len, words)) + len(words))
                order = np.concatenate(([0], 1 + np.argsort(-np.bincount(idx, minlength=len(number))[1:], kind="stable")))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                keys = np.fromiter(map(word_key, number), np.uint64, len(number))[order]
                held = batch.column(1).slice(start, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
                values = [block, batch.column(0).slice(start, len(texts)).to_pylist(), held.tobytes(), keys.tobytes(), _pack(rank[idx]), len(keys) + len(idx), int(sizes[~held].sum()), int((~held).sum())]
                kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in CODED.split(", ")])
                block += 1

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), _held_out(F.col(id_col).cast("long")).alias("held"), text.alias("text")).mapInArrow(run, CODED)


def _by_segment(keys: np.ndarray, shift: np.uint64) -> dict[int, slice]:
    some, first = np.unique(keys >> shift if shift < 64 else np.zeros_like(keys), return_index=True)
    return {int(s): slice(a, b) for s, a, b in zip(some, first, [*first[1:].tolist(), len(keys)])}


def _segments(words: np.ndarray, pairs: np.ndarray, shifts: tuple[np.uint64, np.uint64]) -> Iterator[tuple[int, slice, slice]]:
    """(segment, place among words, place among pairs) of ascending keys."""
    w, p = _by_segment(words, shifts[0]), _by_segment(pairs, shifts[1])
    for s in sorted(w.keys() | p.keys()):
        yield s, w.get(s, slice(0)), p.get(s, slice(0))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def count(coded: DataFrame, segments: int, least_hot: int, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """The table of segments: filter, exact counts of words, numbers of n-grams by level, and the hot n-grams."""
    shifts = tuple(np.uint64(b - (segments.bit_length() - 1)) for b in (64, PAIR_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["keys"], row["idx"], row["held"])
                n_words, n_pairs = b.train_counts()
                order = np.argsort(b.keys)
                order = order[n_words[order] > 0]
                words, n_words = b.keys[order], n_words[order]
                pairs, n_pairs = b.pairs[n_pairs > 0], n_pairs[n_pairs > 0]
                rows = [(s, _pack_keys(words[w]), _pack(n_words[w]), _pack_keys(pairs[p]), _pack(n_pairs[p])) for s, w, p in _segments(words, pairs, shifts)]
                yield pa.RecordBatch.from_pylist([dict(zip(("segment", "words", "n_words", "pairs", "n_pairs"), r)) for r in rows], pa.schema([("segment", pa.int32()), *((c, pa.binary()) for c in ("words", "n_words", "pairs", "n_pairs"))]))

    def segment(table: pa.Table) -> pa.Table:
        part = lambda c, read: [read(x) for x in table.column(c).to_pylist()]
        words, n_words = _summed(part("words", _unpack_keys), part("n_words", _unpack))
        pairs, n_pairs = _summed(part("pairs", _unpack_keys), part("n_pairs", _unpack))
        word_levels, pair_levels = level(n_words), level(n_pairs)
        made = LogFrequencyFilter.build(words, word_levels, pairs, pair_levels, bits)
        stats = []
        for kind, levels, n in ((0, word_levels, n_words), (1, pair_levels, n_pairs)):
            stats += [(kind, int(q), int((levels == q).sum()), int(n[levels == q].sum()), int((n[levels == q] == 1).sum()), int((n[levels == q] == 2).sum())) for q in np.unique(levels)]
        hot_w, hot_p = n_words >= least_hot, n_pairs >= least_hot
        row = {
            "segment": table.column("segment")[0].as_py(), "bits": made.bits.tobytes(), "words": _pack_keys(words), "n_words": _pack(n_words),
            "stats": [dict(zip(("kind", "q", "n", "s", "once", "twice"), x)) for x in stats],
            "hot_words": _pack_keys(words[hot_w]), "n_hot_words": _pack(n_words[hot_w]), "hot_pairs": _pack_keys(pairs[hot_p]), "n_hot_pairs": _pack(n_pairs[hot_p]),
        }
        return pa.Table.from_pylist([row], out_arrow)

    stat = pa.struct([(c, pa.int64()) for c in ("kind", "q", "n", "s", "once", "twice")])
    out_arrow = pa.schema([("segment", pa.int32()), ("bits", pa.binary()), ("words", pa.binary()), ("n_words", pa.binary()), ("stats", pa.list_(stat)), *((c, pa.binary()) for c in ("hot_words", "n_hot_words", "hot_pairs", "n_hot_pairs"))])
    split = coded.where("n_train > 0").mapInArrow(run, "segment int, words binary, n_words binary, pairs binary, n_pairs binary")
    stats = "stats array<struct<kind: long, q: long, n: long, s: long, once: long, twice: long>>"
    return split.groupBy("segment").applyInArrow(segment, f"segment int, bits binary, words binary, n_words binary, {stats}, hot_words binary, n_hot_words binary, hot_pairs binary, n_hot_pairs binary")


def learn(coded: DataFrame, bits: int = BITS_PER_ENTRY, hot_share: int = HOT_SHARE, segment_keys: int = SEGMENT_KEYS) -> tuple[Model, DataFrame]:
    """The model and its table of segments, from the training texts of a coded table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    head = coded.agg(total("n_keys"), total("n_train"), total("n_texts")).first()
    segments = 1 << max(0, math.ceil(math.log2(max(1, head.n_keys / segment_keys))))
    tokens, least_hot = head.n_train, max(1, -(-head.n_train // hot_share))
    table = materialise(count(coded, segments, least_hot, bits))
    levels = table.select(F.explode("stats").alias("t")).select("t.*").groupBy("kind", "q").agg(*[F.sum(c).alias(c) for c in ("n", "s", "once", "twice")]).collect()
    top = max((r.q for r in levels), default=0)
    of_kind = lambda k: [r for r in levels if r.kind == k]

    def discount(rows: list) -> float:
        once, twice = sum(r.once for r in rows), sum(r.twice for r in rows)
        return once / (once + 2 * twice) if once else 0.0

    def means(rows: list) -> np.ndarray:
        x = np.zeros(top + 2)
        for r in rows:
            x[r.q] = r.s / r.n
        for q in range(top, 0, -1):  # a level that no n-gram has: met by a false probe only
            x[q] = x[q] or x[q + 1]
        return x

    words, pairs = of_kind(0), of_kind(1)
    kinds, pair_kinds = sum(r.n for r in words), sum(r.n for r in pairs)
    word_mean, pair_mean, off, pair_off = means(words), means(pairs), discount(words), discount(pairs)
    unigram = np.maximum(word_mean - off, 0) / max(1, tokens)
    unigram[0] = max(off * kinds / max(1, tokens), 1 / (tokens + kinds + 1))
    # at most hot_share words and as many pairs, whatever the corpus
    hot = table.where("length(hot_words) > 8 OR length(hot_pairs) > 8").select("hot_words", "n_hot_words", "hot_pairs", "n_hot_pairs").collect()
    joined = lambda c, read: np.concatenate([np.zeros(0, np.uint64), *(read(r[c]) for r in hot)])
    hot_words, n_hot, hot_pairs, n_hot_pairs = joined("hot_words", _unpack_keys), joined("n_hot_words", _unpack), joined("hot_pairs", _unpack_keys), joined("n_hot_pairs", _unpack)
    order = np.argsort(hot_words)
    made = LogFrequencyFilter.build(hot_words, level(n_hot), hot_pairs, level(n_hot_pairs), bits)
    model = Model(
        tokens, kinds, head.n_texts, segments, made, int(level(np.array([least_hot]))[0]), hot_words[order], n_hot[order].astype(np.int64),
        unigram, word_mean, pair_mean, pair_off, pair_off * pair_kinds / max(1, tokens),
    )
    return model, table


def probabilities(m: Model, before: np.ndarray, pair_level: np.ndarray, word_level: np.ndarray) -> np.ndarray:
    """log10 of each token's probability, from the count of the word before it (0: unknown) and quantised counts."""
    p = m.unigram[word_level]
    known = before > 0
    pair = np.where(pair_level > 0, np.maximum(m.pair_mean[pair_level] - m.pair_discount, 0), 0.0)
    return np.log10(np.maximum(np.where(known, np.minimum(1, pair / np.maximum(before, 1)) + max(m.reserved, 1e-9) * p, p), 1e-300))


def score_block(m: Model, b: Block, words: np.ndarray, word_levels: np.ndarray, pair_levels: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: n_tokens, n_known, base_score, score; `words` are exact counts by number."""
    before = m.word_mean[word_levels][b.prev]
    before[b.starts] = m.texts
    log_p = probabilities(m, before, pair_levels[b.pair], word_levels[b.idx])
    add = lambda x: np.add.reduceat(x, b.starts)
    base = np.log10(words + 1.0)[b.idx]
    return {"n_tokens": b.sizes, "n_known": add((words > 0).astype(np.int64)[b.idx]), "base_score": add(base) - b.sizes * math.log10(m.tokens + m.kinds + 1), "score": add(log_p)}


def score_coded(coded: DataFrame, m: Model, table: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all texts of a coded table."""
    shared = coded.sparkSession.sparkContext.broadcast(m)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["keys"], row["idx"], row["held"])
                words = np.sort(b.keys)
                words = words[m.hot_levels(words, False) == 0]
                pairs = b.pairs[m.hot_levels(b.pairs, True) == 0]
                rows = [{"segment": s, "block": row["block"], "words": _pack_keys(words[w]), "pairs": _pack_keys(pairs[p])} for s, w, p in _segments(words, pairs, (m.shift(64), m.shift(PAIR_BITS)))]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())]))

    answer_arrow = pa.schema([("block", pa.int64()), ("segment", pa.int32()), ("n_words", pa.binary()), ("word_levels", pa.binary()), ("pair_levels", pa.binary())])

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        held = next((r for r in rows if r["block"] is None), None)
        bits = LogFrequencyFilter(np.frombuffer(held["bits"], np.uint8)) if held else None
        known, counts = (np.append(_unpack_keys(held["words"]), np.uint64(0)), np.append(_unpack(held["n_words"]), np.uint64(0))) if held else (None, None)
        out = []
        for r in rows:
            if r["block"] is None:
                continue
            words, pairs = _unpack_keys(r["words"]), _unpack_keys(r["pairs"])
            if held:
                at = np.searchsorted(known[:-1], words)
                n = np.where(known[at] == words, counts[at], 0)
                q, r2 = bits.levels(words, False), bits.levels(pairs, True)
            else:
                n, q, r2 = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint8), np.zeros(len(pairs), np.uint8)
            out.append({"block": r["block"], "segment": r["segment"], "n_words": _pack(n), "word_levels": q.tobytes(), "pair_levels": r2.tobytes()})
        return pa.Table.from_pylist(out, answer_arrow)

    def finish(group: pa.Table) -> pa.Table:
        m = shared.value
        rows = group.to_pylist()
        own = next(r for r in rows if r["segment"] is None)
        answers = sorted((r for r in rows if r["segment"] is not None), key=lambda r: r["segment"])
        b = Block(own["keys"], own["idx"], own["held"])
        joined = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        order = np.argsort(b.keys)
        levels, counts = np.zeros(len(order), np.uint8), np.zeros(len(order), np.int64)
        hot = m.hot_levels(b.keys[order], False)
        asked = order[hot == 0]
        levels[order] = hot
        levels[asked] = joined((np.frombuffer(r["word_levels"], np.uint8) for r in answers), np.uint8)
        if len(m.hot_keys):
            at = np.minimum(np.searchsorted(m.hot_keys, b.keys), len(m.hot_keys) - 1)
            counts = np.where(m.hot_keys[at] == b.keys, m.hot_counts[at], 0)
        counts[asked] = joined((_unpack(r["n_words"]) for r in answers), np.uint64).astype(np.int64)
        pair_levels = m.hot_levels(b.pairs, True)
        pair_levels[pair_levels == 0] = joined((np.frombuffer(r["pair_levels"], np.uint8) for r in answers), np.uint8)
        s = score_block(m, b, counts, levels, pair_levels)
        return pa.table({"doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array(b.held), **{k: pa.array(v) for k, v in s.items()}})

    null = lambda kind: F.lit(None).cast(kind)
    asks = coded.mapInArrow(ask, "segment int, block long, words binary, pairs binary").select("segment", "block", "words", "pairs", null("binary").alias("bits"), null("binary").alias("n_words"))
    shards = table.select("segment", null("long").alias("block"), "words", null("binary").alias("pairs"), "bits", "n_words")
    answers = asks.unionByName(shards).groupBy("segment").applyInArrow(answer, "block long, segment int, n_words binary, word_levels binary, pair_levels binary")
    own = coded.select("block", null("int").alias("segment"), *[null("binary").alias(c) for c in ("n_words", "word_levels", "pair_levels")], "ids", "held", "keys", "idx")
    answers = answers.select("*", null("array<long>").alias("ids"), *[null("binary").alias(c) for c in ("held", "keys", "idx")])
    out = answers.unionByName(own).groupBy("block").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty: one end token. A null id is never held out. Repeated rows are scored alike. An
    empty table gives an empty result; other columns are ignored. Without training documents every word is
    unknown. Two words with one 64-bit hash count as one word.
    """
    coded = materialise(code(docs, id_col, text_col))
    return score_coded(coded, *learn(coded))
