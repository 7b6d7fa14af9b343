"""Token ids in files, compressed by a Re-Pair grammar.

The documents are dealt out in ranges of doc_id and sorted. A shard is a run of documents of about `SHARD_TOKENS`
ids, the bound on what a task holds, and has a grammar of its own: frequent id pairs are replaced by nonterminals,
round after round, until no pair occurs `LEAST_USES` times without overlaps. A round replaces many pairs at once;
where occurrences of different pairs overlap the more frequent pair wins, so the most frequent one of a round is
replaced wherever it occurs, as in the sequential algorithm.

A shard stores its rules, the length that each nonterminal expands to, the remaining sequence, and for every
`SAMPLE`-th symbol of it how many ids lie before. A document is found by searching these samples, and only the
symbols that cover it (and of those only the rules that reach into it) are expanded.

The files are rows of a Parquet table in the shared folder, one row a shard with the least and greatest doc_id, by
which other shards are skipped. They are committed like any Spark output: a task that is lost is written again, and
any store that Spark reaches will do.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import GROUP_CHARS, byte_bpe, forget, groups, tokenizer_path
from .common import partition_count, shared_dir

END_ID = 0
SHARD_TOKENS = 1 << 20
LEAST_USES = 8
SAMPLE = 256
#: Bytes of a row group of the files: a few shards, so that a look-up reads little.
ROW_GROUP = 8 << 20

FILE_SCHEMA = (
    "part int, shard int, before long, base int, first_id long, last_id long, doc_ids array<long>, ends array<long>, "
    "left binary, right binary, lengths binary, symbols binary, samples binary"
)


def _pack(values: np.ndarray) -> bytes:
    """Two bytes a value where they fit; the first byte says how many."""
    wide = len(values) and int(values.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + values.astype("<u4" if wide else "<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype(np.int32)


def _grouped(seq: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The places `at` in order of their pairs, ascending within a pair, and where each pair begins."""
    width, place = most.bit_length(), len(seq).bit_length()
    key = (seq[at].astype(np.uint64) << np.uint64(width)) | seq[at + 1]
    if 2 * width + place <= 64:
        key = np.sort((key << np.uint64(place)) | at.astype(np.uint64))
        at = (key & np.uint64((1 << place) - 1)).astype(np.int64)
        key >>= np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    return at, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])


def compress(ids: np.ndarray, base: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, length, sequence): rule i replaces the pair (left[i], right[i]) by the symbol base + i.

    Goes on until no pair is left that occurs `least` times without overlaps. Counts are exact: after the first
    round only pairs with a new symbol can have become frequent, and frequent pairs that lost to others are kept
    in view, so a round looks at those places alone.
    """
    seq, most = ids.astype(np.uint32), base + len(ids) // 2 + 1
    size = np.ones(0, np.int64)
    left, right, rules = [], [], 0
    active = np.arange(max(0, len(seq) - 1))
    while len(active):
        at, first = _grouped(seq, active, most)
        count = np.diff(first, append=len(at))
        if count.max() < least:
            break
        twin = np.flatnonzero((count >= least) & (seq[at[first]] == seq[at[first] + 1]))
        alive = np.ones(len(at), bool)
        for g in twin.tolist():  # runs of one symbol: every other place, without overlaps
            mine = slice(first[g], first[g] + count[g])
            begins = np.flatnonzero(np.diff(at[mine], prepend=-2) > 1)
            run = np.arange(count[g]) - np.repeat(begins, np.diff(begins, append=count[g]))
            alive[mine] = run % 2 == 0
            count[g] = int(alive[mine].sum())
        chosen = np.flatnonzero(count >= least)
        if not len(chosen):
            break
        # the rank of each frequent pair, greater for more uses; every place but those that overlap a greater one
        rank = np.zeros(len(first), np.int32)
        rank[chosen[np.argsort(count[chosen], kind="stable")]] = np.arange(1, len(chosen) + 1)
        of_place = np.repeat(rank, np.diff(first, append=len(at)))
        at, of_place, alive = (x[of_place > 0] for x in (at, of_place, alive))
        by_place = np.zeros(len(seq) + 1, np.int32)
        by_place[at] = of_place
        view = by_place > 0  # places that go on: frequent ones that are passed over now
        by_place[at[~alive]] = 0
        spot = np.flatnonzero(by_place)
        mine = by_place[spot]
        take = (mine > by_place[spot + 1]) & ((mine > by_place[spot - 1]) | (spot == 0))
        used = np.bincount(mine[take], minlength=len(chosen) + 1) >= least
        take &= used[mine]
        won = spot[take]
        number = np.cumsum(used) - 1
        made = number[by_place[won]]
        pair_at = np.zeros(int(used.sum()), np.int64)
        pair_at[made] = won
        x, y = seq[pair_at], seq[pair_at + 1]
        left.append(x)
        right.append(y)
        wide = lambda s: np.where(s < base, 1, size[np.maximum(s.astype(np.int64) - base, 0)]) if len(size) else np.ones(len(s), np.int64)
        size = np.concatenate((size, wide(x) + wide(y)))
        seq[won] = (base + rules + made).astype(np.uint32)
        rules += len(x)
        # and the new symbols with their neighbours
        view[won] = True
        view[won - 1] = True  # of place 0 that is the last one, which is cut off
        view[-1] = False
        stay = np.ones(len(seq), bool)
        stay[won + 1] = False
        # a pair that began at a swallowed symbol begins at the new one now
        seq, active = seq[stay], np.flatnonzero(view[:-1][stay])
        active = active[active < len(seq) - 1]
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return joined(left), joined(right), size, seq


class Grammar:
    """The rules of a shard; expands symbols to ids."""

    def __init__(self, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray):
        self.base, self.left, self.right, self.lengths = base, left, right, lengths

    def size(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        ours = symbols >= self.base
        out[ours] = self.lengths[symbols[ours] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols, from a table with the ids of every rule if that is no longer than the result."""
        size = self.size(symbols)
        ends = np.cumsum(size)
        if not len(symbols) or int(self.lengths.sum()) > ends[-1]:
            return self._spread(symbols)
        every = np.arange(self.base + len(self.lengths), dtype=symbols.dtype)
        width = self.size(every)
        begin = np.cumsum(width) - width
        return self._spread(every)[np.arange(ends[-1]) + np.repeat(begin[symbols] - (ends - size), size)]

    def _spread(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols: each pass places the ids and splits what is still a nonterminal into its two sides."""
        size = self.size(symbols)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), symbols.dtype)
        while len(symbols):
            ours = symbols >= self.base
            out[at[~ours]] = symbols[~ours]
            rule, at = symbols[ours] - self.base, at[ours]
            left = self.left[rule]
            symbols, at = np.concatenate((left, self.right[rule])), np.concatenate((at, at + self.size(left)))
        return out

    def between(self, symbols: list[int], begin: int, end: int) -> list[int]:
        """The ids from `begin` to before `end` of the symbols' expansion; rules outside are not looked at."""
        out: list[int] = []
        at, todo = 0, symbols[::-1]
        while todo and at < end:
            s = todo.pop()
            n = 1 if s < self.base else int(self.lengths[s - self.base])
            if at + n <= begin:
                at += n
            elif s < self.base:
                out.append(s)
                at += 1
            else:
                todo += [int(self.right[s - self.base]), int(self.left[s - self.base])]
        return out


def sample_offsets(base: int, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """How many ids lie before every SAMPLE-th symbol."""
    size = np.ones(len(symbols), np.int64)
    ours = symbols >= base
    size[ours] = lengths[symbols[ours].astype(np.int64) - base]
    return (np.cumsum(size) - size)[::SAMPLE].astype(np.uint32)


class Shard:
    """One stored shard: random access to its documents. `ends` are the ids up to the end of each document."""

    def __init__(self, base: int, ends: list[int], left: bytes, right: bytes, lengths: bytes, symbols: bytes, samples: bytes):
        self.grammar = Grammar(base, _unpack(left), _unpack(right), _unpack(lengths))
        self.symbols, self.samples, self.ends = _unpack(symbols), _unpack(samples), ends

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def document(self, k: int) -> list[int]:
        """The ids of the k-th document, from the samples around it."""
        begin, end = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        low = max(0, int(np.searchsorted(self.samples, begin, "right")) - 1)
        high = int(np.searchsorted(self.samples, end, "left"))
        before = int(self.samples[low])
        return self.grammar.between(self.symbols[low * SAMPLE : high * SAMPLE].tolist(), begin - before, end - before)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all texts, each with the end id behind it, in ascending order of doc_id.

    A null text counts as empty; null ids come first; rows that repeat an id stay, in no fixed order.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(tokenizer), TaskContext.get().partitionId()
        base, end = len(bpe.pieces), np.array([END_ID], "<u4").tobytes()
        shard, before, doc_ids, ends, raw, held = 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            left, right, lengths, seq = compress(np.frombuffer(b"".join(raw), "<u4"), base)
            known = [i for i in doc_ids if i is not None]
            values = [part, shard, before, base, min(known, default=None), max(known, default=None), doc_ids, ends, *map(_pack, (left, right, lengths, seq, sample_offsets(base, lengths, seq)))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for start, texts in groups(batch.column(1), GROUP_CHARS):
                for i, ids in zip(batch.column(0).slice(start, len(texts)).to_pylist(), bpe.encode_many(texts)):
                    doc_ids.append(i)
                    raw += [ids, end]
                    held += len(ids) // 4 + 1
                    ends.append(held)
                    if held >= shard_tokens:
                        yield row()
                        shard, before, doc_ids, ends, raw, held = shard + 1, before + held, [], [], [], 0
        if doc_ids:
            yield row()

    parts = parts or partition_count(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def _shard(row: dict) -> Shard:
    return Shard(*(row[k] for k in ("base", "ends", "left", "right", "lengths", "symbols", "samples")))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; start counts all ids before it."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect()}  # a row per part
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part], total = total, total + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # this worker may have encoded before
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw, ends = _shard(row).all().astype("<u4").tobytes(), np.array(row["ends"])
                sizes = np.diff(ends, prepend=0)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                begin = starts[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(begin + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of a document by random access: one list per row with this id, the end id included.

    Rows that repeat an id come in the order of the files; an id that isn't there, or an empty table, gives an
    empty list. Rows with a null id can only be read by `read_ids`.
    """
    found = spark.read.schema(FILE_SCHEMA).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "shard")
    out = []
    for r in found.collect():  # shards that hold the id: one, or a few where it repeats
        ids, shard = r.doc_ids, _shard(r.asDict())
        nulls = next((k for k, i in enumerate(ids) if i is not None), len(ids))
        out += [shard.document(k) for k in range(bisect_left(ids, doc_id, nulls), bisect_right(ids, doc_id, nulls))]
    return out


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files of docs to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    An empty table gives an empty result; other columns of docs are ignored.
    """
    path = f"{shared_dir(docs.sparkSession)}/weft-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(docs.sparkSession, path)
