"""Byte-level BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no vocabulary token can never be merged over, so merging on both sides of it goes on
independently: a merge joins two neighbours, the one across would make a token with the pair inside, and which merges
are made on one side doesn't depend on the other. The pairs are read off the vocabulary. A text may be cut between the
two bytes if the pre-tokenizer, too, splits the two parts as it splits the whole. That is so

* before ASCII white space that follows something else: there its pattern starts a new match in any case (no
  alternative holds white space after something else), and a run of white space loses at most a piece boundary at a
  pair that can't be merged anyway;
* between two letters or ASCII digits: between a letter and a digit a match ends in any case, and inside a run of one
  kind the parts are runs of that kind, as ` ?` and the contractions begin before a run and not inside it. Only the
  second letter of a contraction (`'re`, `'ve`, `'ll`) may be reached by a match that began before the pair; these
  three pairs are never cut. Letters are taken from blocks that have been letters in all versions of Unicode.

Pairs inside special tokens aren't certain, and no special token holds white space, so no cut falls into one.

Texts are split at white space; the fragments are short and repeat, so each worker encodes a fragment once and keeps
its ids in a bounded memo, which is held in Arrow and numpy arrays: some forty bytes a fragment. Long fragments (text
without spaces, encoded data) are cut further between letters and digits, so that their parts are short, too.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
WHITE_BYTES = b"\x09\x0a\x0b\x0c\x0d\x20"
MEMO_FRAGMENTS = 1_000_000
MEMO_LENGTH = 64
#: First and last code points of letters and ASCII digits between which is cut (fixed values): ASCII, Latin-1, Latin
#: Extended-A, Greek, Cyrillic, Hiragana, Katakana, CJK ideographs, Hangul.
CUT_BLOCKS = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x17F), (0x3B1, 0x3C9), (0x410, 0x44F), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Second and third byte of the contractions in the pre-tokenizer's pattern (fixed values).
CONTRACTIONS = (b"re", b"ve", b"ll")
#: Characters that are encoded at once: the more, the fewer distinct fragments for each.
GROUP_CHARS = 8_000_000
#: The same two in a stage of a pipeline, whose workers may still hold what earlier stages have loaded. They bound
#: memory only: whatever the memo lacks is encoded again.
STAGE_FRAGMENTS, STAGE_CHARS = 400_000, 2_000_000

_loaded: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, once per process."""
    if ("lib", path) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded["lib", path] = tok
    return _loaded["lib", path]


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes by forced boundaries and decodes, exactly as the library does for a byte-level BPE file."""

    def __init__(self, path: str, memo_fragments: int = MEMO_FRAGMENTS):
        self.lib, self.limit = load_tokenizer(path), memo_fragments
        spec = json.loads(self.lib.to_str())
        pre, added = spec["pre_tokenizer"], spec["added_tokens"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["model"].get("dropout"):
            raise ValueError("forced boundaries need a plain byte-level BPE")
        if any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("an added token could reach over a cut")
        to_byte = byte_alphabet()
        plain = {a["content"]: a["content"].encode() for a in added}
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.pieces: list[bytes] = [b""] * (max(vocab.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.pieces[i] = plain.get(token) or bytes(to_byte[c] for c in token)
            if token not in plain:
                raw = np.frombuffer(self.pieces[i], np.uint8)
                inside[raw[:-1], raw[1:]] = True
        white = np.zeros(256, bool)
        white[list(WHITE_BYTES)] = True
        #: certain[a, b]: between the bytes a and b may always be cut
        self.certain = ~inside & ~white[:, None] & white[None, :]
        held = inside.copy()
        for raw in (*(c.encode() for c in plain), *CONTRACTIONS):
            raw = np.frombuffer(raw, np.uint8)
            held[raw[:-1], raw[1:]] = True
        #: free[a, b]: as certain, between letters and digits
        self.free = ~held
        self.cuttable = np.zeros(1 << 16, bool)
        for low, high in CUT_BLOCKS:
            self.cuttable[low : high + 1] = True
        loose = np.flatnonzero((inside & white[None, :]).any(1) & ~white)
        w = rb"[\x09-\x0d\x20]"
        n = rb"[^\x09-\x0d\x20]"
        uncut = rb"(?:(?<=[" + b"".join(re.escape(bytes([b])) for b in loose) + rb"])" + w + rb"+" + n + rb"*)*" if len(loose) else b""
        self.added = [c.encode() for c in plain]
        self.loose = frozenset(loose.tolist()) | frozenset(WHITE_BYTES)
        self.sizes = np.array([len(x) for x in self.pieces], np.int64)
        #: what rules out the quick split: NULs and \\1, other white space, and two in a row
        self.uneven = [b"\0", b"\1", *(bytes([c]) for c in WHITE_BYTES if c not in b" \n"), b"  ", b" \n", b"\n ", b"\n\n", *(bytes([c, 10]) for c in loose.tolist())]
        self.uncut = [(bytes([c, 32]), bytes([c, 1])) for c in loose.tolist()]
        self.split = re.compile(w + rb"*" + n + rb"*" + uncut, re.S).findall
        self.forget()

    def fragments(self, text: str) -> list[bytes]:
        """Parts to encode by themselves, in order, as they are written in the memo.

        One that begins with a space is written without it, others with a NUL before, or two NULs where its own
        bytes could be taken for marks.
        """

        def written(f: bytes) -> bytes:
            if b"\1" in f or f[:1] == b"\0":
                return b"\0\0" + f
            return f[1:] if f[:1] == b" " and f[1:2] != b"\0" else b"\0" + f

        return [written(f) for f in self.split(text.encode("utf-8")) if f]

    def _spaced(self, text: str) -> bytes | None:
        """The text's fragments with spaces between, if it holds single spaces and line feeds only; else None.

        Spaces after an uncertain byte, where no cut may be, are written as \\1.
        """
        raw = text.encode("utf-8")
        if any(map(raw.__contains__, self.uneven)):
            return None
        for pair, kept in self.uncut:
            raw = raw.replace(pair, kept)
        return b"\0" + raw.replace(b"\n", b" \0\n")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Fragments are split (in Arrow, for most texts), made distinct and looked up in Arrow; Python only sees the
        fragments that the memo doesn't have.
        """
        spaced = [self._spaced(t) for t in texts]
        odd = [i for i, s in enumerate(spaced) if s is None]
        lists = pc.split_pattern(pa.array([b"" if s is None else s for s in spaced], pa.binary()), b" ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        first, last = bounds[:-1], bounds[1:].copy()
        flat = lists.values
        if odd:
            parts = [self.fragments(texts[i]) for i in odd]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            first[odd] = len(flat) + np.cumsum(sizes) - sizes
            last[odd] = first[odd] + sizes
            flat = pa.concat_arrays([flat, pa.array([f for p in parts for f in p], pa.binary())])
        coded = flat.dictionary_encode()
        table, start, size = self._known(coded.dictionary, texts)
        at = coded.indices.to_numpy()
        width = size[at]
        ends = np.concatenate(([0], np.cumsum(width)))
        where = np.arange(int(ends[-1])) + np.repeat(start[at] - ends[:-1], width)
        raw = table[where].tobytes()
        return [raw[a:b] for a, b in zip((4 * ends[first]).tolist(), (4 * ends[last]).tolist())]

    def _known(self, distinct: pa.Array, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where in ids each fragment's encoding is."""
        place = pc.index_in(distinct, value_set=self.keys).fill_null(-1).to_numpy()
        unseen = np.flatnonzero(place < 0)
        start, size = self.starts[place], self.sizes_of[place]
        missing = distinct.take(pa.array(unseen)).to_pylist()
        special = [a for a in self.added if any(a.decode() in t for t in texts)]
        loose = self.loose
        plain = np.fromiter((bool(f) and f[0] != 0 and f[-1] not in loose and len(f) <= MEMO_LENGTH and not (special and any(a in f for a in special)) for f in missing), bool, len(missing))
        tables, total = [self.ids], len(self.ids)
        queue = [(np.flatnonzero(plain)[at : at + 50_000], True) for at in range(0, int(plain.sum()), 50_000)]
        queue += [(np.flatnonzero(~plain)[at : at + 50_000], False) for at in range(0, int((~plain).sum()), 50_000)]
        while queue:
            which, joined = queue.pop(0)
            some = [missing[i] for i in which.tolist()]
            made = self._encode_run(some) if joined else self._encode_each(some)
            if made is None:
                queue.append((which, False))
                continue
            ids, sizes = made
            start[unseen[which]] = total + np.cumsum(sizes) - sizes
            size[unseen[which]] = sizes
            tables.append(ids)
            total += len(ids)
        table = np.concatenate(tables)
        self._remember(distinct, unseen, table, start, size)
        return table, start, size

    def _remember(self, distinct: pa.Array, unseen: np.ndarray, table: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Adds what is new to the memo, or keeps only what is in use now when that is full; long fragments stay out."""
        short = pc.less_equal(pc.binary_length(distinct), MEMO_LENGTH).to_numpy(zero_copy_only=False)
        new = unseen[short[unseen]]
        if len(self.keys) + len(new) > self.limit:
            self.forget()
            new = np.flatnonzero(short)
        width = size[new]
        ends = np.cumsum(width)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[new] - (ends - width), width)
        self.starts = np.concatenate((self.starts[:-1], len(self.ids) + ends - width, [0]))
        self.sizes_of = np.concatenate((self.sizes_of[:-1], width, [0]))
        self.ids = np.concatenate((self.ids, table[where]))
        self.keys = pa.concat_arrays([self.keys, distinct.take(pa.array(new))])

    def forget(self) -> None:
        """Empties the memo. Its last place stands for what it doesn't have."""
        self.keys, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.starts = self.sizes_of = np.zeros(1, np.int64)

    @staticmethod
    def _whole(part: bytes) -> bytes:
        """A fragment from how it is written in the memo."""
        if part[:2] == b"\0\0":
            return part[2:]
        return (part[1:] if part[:1] == b"\0" else b" " + part).replace(b"\1", b" ")

    def _encode_run(self, run: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their numbers of fragments that begin with a space, encoded in one text.

        The pairs before the spaces are certain, so the fragments stay apart.
        """
        text = (b" " + b" ".join(run)).replace(b"\1", b" ").decode()
        ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wish = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1)
        at = np.searchsorted(ends, wish)
        if len(ids) == 0 or at[-1] >= len(ids) or not np.array_equal(ends[at], wish):
            return None
        return ids, np.diff(at, prepend=-1)

    def cut(self, text: str) -> list[str]:
        """The parts of a text between certain cuts inside runs of letters and digits."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)  # where each character begins
        letter = (points < 1 << 16) & self.cuttable[np.minimum(points, (1 << 16) - 1)]
        at = first[1:]
        cuts = np.flatnonzero(letter[:-1] & letter[1:] & self.free[raw[at - 1], raw[at]]) + 1
        return [text[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(text)])]

    def _encode_each(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [[t] if len(t) <= MEMO_LENGTH else self.cut(t) for t in (self._whole(f).decode() for f in some)]
        flat = [p for ps in parts for p in ps]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        made = [e.ids for e in self.lib.encode_batch_fast(list(distinct), add_special_tokens=False)]
        sizes = [sum(len(made[distinct[p]]) for p in ps) for ps in parts]
        return np.array([i for p in flat for i in made[distinct[p]]], "<u4"), np.array(sizes, np.int64)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_bpe(path: str, memo_fragments: int = MEMO_FRAGMENTS) -> ByteBpe:
    """The worker's encoder of a file, whose memo may hold so many fragments from now on."""
    if ("own", path) not in _loaded:
        _loaded["own", path] = ByteBpe(path, memo_fragments)
    _loaded["own", path].limit = memo_fragments
    return _loaded["own", path]


def forget() -> None:
    """Empties the memos of this worker."""
    for key, value in _loaded.items():
        if key[0] == "own":
            value.forget()


def groups(values: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of an Arrow column of strings, about `most` bytes at a time; a null becomes an empty text."""
    start, some, held = 0, [], 0
    for v in values:
        t = v.as_py() or ""
        some.append(t)
        held += len(t)
        if held >= most:
            yield start, some
            start, some, held = start + len(some), [], 0
    if some:
        yield start, some


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256.

    A null text counts as empty (no ids). Repeated rows and null ids are kept as they come; an empty table gives
    an empty result; other columns are ignored. Invalid byte sequences decode to U+FFFD as in the library.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        decimal = [str(i) for i in range(len(bpe.pieces))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in groups(batch.column(1), GROUP_CHARS):
                for raw in bpe.encode_many(texts):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with the columns n_tokens, token_ids and decodes (whether the ids decode to the text).

    A null text gives no ids; columns of docs with these names are replaced; nothing else changes.
    """
    from pyspark.sql import types as T

    path = path or tokenizer_path()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decodes", T.BooleanType())]
    docs = docs.drop(*[f.name for f in added])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, STAGE_FRAGMENTS)
        for batch in batches:
            for start, texts in groups(batch.column(at), STAGE_CHARS):
                raw = bpe.encode_many(texts)
                sizes = [len(r) // 4 for r in raw]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
                same = [bpe.decode(np.frombuffer(r, "<u4").tolist()) == t for r, t in zip(raw, texts)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(sizes, pa.int64()), ids, pa.array(same, pa.bool_())], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
