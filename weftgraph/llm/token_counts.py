"""Token counts; huge documents are counted in overlapping chunks that are spliced where both sides agree.

A document up to `chunk` characters is encoded whole. A longer one is cut into chunks that overlap. Two
neighbours are spliced at a position of their overlap where both encodings start a token and which is a certain
cut of the vocabulary (see bpe): there the encoding of the whole document has a boundary too and the ids on
either side don't depend on the other, so the counts add up exactly. Where an overlap holds no such position it
is doubled, at worst until it covers the rest of the document, which then is encoded in one go.

Tokenizers without such cuts (anything but byte-level BPE) are given whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe, byte_bpe, groups, tokenizer_path

CHUNK, OVERLAP, TOKEN_LIMIT = 32_768, 256, 512


def _starts(bpe: ByteBpe, text: str, at: int) -> np.ndarray:
    """Positions in the document at which tokens of this chunk start."""
    enc = bpe.lib.encode(text, add_special_tokens=False)
    return np.fromiter((s for s, _ in enc.offsets), np.int64, len(enc)) + at


def _certain(bpe: ByteBpe, text: str, at: int) -> bool:
    left, right = text[at - 1].encode("utf-8", "surrogatepass")[-1], text[at].encode("utf-8", "surrogatepass")[0]
    return bool(bpe.certain[left, right])


def count_resynchronised(bpe: ByteBpe, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of ids of the whole text, from encodings of its chunks."""
    n = len(text)
    begin, total = 0, 0  # tokens before `begin` are counted; `begin` is a proven boundary
    held: tuple[int, np.ndarray] | None = None  # where the current chunk ends, token starts in it from `begin` on
    while begin < n:
        if held is None:
            end = min(n, begin + chunk)
            held = end, _starts(bpe, text[begin:end], begin)
        end, starts = held
        if end == n:
            return total + int((starts >= begin).sum())
        wide, splice = overlap, None
        while splice is None:
            low = max(begin, end - wide)
            after = min(n, low + max(chunk, 2 * wide))
            right = _starts(bpe, text[low:after], low)
            common = np.intersect1d(starts[starts > max(low, begin)], right[right < end])
            # the middle first: far from the edges of both chunks
            for p in sorted(common.tolist(), key=lambda p: abs(p - (low + end) // 2)):
                if _certain(bpe, text, p):
                    splice = p
                    break
            if splice is None:
                if low == begin:
                    # the whole of what is held overlaps and still nothing agrees: hold more
                    end = min(n, end + max(chunk, end - begin))
                    starts = _starts(bpe, text[begin:end], begin)
                    if end == n:
                        return total + len(starts)
                    wide = overlap
                else:
                    wide *= 2
        total += int(((starts >= begin) & (starts < splice)).sum())
        begin, held = splice, (after, right[right >= splice])
    return total


def token_counts(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    A null text counts as empty. Repeated rows and null ids are kept as they come; an empty table gives an empty
    result; other columns are ignored. Special strings inside a text become their ids, the library's default.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, chunk, overlap)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for _, texts in groups(batch.column(1)):
                n_bytes += [len(t.encode()) for t in texts]
                n_tokens += count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """texts -> counts, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    try:
        bpe = byte_bpe(path)
    except ValueError:
        from .bpe import load_tokenizer

        lib = load_tokenizer(path)
        return lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        found = dict(zip(short, map(len, bpe.lib.encode_batch_fast([texts[i] for i in short], add_special_tokens=False))))
        return [found[i] if i in found else count_resynchronised(bpe, t, chunk, overlap) for i, t in enumerate(texts)]

    return count
