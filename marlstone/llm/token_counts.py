"""Token counts by heap-and-linked-list byte-pair merging.

Each distinct word starts as a doubly linked list of byte symbols.  A heap holds
the adjacent pairs that have a merge rank; the lowest is popped, stale entries are
skipped, and each merge removes one symbol.  The count is the number of initial
symbols less the merges made; no ids are produced.

Defined results: a null or empty text has 0 tokens and 0 bytes; rows repeat as often
as they come; a null ``doc_id`` stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm import bpe
from marlstone.llm.textbatch import Words, pieces

CONTEXT_TOKENS = 2048
_memo: dict[str, tuple[bpe.Recent, bpe.Recent]] = {}


def count_word(vocab: bpe.Vocabulary, word: str) -> int:
    """Tokens of one word: initial symbols less merges."""
    symbols = vocab.symbols(word)
    return len(symbols) - bpe.merge_symbols(symbols, vocab.merges)[1]


def count_chunk(vocab: bpe.Vocabulary, memo: tuple[bpe.Recent, bpe.Recent], chunk: str) -> int:
    chunks, words = memo
    if (total := chunks.get(chunk)) is not None:
        return total
    total = 0
    for part in vocab.parts(chunk):
        if isinstance(part, int):
            total += 1
        else:
            if (n := words.get(part)) is None:
                words.put(part, n := count_word(vocab, part))
            total += n
    chunks.put(chunk, total)
    return total


def counts(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of a string array."""
    vocab, memo = bpe.vocabulary(path), _memo.setdefault(path, (bpe.Recent(), bpe.Recent()))
    words = Words(texts)
    codes, chunks = bpe.distinct(words.array())
    each = np.fromiter((count_chunk(vocab, memo, c) for c in chunks), np.int64, len(chunks))
    total = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(each[codes] if len(codes) else each[:0], out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, limit: int = CONTEXT_TOKENS) -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    path = vocab_path or bpe.default_path()
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=bpe.PIECE_BYTES):
            n = counts(b.column("text"), path)
            size = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
