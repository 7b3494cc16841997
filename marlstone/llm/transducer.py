"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent chunks of the corpus are compiled, in sorted order, into a minimal acyclic
automaton (equal suffix states are shared).  Each edge carries the number of accepted
words that come before it at its state; summed along a path this numbers the words, and
the number points at the word's ids.  The automaton is a flat file of numpy arrays that
every Python worker maps into memory; all distinct chunks of a piece walk it together,
one byte per step.  Chunks outside the lexicon are merged
exactly, all of a piece together (see ``bpe_batch``).

The lexicon changes speed only: results are those of the ``tokenizers`` library for any
lexicon, an empty one included.

Defined results: a null or empty text has no ids, and both digests are those of the
empty string; repeated rows repeat; a null ``doc_id`` stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.llm.shared import Scratch
from marlstone.llm.textbatch import Words, pieces

LEXICON_WORDS = 65_536
MAX_WORD_BYTES = 48
#: Bounds of a worker's memory: chunks counted before they are sent on, bytes handled at a time.
COUNTED_CHUNKS, PIECE_BYTES = 600_000, 3 << 20
_open: dict[str, "Lexicon"] = {}


def frequent_chunks(docs: DataFrame, text_col: str = "text", size: int = LEXICON_WORDS) -> list[str]:
    """The most frequent white-space-delimited chunks of all documents: all that reach the least count that ``size`` of them allow.

    Counts are exact: every occurrence of a chunk of up to ``MAX_WORD_BYTES`` is counted, however few a task meets. Longer ones
    are not compiled, which bounds the lexicon's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def merged(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for b in pieces(batches, limit=PIECE_BYTES):
            w = Words(b.column("text"))
            short = w.array().filter(pa.array(w.stop - w.start <= MAX_WORD_BYTES))
            c = short.value_counts()
            new = pa.table({"word": c.field("values"), "n": c.field("counts")})
            held = merged([held, new]) if held is not None else new
            if held.num_rows > COUNTED_CHUNKS:  # keeps a worker's memory bounded over very long partitions
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with Scratch(docs.sparkSession) as scratch:
        counted = scratch.written(counted, "chunks")
        bar, held = None, 0
        for level in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(size).collect():
            if held + level.words > size:
                break
            bar, held = level.n, held + level.words
        # at most ``size`` short words, and no more than that from all tasks together
        return [r.word for r in counted.where(F.col("n") >= bar).orderBy(F.desc("n"), "word").collect()] if held else []


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer as bytes; ``words`` maps each word to its ids."""
    keys = sorted((w.encode(), w) for w in words)
    #: frozen state -> number; a state is (is it final, its edges as (byte, state) pairs)
    registry: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple]] = []
    stack: list[list] = [[False, []]]  # unfrozen states along the last word
    last = b""

    def freeze(depth: int) -> None:
        while len(stack) > depth + 1:
            final, edges = stack.pop()
            key = (final, tuple(edges))
            if (s := registry.get(key)) is None:
                s = registry[key] = len(frozen)
                frozen.append(key)
            stack[-1][1].append((last[len(stack) - 1], s))

    for key, _ in keys:
        same = len(os.path.commonprefix([key, last]))
        freeze(same)
        stack.extend([False, []] for _ in key[same:])
        stack[-1][0] = True
        last = key
    freeze(0)
    frozen.append((stack[0][0], tuple(stack[0][1])))
    below = np.zeros(len(frozen), dtype=np.int64)  # words accepted from each state; targets are frozen first
    edge_key, target, skip = [], [], []
    for s, (final, edges) in enumerate(frozen):
        n = int(final)
        for byte, t in edges:
            edge_key.append(s << 8 | byte)
            target.append(t)
            skip.append(n)
            n += below[t]
        below[s] = n
    ids = [words[w] for _, w in keys]
    arrays = [
        np.array(edge_key, np.int64), np.array(target, np.int64), np.array(skip, np.int64), np.array([f for f, _ in frozen], np.int64),
        np.cumsum([0, *map(len, ids)]).astype(np.int64), np.array([i for x in ids for i in x], np.int64),
    ]
    return np.array([a.size for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled transducer, mapped from a file that is unlinked once it is open."""

    def __init__(self, data: bytes):
        with tempfile.NamedTemporaryFile() as f:
            f.write(data)
            f.flush()
            flat = np.memmap(f.name, dtype=np.int64, mode="r")
        cuts = np.cumsum([6, *flat[:6]])
        self.edge_key, self.target, self.skip, self.final, self.id_at, self.ids = (flat[a:b] for a, b in zip(cuts, cuts[1:]))
        self.root = len(self.final) - 1

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """The number of each word, or -1 where the lexicon lacks it."""
        n = len(words)
        found = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.edge_key):
            return found
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        body = np.frombuffer(words.buffers()[2], np.uint8)
        length = np.diff(at)
        live = np.flatnonzero(length <= MAX_WORD_BYTES)
        state, number = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            done = length[live] == step
            ends = done & (self.final[state] == 1)
            found[live[ends]] = number[ends]
            live, state, number = live[~done], state[~done], number[~done]
            key = state << 8 | body[at[live] + step]
            edge = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            on = self.edge_key[edge] == key
            live, edge = live[on], edge[on]
            state, number = self.target[edge], number[on] + self.skip[edge]
            step += 1
        return found


def lexicon(data: bytes) -> Lexicon:
    key = hashlib.sha256(data).hexdigest()
    if key not in _open:
        _open.clear()
        _open[key] = Lexicon(data)
    return _open[key]


@lru_cache(maxsize=2)
def strings(path: str) -> list[bytes]:
    return [s.encode() for s in bpe.vocabulary(path).token_strings()]


class Encoder:
    """Encodes and decodes the rows of a string array with a vocabulary and a lexicon."""

    def __init__(self, path: str, data: bytes):
        self.vocab, self.lex, self.strings = bpe.vocabulary(path), lexicon(data), strings(path)
        ids, at = np.asarray(self.lex.ids), self.lex.id_at.tolist()
        packed = [ids[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]
        self.known = list(zip(packed, map(self.spoken, packed)))

    def spoken(self, ids: bytes) -> bytes:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode(self, texts: pa.Array) -> tuple[list[bytes], list[bytes], np.ndarray]:
        """Per row: ids as little-endian unsigned 32-bit integers, the decoded text in UTF-8, the number of ids."""
        words = Words(texts)
        coded = words.array().dictionary_encode()
        number = self.lex.numbers(coded.dictionary)
        lacking = np.flatnonzero(number < 0)
        both = [self.known[k] if k >= 0 else None for k in number.tolist()]
        for k, ids in zip(lacking.tolist(), self.vocab.encode_chunks(coded.dictionary.take(pa.array(lacking)).to_pylist())):
            both[k] = (ids, self.spoken(ids))
        packed, spoken = [p for p, _ in both], [t for _, t in both]
        first, codes = words.first.tolist(), coded.indices.to_numpy()
        rows = [codes[a:b].tolist() for a, b in zip(first, first[1:])]
        binary = [b"".join(map(packed.__getitem__, r)) for r in rows]
        text = [b" ".join(filter(None, map(spoken.__getitem__, r))) for r in rows]
        return binary, text, np.fromiter((len(b) // 4 for b in binary), np.int64, len(binary))


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, lexicon_words: int = LEXICON_WORDS, outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again.

    ``outputs`` names what each row carries beside its id: ``n_tokens`` long, ``ids`` (little-endian unsigned 32-bit
    integers, binary), ``decoded`` string, and the lower-case hex digests ``ids_sha256`` and ``decoded_sha256``.
    ``keep`` names input columns to pass through; one that has the name of an output is not passed twice.
    """
    path = vocab_path or bpe.default_path()
    vocab = bpe.vocabulary(path)
    words = frequent_chunks(docs, text_col, lexicon_words)
    data = compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(words, vocab.encode_chunks(words)) if ids})
    shipped = docs.sparkSession.sparkContext.broadcast(data)  # bounded by ``lexicon_words`` short words
    kept = [c for c in keep if c not in {*outputs, "doc_id"}]
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"), *(docs[c] for c in kept))
    kinds = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, shipped.value)
        for b in pieces(batches, "__text", PIECE_BYTES):
            ids, text, n = coder.encode(b.column("__text"))
            made = {
                "n_tokens": lambda: pa.array(n),
                "ids": lambda: pa.array(ids, pa.binary()),
                "decoded": lambda: pa.array([t.decode() for t in text], pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in kept), *(made[c]() for c in outputs)], ["doc_id", *kept, *outputs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text"]
    return src.mapInArrow(run, ", ".join([*fields, *(f"{c} {kinds[c]}" for c in outputs)]))
