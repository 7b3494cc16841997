"""Vectorised views of Arrow text columns shared by the corpus operators.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D`` (the
six ASCII separators), so multi-byte UTF-8 characters never split.  Words are
hashed eight bytes at a time and runs of words as trees of their words' hashes, with
a 64-bit finaliser at every step: no sum of powers, which some pairs of texts
share whatever its base.  Only words of over ``LONG`` bytes are looped over in Python.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Text bytes handled at a time; bounds the working memory of a Python worker.
PIECE_BYTES = (2 << 20) - 1

#: Longer words are hashed by BLAKE2.
LONG = 64
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: The lowest 0 to 8 bytes of a word of memory.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split record batches so that each holds about ``limit`` bytes of ``column`` (a longer single row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give freed memory back to the system, since workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Word spans of a piece: ``start``/``stop`` byte positions, ``first`` word index of each row (rows + 1 entries)."""

    def __init__(self, texts: pa.Array):
        self.body, self.offsets = raw(texts)
        solid = ~SPACE[self.body]
        cut = np.zeros(len(self.body) + 1, dtype=bool)
        cut[self.offsets] = True
        begin, end = solid.copy(), solid.copy()
        if len(solid):
            begin[1:] &= ~solid[:-1] | cut[1:-1]
            end[:-1] &= ~solid[1:] | cut[1:-1]
        self.solid = solid
        self.start, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def array(self) -> pa.StringArray:
        """The words as one string array."""
        ends = np.zeros(len(self) + 1, dtype=np.int32)
        np.cumsum(self.stop - self.start, out=ends[1:])
        return pa.StringArray.from_buffers(len(self), pa.py_buffer(ends), pa.py_buffer(self.body[self.solid]))

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        return span_hashes(self.body, self.start, self.stop - self.start)

    def keys(self) -> list[bytes]:
        """A 16-byte digest of each row's words: equal for rows of the same words, whatever lies between them."""
        last = np.zeros(len(self) + 1, dtype=bool)
        last[self.first] = True  # word k + 1 begins a row: word k is its row's last
        gap = self.stop[~last[1:]]
        body, kept = self.body.copy(), self.solid.copy()
        body[gap], kept[gap] = 32, True
        ends = np.concatenate([[0], np.cumsum(kept)])[self.offsets].tolist()
        flat = memoryview(body[kept].tobytes())
        return [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]


def span_hashes(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``size`` bytes."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(body) + 1, "<u8", padded, strides=(1,))
    out = mix((size.astype(np.uint64) * _SEEDS[0] ^ eight[start] & _LOW[np.minimum(size, 8)]) * _ODD)
    at, done = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        out[at] = mix((out[at] ^ eight[start[at] + done] & _LOW[np.minimum(size[at] - done, 8)]) * _ODD + _SEEDS[1])
        done += 8
        at = at[size[at] > done]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(body[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    y = x >> np.uint64(30)
    x = np.bitwise_xor(x, y, out=y)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of ``hashes[i : i + width]`` for every i at which so many are left; ``which`` picks one of two independent ones.

    Runs of 1, 2, 4 and so on are hashed from two halves each, and those that make up ``width`` one after another.
    """
    count = max(0, len(hashes) - width + 1)
    level, size, out, done = mix(hashes ^ _SEEDS[which]), 1, None, 0
    while count:
        if width & size:
            part = level[done : done + count]
            out = part if out is None else mix(out * _ODD + part)
            done += size
        if 2 * size > width:
            break
        level = mix(level[:-size] * _SEEDS[which] + level[size:])
        size *= 2
    return out if count else np.empty(0, np.uint64)


def windows(hashes: np.ndarray, first: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word window that stays inside one row, and the index of each window's first word."""
    if len(hashes) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(np.arange(len(hashes)) + width <= np.repeat(first[1:], np.diff(first)))
    return runs(hashes, width, which)[at], at


def dealt(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards in a sorted array, each with the stretch that it takes."""
    full, start = np.unique(shard, return_index=True)
    for s, a, b in zip(full.tolist(), start.tolist(), [*start[1:].tolist(), len(shard)]):
        yield s, slice(a, b)


def spans(first: np.ndarray) -> np.ndarray:
    """Row index of every element of consecutive rows that begin at ``first``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
