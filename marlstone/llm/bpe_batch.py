"""Exact byte-pair merging of many words at once.

Words of one length are the rows of a matrix of symbols, beside a matrix of the ranks of their adjacent pairs.  Every round
merges, in each row, its lowest-ranked pair (the leftmost of equals), closes the gap, and looks up the ranks of the two new pairs; rows
without a ranked pair are done.  That is the merge order of one word after another, for all words together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marlstone.llm.textbatch import raw, span_hashes

#: Longer words (in bytes) are merged one by one.
LONGEST = 40
NONE = np.int32(1 << 30)
_SLOTS = 19
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class PairTable:
    """Ranks and results of pairs of ids, in hash tables of one try each: pairs that clash move on to the next table."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        left = np.array([(a << 20 | b, rank, new) for (a, b), (rank, new) in merges.items()], dtype=np.int64).reshape(-1, 3)
        self.levels = []
        for m in _MULTIPLY:
            slot = self.slot(left[:, 0], m)
            _, first = np.unique(slot, return_index=True)
            key, value = np.full(1 << _SLOTS, -1, np.int64), np.zeros((1 << _SLOTS, 2), np.int32)
            key[slot[first]] = left[first, 0]
            value[slot[first]] = left[first, 1:]
            self.levels.append((m, key, value))
            left = np.delete(left, first, axis=0)
            if not len(left):
                break
        else:
            raise ValueError("too many merges for the tables")

    @staticmethod
    def slot(key: np.ndarray, m: np.uint64) -> np.ndarray:
        return (key.astype(np.uint64) * m >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` where there is no such merge) and merged id of each pair."""
        key = a.astype(np.int64) << 20 | b
        rank, new = np.full(len(key), NONE), np.zeros(len(key), np.int32)
        todo = None
        for m, keys, values in self.levels:
            k = key if todo is None else key[todo]
            s = self.slot(k, m)
            hit = np.flatnonzero(keys[s] == k)
            at = hit if todo is None else todo[hit]
            rank[at], new[at] = values[s[hit], 0], values[s[hit], 1]
            # an empty slot ends the search: later tables hold only what clashed here
            on = np.flatnonzero((keys[s] != k) & (keys[s] != -1))
            todo = on if todo is None else todo[on]
            if not len(todo):
                break
        return rank, new


class BatchMerger:
    """Merges words given as UTF-8 bytes; ``inner`` and ``final`` are the ids of a byte within a word and at its end."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], inner: list[int], final: list[int]):
        self.table = PairTable(merges)
        self.inner, self.final = np.array(inner, np.int32), np.array(final, np.int32)

    def ids(self, words: list[bytes], one_by_one) -> list[np.ndarray]:
        """Ids of each word, as unsigned 32-bit integers; ``one_by_one`` merges a word that is too long for the matrix."""
        out: list = [None] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(len(w), []).append(k)
        for n, at in groups.items():
            if n > LONGEST or n < 2:
                for k in at:
                    out[k] = np.array(one_by_one(words[k]) if n else [], "<u4")
                continue
            block = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(-1, n)
            flat, ends = self.block(block)
            start = 0
            for k, end in zip(at, ends.tolist()):
                out[k] = flat[start:end]
                start = end
        return out

    def arrays(self, body: np.ndarray, start: np.ndarray, size: np.ndarray, one_by_one) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words at ``start`` of ``size`` bytes: a pool of ids, where each word's begin in it, and how many there are."""
        at, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pool, base = [np.empty(0, "<u4")], 0
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own, n = order[a:b], int(size[order[a]])
            if 2 <= n <= LONGEST:
                flat, ends = self.block(body[start[own][:, None] + np.arange(n)])
            elif n == 1:
                flat, ends = self.final[body[start[own]]].astype("<u4"), np.arange(1, len(own) + 1)
            else:
                found = [np.array(one_by_one(body[p : p + n].tobytes()) if n else [], "<u4") for p in start[own].tolist()]
                flat, ends = np.concatenate(found), np.cumsum([len(f) for f in found])
            many[own] = np.diff(ends, prepend=0)
            at[own] = base + ends - many[own]
            pool.append(flat)
            base += len(flat)
        return np.concatenate(pool), at, many

    def block(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of equally long words, one word after another, and where each ends."""
        rows, n = body.shape
        sym = self.inner[body]
        sym[:, -1] = self.final[body[:, -1]]
        rank, new = (x.reshape(rows, n - 1) for x in self.table.find(sym[:, :-1].reshape(-1), sym[:, 1:].reshape(-1)))
        done_sym, done_len = np.zeros((rows, n), np.int32), np.zeros(rows, np.int64)
        live, size = np.arange(rows), n
        while True:
            best = rank.argmin(1)
            each = np.arange(len(live))
            on = rank[each, best] != NONE if rank.shape[1] else np.zeros(len(live), bool)
            off = np.flatnonzero(~on)
            done_sym[live[off], :size] = sym[off, :size]
            done_len[live[off]] = size
            if len(off) == len(live):
                break
            keep = np.flatnonzero(on)
            live, sym, rank, new, best = live[keep], sym[keep], rank[keep], new[keep], best[keep]
            each = np.arange(len(live))
            # the pair at ``best`` becomes one symbol; all to its right moves up by one
            sym[each, best] = new[each, best]
            column = np.arange(size - 1)
            source = column + (column > best[:, None])
            sym = np.take_along_axis(sym, source, 1)
            size -= 1
            if size == 1:
                done_sym[live, 0], done_len[live] = sym[:, 0], 1
                break
            pairs = np.arange(size - 1)
            source = pairs + (pairs >= best[:, None])
            rank, new = np.take_along_axis(rank, source, 1), np.take_along_axis(new, source, 1)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1], new[left, best[left] - 1] = self.table.find(sym[left, best[left] - 1], sym[left, best[left]])
            right = np.flatnonzero(best < size - 1)
            rank[right, best[right]], new[right, best[right]] = self.table.find(sym[right, best[right]], sym[right, best[right] + 1])
        mask = np.arange(n) < done_len[:, None]
        return done_sym[mask].astype("<u4"), np.cumsum(done_len)


class KnownChunks:
    """Ids of the chunks that a worker has met, so that only new ones are encoded; bounded by ``limit`` chunks of ``LONGEST`` bytes.

    ``encode`` gives, for a string array, a pool of ids, where each string's begin in it, and how many there are.
    """

    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.hashes, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and the chunks that have them
        self.pool, self.start, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def look(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, for distinct chunks."""
        body, offsets = raw(chunks)
        length = np.diff(offsets)
        h = span_hashes(body, offsets[:-1], length)
        old = np.zeros(len(chunks), bool)
        if len(self.hashes):
            order = np.argsort(h)  # sorted look-ups stay in the cache
            at = np.empty(len(h), np.int64)
            at[order] = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[at] == h)
            at = self.place[at]
            # hashes find, but the chunks themselves decide
            old[same] = pc.equal(chunks.take(pa.array(same)), self.chunks.take(pa.array(at[same]))).to_numpy(zero_copy_only=False)
            if old.all():
                return self.pool, self.start[at], self.size[at]
        new = np.flatnonzero(~old)
        pool, start, size = self.encode(chunks.take(pa.array(new)))
        begin, many = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        if old.any():
            begin[old], many[old] = self.start[at[old]], self.size[at[old]]
        begin[new], many[new] = start + len(self.pool), size
        out = np.concatenate([self.pool, pool])
        if len(self.chunks) + len(new) > self.limit:
            self.forget()
        fresh, which = np.unique(h[new], return_index=True)
        spot = np.searchsorted(self.hashes, fresh)
        taken = self.hashes[np.minimum(spot, len(self.hashes) - 1)] == fresh if len(self.hashes) else np.zeros(len(fresh), bool)
        able = np.flatnonzero(~taken & (length[new[which]] <= LONGEST))
        if len(able) and len(able) <= self.limit:
            which, fresh = which[able], fresh[able]
            spot = np.searchsorted(self.hashes, fresh)
            self.place = np.insert(self.place, spot, len(self.chunks) + np.arange(len(able)))
            self.hashes = np.insert(self.hashes, spot, fresh)
            each = size[which]
            ends = np.cumsum(each)
            self.chunks = pa.concat_arrays([self.chunks, chunks.take(pa.array(new[which]))])
            self.start = np.concatenate([self.start, ends - each + len(self.pool)])
            self.size = np.concatenate([self.size, each])
            self.pool = np.concatenate([self.pool, pool[np.repeat(start[which] - (ends - each), each) + np.arange(ends[-1])]])
        return out, begin, many
