"""Adaptive context-mixing range coder for token ids.

A block of ids is laid out as up to ``LANES`` lanes of consecutive ids.  At each step
one id of every lane is coded with one shared model, which is then updated with all of
them, so every numpy call handles a whole step.  The model mixes three predictions:

* order 0: adaptive id frequencies, which leave no id without probability;
* order 1 and order 2: the id that last followed the previous one or two ids (in hashed
  slots), each given a share of the probability that follows the hit rate seen so far at
  its level of confidence.

The three drive a 48-bit range coder with 16-bit output digits.  Every block starts from
a fresh model, stands alone, and ends with a CRC-32 of its ids.

Block: ``n`` ids, ``lanes``, digits per lane, then the digits; see ``encode_block``.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 16384
BLOCK_IDS = 1 << 21
#: All intervals lie in 0..SCALE; order 0 leaves every id a width of 2 at least, at the largest block and share.
SCALE = float(1 << 28)
SLOT_BITS = 16
LEVELS = 8  # of confidence
FULL, SMALL, DIGIT = float(1 << 48), float(1 << 32), float(1 << 16)


class Model:
    """Shared adaptive state of one block.

    Numbers are eighths below 2**50, held as float64, which is exact and lets numpy use wide instructions.
    """

    def __init__(self, n_ids: int, lanes: int):
        self.n_ids = n_ids
        self.count = np.full(n_ids, 0.125)  # an id that was seen weighs eight times as much
        self.cum = np.arange(n_ids + 1) * 0.125
        self.guess = [np.zeros(1 << SLOT_BITS, np.int32) for _ in range(2)]
        self.sure = [np.zeros(1 << SLOT_BITS, np.int8) for _ in range(2)]
        self.hits = [np.full(LEVELS, 0.2) for _ in range(2)]
        self.seen = [np.full(LEVELS, 1.0) for _ in range(2)]
        self.last = np.zeros((2, lanes), dtype=np.int64)

    def predict(self, live: int) -> None:
        """Guesses and their shares of ``SCALE`` for the first ``live`` lanes; the order-0 share is what is left."""
        a, b = self.last[0, :live], self.last[1, :live]
        top = (1 << SLOT_BITS) - 1
        self.slot = [(a * 0x9E3779B1 >> 7) & top, ((a * 0x85EBCA77 + b * 0xC2B2AE3D) >> 9) & top]
        self.ids = [g[s] for g, s in zip(self.guess, self.slot)]
        self.level = [c[s].astype(np.intp) for c, s in zip(self.sure, self.slot)]
        self.share = []
        for hits, seen, level, part in zip(self.hits, self.seen, self.level, (0.35, 0.6)):
            # a slot without confidence gets nothing; all shares together leave order 0 at least a twentieth
            rate = np.floor(hits / seen * part * SCALE)
            rate[0] = 0
            self.share.append(rate[level])
        self.rest = SCALE - self.share[0] - self.share[1]
        self.per = 1.0 / self.cum[-1]

    def base(self, x: np.ndarray) -> np.ndarray:
        """Where the order-0 intervals of the ids begin, in the order-0 share alone."""
        return np.floor(self.rest * self.cum[x] * self.per)

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's interval in ``SCALE``."""
        (g1, g2), (m1, m2) = self.ids, self.share
        low = self.base(x)
        start = low + m1 * (g1 < x) + m2 * (g2 < x)
        return start, self.base(x + 1) - low + m1 * (g1 == x) + m2 * (g2 == x)

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose interval holds each value, and that interval."""
        (g1, g2), (m1, m2) = self.ids, self.share
        (s1, w1), (s2, w2) = self.interval(g1), self.interval(g2)
        # Away from the guesses, the order-0 intervals lie as they are, moved by the masses before them.
        moved = value - m1 * (value >= s1 + w1) - m2 * ((value >= s2 + w2) & (g1 != g2)) - m2 * ((g1 == g2) & (value >= s1 + w1))
        place = moved / (self.rest * self.per)
        order = np.argsort(place)  # sorted look-ups stay in the cache
        x = np.empty(len(place), np.int64)
        x[order] = np.searchsorted(self.cum, place[order], side="right") - 1
        x = np.minimum(np.maximum(x, 0), self.n_ids - 1)
        for g, s, w in ((g1, s1, w1), (g2, s2, w2)):
            x = np.where((value >= s) & (value < s + w), g, x)
        start, width = self.interval(x)
        # the quotient was rounded: a value at an interval's edge may belong to a neighbour
        while len(off := np.flatnonzero((value < start) | (value >= start + width))):
            x[off] += np.where(value[off] < start[off], -1, 1)
            start, width = self.interval(x)
        return x, start, width

    def update(self, x: np.ndarray) -> None:
        live = len(x)
        for k in range(2):
            slot = self.slot[k]
            state = self.level[k] + (self.ids[k] == x) * LEVELS
            times = np.bincount(state, minlength=2 * LEVELS)
            self.hits[k] = self.hits[k] * 0.98 + times[LEVELS:]
            self.seen[k] = self.seen[k] * 0.98 + times[:LEVELS] + times[LEVELS:]
            self.sure[k][slot] = STEP[state]  # where lanes share a slot, the last one stays
            fresh = np.flatnonzero(state <= 1)
            self.guess[k][slot[fresh]] = x[fresh]
        self.count += np.bincount(x, minlength=self.n_ids)
        np.cumsum(self.count, out=self.cum[1:])
        self.last[1, :live] = self.last[0, :live]
        self.last[0, :live] = x


#: Confidence after a miss, then after a hit, by confidence; a miss at 0 or 1 puts a new guess in the slot, at 1.
STEP = np.concatenate([np.maximum(np.arange(LEVELS) - 2, 0), np.minimum(np.arange(LEVELS) + 1, LEVELS - 1)]).astype(np.int8)
STEP[:2] = 1


def _layout(n: int) -> tuple[int, int, np.ndarray]:
    """Lanes and steps of a block of ``n`` ids, and how many lanes have an id at each step."""
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    size = np.minimum(steps, np.maximum(0, n - np.arange(lanes) * steps))  # falls off to the right only
    return lanes, steps, np.searchsorted(-size, -np.arange(steps), side="left")


def encode_block(ids: np.ndarray, n_ids: int) -> bytes:
    """One checksummed block; at most ``BLOCK_IDS`` ids, each below ``n_ids``.

    Layout, little-endian: number of ids, ``n_ids`` and CRC-32 of the ids (as unsigned 32-bit integers), each 32 bits;
    then the number of digits of each lane (32 bits) and the lanes' 16-bit digits, lane after lane.
    """
    n = len(ids)
    if n > BLOCK_IDS or n and not 0 <= int(ids.min()) <= int(ids.max()) < n_ids:
        raise ValueError("ids out of range for a block")
    head = np.array([n, n_ids], "<u4").tobytes() + zlib.crc32(ids.astype("<u4").tobytes()).to_bytes(4, "little")
    if not n:
        return head
    lanes, steps, lively = _layout(n)
    table = np.zeros(lanes * steps, dtype=np.int64)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)  # row t: the t-th id of each lane
    model = Model(n_ids, lanes)
    low, span = np.zeros(lanes), np.full(lanes, FULL)
    digits = np.zeros((steps * 2 + 5, lanes), np.int32)
    at = np.zeros(lanes, np.int64)

    def emit(which: np.ndarray) -> None:
        top = np.floor(low[which] / SMALL)  # a 17th bit is a carry, settled below
        digits[at[which], which] = top
        at[which] += 1
        low[which] = (low[which] - top * SMALL) * DIGIT

    for t, live in enumerate(lively.tolist()):
        x = table[t, :live]
        model.predict(live)
        start, width = model.interval(x)
        r = np.floor(span[:live] / SCALE)
        low[:live] += r * start
        span[:live] = r * width
        small = np.flatnonzero(span[:live] < SMALL)
        while len(small):
            emit(small)
            span[small] *= DIGIT
            small = small[span[small] < SMALL]
        model.update(x)
    for _ in range(3):
        emit(np.arange(lanes))
    for j in range(int(at.max()) - 1, 0, -1):
        digits[j - 1] += digits[j] >> 16
        digits[j] &= 0xFFFF
    used = np.arange(len(digits))[:, None] < at
    return head + at.astype("<u4").tobytes() + digits.T[used.T].astype("<u2").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; a wrong checksum raises ``ValueError``."""
    n, n_ids, crc = (int(v) for v in np.frombuffer(data, "<u4", 3))
    if not n:
        out = np.empty(0, np.int64)
    else:
        lanes, steps, lively = _layout(n)
        length = np.frombuffer(data, "<u4", lanes, 12).astype(np.int64)
        body = np.concatenate([np.frombuffer(data, "<u2", offset=12 + 4 * lanes), np.zeros(8, np.uint16)]).astype(np.float64)
        at = np.cumsum(length) - length
        code = (body[at] * DIGIT + body[at + 1]) * DIGIT + body[at + 2]  # the digits read, less ``low``
        at += 3
        span = np.full(lanes, FULL)
        model = Model(n_ids, lanes)
        table = np.zeros((steps, lanes), np.int64)
        for t, live in enumerate(lively.tolist()):
            model.predict(live)
            r = np.floor(span[:live] / SCALE)
            value = np.floor(code[:live] / r)
            value -= value * r > code[:live]
            x, start, width = model.find(value)
            code[:live] -= r * start
            span[:live] = r * width
            small = np.flatnonzero(span[:live] < SMALL)
            while len(small):
                code[small] = code[small] * DIGIT + body[at[small]]
                at[small] += 1
                span[small] *= DIGIT
                small = small[span[small] < SMALL]
            table[t, :live] = x
            model.update(x)
        out = table.T.reshape(-1)[:n]
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum doesn't match its ids")
    return out
