"""Counts of neighbouring subwords over all training rows, blended into a language model's probabilities.

A pair's probability is its count smoothed by the ids' own frequencies (Witten and Bell).  The weight of the pairs against the
model depends on how often the id before was seen, and is fitted by expectation maximisation on texts whose own pairs are
taken off the counts: for this, texts are brought down to how often each ratio of the two probabilities occurs, in bins, which add up over tasks.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 50
#: Bins of log ratios, ``FINE`` to a unit, about 0.
BINS, FINE = 1025, 16


def binned(ratio: np.ndarray) -> np.ndarray:
    """The bin of each natural log ratio; those beyond the ends belong to the last ones, where a mixture's weights no longer tell them apart."""
    return np.rint(np.clip(ratio * FINE, -(BINS // 2), BINS // 2)).astype(np.int64) + BINS // 2


def likeliest(held: np.ndarray, prior: float = 0.0) -> np.ndarray:
    """For each row of counts of binned ratios of one probability to another, the first one's weight in the likeliest mixture of both; ``prior`` places more keep near the mean."""
    ratio = np.exp((np.arange(BINS) - BINS // 2) / FINE)
    n, share = held.sum(1), np.full(len(held), 0.2)
    if not n.sum():
        return np.zeros(len(held))
    for _ in range(ROUNDS):
        w = share[:, None] * ratio
        due = (held * (w / (w + 1 - share[:, None]))).sum(1)
        share = (due + prior * due.sum() / n.sum()) / np.maximum(n + prior, 1)
    return share


class PairTable:
    """Pairs of a worker's rows: the id before (``size`` stands for a text's beginning) by the id."""

    def __init__(self, size: int):
        self.size, self.table = size, np.zeros((size + 1) * size, np.int64)

    def add(self, pool: np.ndarray, start: np.ndarray, many: np.ndarray, times: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> None:
        """Distinct words as stretches of ``pool`` that occur ``times``; ``codes`` are the words in order, of which those at ``begins`` begin a text."""
        ends = np.cumsum(many)
        flat = pool[np.repeat(start - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        np.add.at(self.table, flat[at] * self.size + flat[at + 1], np.repeat(times, many)[at])
        head, tail = flat[ends - many], flat[ends - 1]
        before = np.empty(len(codes), np.int64)
        before[1:] = tail[codes[:-1]]
        before[begins] = self.size
        np.add.at(self.table, before * self.size + head[codes], 1)


class PairBlend:
    """Mixes the probabilities of pairs with a model's."""

    def __init__(self, counts: np.ndarray):
        n = counts.sum(1)
        alone = counts.sum(0) + 1.0
        self.alone = alone / alone.sum()
        self.kinds = np.maximum(1, (counts > 0).sum(1))
        self.weight = n + self.kinds  # of the id before: its count, and that of its kinds
        self.table = ((counts + self.kinds[:, None] * self.alone) / (n + self.kinds)[:, None]).astype(np.float32).reshape(-1)
        self.bucket = np.frexp(n.astype(np.float64))[1]  # how many bits the count has
        self.levels = 65
        self.size, self.share = counts.shape[1], np.zeros(len(n), np.float32)

    def before(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The id before each id of texts that ``first`` cuts."""
        out = np.empty(len(ids), np.int64)
        out[1:] = ids[:-1]
        out[first[:-1]] = self.size
        return out

    def others(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probabilities of pairs that are among those counted, each one's own occurrence taken off its count."""
        least, weight = (self.kinds * 1.0)[before] * self.alone[ids], self.weight[before]
        return np.maximum(self.table[before * self.size + ids] * weight - 1.0, least) / np.maximum(weight - 1, self.kinds[before])

    def fitted(self, held: np.ndarray) -> np.ndarray:
        """The weight of pairs at each level, from counts of ratios; levels that few places have keep near the mean."""
        return likeliest(held, 50)

    def __call__(self, before: np.ndarray, ids: np.ndarray, lp: np.ndarray) -> np.ndarray:
        w = self.share[before]
        return np.log(w * self.table[before * self.size + ids] + (1 - w) * np.exp(lp.astype(np.float64)))
