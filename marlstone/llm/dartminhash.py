"""DartMinHash signatures of weighted sets.

Every element owns the region ``[0, weight) x [0, inf)`` of a plane of weight and rank, into which darts fall at rate one,
always the same for the same element.  The plane is cut into strips of doubling width, so that only strips that reach into a
region are looked at; within a strip, darts come in order of rank.  A dart carries a coordinate of the signature, and each
coordinate keeps its earliest dart.  Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity.  Only darts below a rank of about ``k (ln k + 2) / total weight`` are thrown, whatever the number
of elements; the few sets that leave a coordinate empty are thrown again up to twice the rank.
"""

from __future__ import annotations

import numpy as np

from marlstone.llm.textbatch import mix

_UNIT = 2.0**-64


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) + 0.5) * _UNIT


def signatures(element: np.ndarray, owner: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """``n`` x ``k`` signatures of 64-bit values; ``owner`` tells the set (0 to n - 1) of each distinct element.

    Sets without elements get zeros.  Weights are positive; left out, all are one.
    """
    sig = np.zeros((n, k), np.uint64)
    if not len(element):
        return sig
    total = np.bincount(owner, weight, n)
    todo = total > 0
    bound = k * (np.log(k) + 2)
    while todo.any():
        pick = todo[owner]
        e, o = element[pick], owner[pick]
        w = np.ones(len(e)) if weight is None else np.asarray(weight, np.float64)[pick]
        limit = bound / total[o]
        filled = np.zeros(n * k, np.uint64)
        seen = np.zeros(n * k, bool)
        ranks, keys, ids = [], [], []
        strip, low, wide = 0, 0.0, 1.0
        while len(e):
            seed = mix(e + np.uint64(strip * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            at, rank, s = np.arange(len(e)), np.zeros(len(e)), seed
            while len(at):
                s = mix(s + np.uint64(0xA0761D6478BD642F))
                rank = rank - np.log(_uniform(s)) / wide
                alive = rank < limit[at]
                at, rank, s = at[alive], rank[alive], s[alive]
                side = mix(s ^ np.uint64(0xE7037ED1A0B428DB))
                inside = low + wide * _uniform(side) < w[at]
                coordinate = (s >> np.uint64(11)).astype(np.int64) % k
                ranks.append(rank[inside])
                keys.append((o[at] * k + coordinate)[inside])
                ids.append(s[inside])
            low, wide, strip = low + wide, max(1.0, low + wide), strip + 1
            more = w > low
            e, o, w, limit = e[more], o[more], w[more], limit[more]
        order = np.argsort(np.concatenate(ranks))[::-1]
        key = np.concatenate(keys)[order]
        filled[key] = np.concatenate(ids)[order]  # the earliest is written last
        seen[key] = True
        whole = seen.reshape(n, k).all(1) & todo
        sig[whole] = filled.reshape(n, k)[whole]
        todo &= ~whole
        bound *= 2
    return sig
