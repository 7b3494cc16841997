"""A small causal self-attention language model over subword ids, in numpy.

One attention layer with relative-position biases, one hidden layer, and an output in two steps (a class of ids, then the id
within its class), so that a token costs two short softmaxes.  Ids that training never meets make up the last class, with equal shares.  Without absolute positions, queries, keys and values
depend on the id alone and are look-ups when scoring.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np

WINDOW, STRIDE = 32, 16
WIDE, HIDDEN, GROUP = 32, 32, 32
#: Logits are not brought down by their maxima when scoring; if one is too large for that, all are cut here.
HIGH = np.float32(60)
#: Weights that are brought up to date at a time, so that they stay in the cache meanwhile.
PART = 1 << 13
#: Windows scored at a time.
BATCH = 64
#: Targets whose probabilities are worked out together, class by class; those of classes are, so many at a time.
SETTLED, CHUNK = 1 << 14, 1 << 11


class AttentionModel:
    """``n_ids`` ids to predict; id ``n_ids`` stands for the beginning of a text and is only read."""

    def __init__(self, n_ids: int, order: np.ndarray, seen: int | None = None, seed: int = 11):
        """``order`` lists the ids from the most frequent down; classes are runs of it, but for what follows the first ``seen`` ids."""
        rng = np.random.default_rng(seed)
        seen = n_ids if seen is None else max(1, seen)
        self.n_ids, self.known, self.unmet = n_ids, -(-seen // GROUP), n_ids - seen
        self.groups = self.known + (self.unmet > 0)
        place = np.empty(n_ids, np.int64)
        place[order] = np.arange(n_ids)
        self.cls, self.within = np.where(place < seen, place // GROUP, self.known), place % GROUP
        f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        d = WIDE
        self.p = {
            "e": f(n_ids + 1, d) * np.float32(np.sqrt(n_ids + 1) * 0.3), "q": f(d, d), "k": f(d, d), "v": f(d, d), "o": f(d, d), "r": np.zeros(WINDOW, np.float32),
            "w1": f(d, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": f(HIDDEN, d) * np.float32(0.5),
            "c": f(d, self.groups) * np.float32(0.3), "bc": np.zeros(self.groups, np.float32), "d": f(self.known, d, GROUP) * np.float32(0.3), "bd": np.zeros((self.known, GROUP), np.float32),
        }
        last = seen - (self.known - 1) * GROUP
        self.p["bd"][-1, last:] = -30.0  # places of no id
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
        self.gap, self.ahead = np.maximum(gap, 0), gap < 0

    def step(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (nats) and gradients over windows of input ids ``x``, targets ``y`` and the mask of real targets."""
        lp, g = self.learn(x, y, used)
        return -float(lp.sum() / max(1, len(lp))), g

    def learn(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Natural log probability of each real target, and gradients of the mean loss."""
        p, d = self.p, WIDE
        kind, shape = p["e"].dtype, (*x.shape, WIDE)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        root, one = kind.type(np.sqrt(d)), np.ones(max(d, len(x)), kind)
        # of the ids that occur, once each: queries (brought to the keys' side) and values (through "o")
        per = _Sums(x.reshape(-1), self.n_ids)
        met, match, carry = p["e"][per.met], p["q"] @ p["k"].T / root, p["v"] @ p["o"]
        e, q, v = (np.take(t, per.row, 0).reshape(shape) for t in (met, met @ match, met @ carry))
        s = q @ e.transpose(0, 2, 1)
        s += np.where(self.ahead, kind.type(-1e9), p["r"][self.gap])
        s, total = _exps(s)
        total = total.reshape(-1, 1)
        ctx = flat(s @ v)
        ctx /= total
        # u, z: the last column, of ones, is for biases
        u = np.empty((len(ctx), d + 1), kind)
        u[:, d] = 1
        np.add(flat(e), ctx, out=u[:, :d])
        h = u @ np.vstack([p["w1"], p["b1"]])
        np.maximum(h, 0, out=h)
        z = h @ np.pad(p["w2"], ((0, 0), (0, 1)))
        z += u
        # targets in the order of their classes
        used = np.flatnonzero(used)
        y = y.reshape(-1)[used]
        cls = self.cls[y]
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        at, cls, within = used[order], cls[order], self.within[y[order]]
        cut = np.searchsorted(cls, np.arange(self.groups + 1)).tolist()
        zs, every, share = np.take(z, at, 0), np.arange(len(at)), kind.type(1 / max(1, len(at)))
        pc, own, t = _picked(zs @ np.vstack([p["c"], p["bc"]]), every, cls)
        lp = own - np.log(t)
        pc *= (share / t)[:, None]
        pc[every, cls] -= share
        gc = zs.T @ pc
        g = {"c": gc[:d], "bc": gc[d]}
        dz = pc @ p["c"].T
        # ids within their classes
        end = cut[self.known]
        lp[end:] -= np.log(max(1, self.unmet))
        each, within = every[:end], within[:end]
        inner, pw = np.concatenate([p["d"], p["bd"][:, None]], 1), np.empty((end, GROUP), kind)
        runs = [(c, slice(a, b)) for c, (a, b) in enumerate(pairwise(cut[: self.known + 1])) if a < b]
        for c, r in runs:
            np.matmul(zs[r], inner[c], out=pw[r])
        pw, own, t = _picked(pw, each, within)
        lp[:end] += own - np.log(t)
        pw *= (share / t)[:, None]
        pw[each, within] -= share
        gd = np.zeros_like(inner)
        for c, r in runs:
            np.matmul(zs[r].T, pw[r], out=gd[c])
            dz[r] += pw[r] @ p["d"][c].T
        g["d"], g["bd"] = gd[:, :d], gd[:, d]
        full = np.zeros((len(z), d), kind)
        full[at] = dz
        g["w2"] = h.T @ full
        dh = full @ p["w2"].T
        dh *= h > 0
        gu = u.T @ dh
        g["w1"], g["b1"] = gu[:d], gu[d]
        du = dh @ p["w1"].T
        du += full
        part = du / total
        ctx *= part
        part = part.reshape(shape)
        ds = part @ v.transpose(0, 2, 1)
        ds -= (ctx @ one[:d]).reshape(*x.shape, 1)
        ds *= s
        g["r"] = np.bincount(self.gap[~self.ahead], (one[: len(x)] @ ds.reshape(len(x), -1)).reshape(self.gap.shape)[~self.ahead], WINDOW).astype(kind)
        du += flat(ds.transpose(0, 2, 1) @ q)
        # what follows is linear in the embeddings, so that an id's places are summed first
        asked, given = per(ds @ e), per(s.transpose(0, 2, 1) @ part)
        gm, gv = met.T @ asked, met.T @ given
        g["q"], g["k"], g["v"], g["o"] = gm @ p["k"] / root, gm.T @ p["q"] / root, gv @ p["o"].T, p["v"].T @ gv
        g["e"] = np.zeros_like(p["e"])
        g["e"][per.met] = per(du) + asked @ match.T + given @ carry.T
        out = np.empty_like(lp)
        out[order] = lp
        return out, g

    def train(self, texts: list[np.ndarray], steps: int, batch: int = 128, rate: float = 1e-2, seed: int = 5) -> list[float]:
        """Adam over windows drawn from texts of ids, each with the id before it (or the beginning) in front; gives the losses."""
        rng, adam = np.random.default_rng(seed), Adam(self)
        flat = np.concatenate(texts).astype(np.int64)
        end_of = np.cumsum([len(t) for t in texts])
        losses = []
        for t in range(1, steps + 1):
            at = rng.integers(0, len(flat), batch)
            now = rate * min(1.0, t / 50) * (0.5 * (1 + np.cos(np.pi * t / steps)) + 0.02)
            lp = adam.step(*windows_at(flat, at, end_of[np.searchsorted(end_of, at, side="right")]), now)
            losses.append(-float(lp.mean()))
        return losses

    def ready(self) -> "AttentionModel":
        """Fill the look-ups used for scoring."""
        p = self.p
        q, k, v = (p["e"] @ p[x] for x in "qkv")
        self.own = np.hstack([q / np.float32(np.sqrt(WIDE)), p["e"]])  # what a place needs of its own id
        self.key, self.value = k, v @ p["o"]
        self.cut = False
        self.cls8 = self.cls.astype(np.uint16)  # sorts by radix
        bias = np.where(self.ahead, np.float32(-1e9), p["r"][self.gap])
        self.first, self.late = bias[:STRIDE, :STRIDE].astype(np.float32), bias[WINDOW - STRIDE :].astype(np.float32)
        return self

    def outputs(self, x: np.ndarray, late: bool) -> np.ndarray:
        """Output vectors of the last ``STRIDE`` places of windows of ids; windows are ``WINDOW`` long if ``late``, else ``STRIDE``."""
        p = self.p
        own = np.take(self.own, x[:, -STRIDE:], 0)
        s = np.matmul(own[:, :, :WIDE], np.take(self.key, x, 0).transpose(0, 2, 1))
        s += self.late if late else self.first
        if self.cut:
            np.minimum(s, HIGH, out=s)
        np.exp(s, out=s)
        u = np.matmul(s, np.take(self.value, x, 0))
        u /= np.matmul(s, np.ones(s.shape[2], np.float32))[:, :, None]
        u += own[:, :, WIDE:]
        u = u.reshape(-1, WIDE)
        h = u @ p["w1"]
        h += p["b1"]
        np.maximum(h, 0, out=h)
        u += h @ p["w2"]
        return u

    def log_probabilities(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target given its output vector."""
        p = self.p
        order = np.argsort(self.cls8[y], kind="stable")
        y, z = y[order], np.take(z, order, 0)
        cls, within = self.cls[y], self.within[y]
        cut = np.searchsorted(cls, np.arange(self.groups + 1)).tolist()
        part = np.empty(len(y), np.float32)
        for a in range(0, len(y), CHUNK):
            part[a : a + CHUNK] = _log_pick(z[a : a + CHUNK], p["c"], p["bc"], cls[a : a + CHUNK], self.cut)
        for c in range(self.known):
            a, b = cut[c], cut[c + 1]
            if a < b:
                part[a:b] += _log_pick(z[a:b], p["d"][c], p["bd"][c], within[a:b], self.cut)
        part[cut[self.known] :] -= np.log(max(1, self.unmet))
        out = np.empty_like(part)
        out[order] = part
        return out

    @np.errstate(over="ignore", invalid="ignore", divide="ignore")
    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of each id; ``first`` cuts ``ids`` into texts (texts + 1 entries), each ending in its end id.

        Windows overlap: each scores its last ``STRIDE`` ids with at least as many before them (at a text's beginning, all that there are).
        """
        n = np.diff(first)
        texts = len(n)
        # inputs: the beginning, then all but the last id; the target of an input is the id after it
        shift = first[:-1] + np.arange(texts)
        seq = np.full(len(ids) + texts + WINDOW, self.n_ids, np.int32)
        seq[np.arange(len(ids)) + 1 + np.repeat(np.arange(texts), n)] = ids
        chunks = -(-n // STRIDE)
        owner = np.repeat(np.arange(texts), chunks)
        turn = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = shift[owner] + turn * STRIDE
        left = n[owner] - turn * STRIDE
        place = first[owner] + turn * STRIDE
        out = np.empty(len(ids), np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> None:
            z, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            out[at] = self.log_probabilities(z, ids[at])

        for late in (False, True):
            pick = np.flatnonzero((turn > 0) == late)
            back = WINDOW - STRIDE if late else 0
            for a in range(0, len(pick), BATCH):
                w = pick[a : a + BATCH]
                x = seq[start[w][:, None] + np.arange(-back, STRIDE)]
                at = place[w][:, None] + np.arange(STRIDE)
                z = self.outputs(x, late)
                if int(left[w].min()) < STRIDE:
                    used = (np.arange(STRIDE) < left[w][:, None]).reshape(-1)
                    held.append((z[used], at.reshape(-1)[used]))
                else:
                    held.append((z, at.reshape(-1)))
                waiting += len(held[-1][1])
                if waiting >= SETTLED:
                    settle()
                    waiting = 0
        if held:
            settle()
        if not self.cut and not np.isfinite(out).all():
            self.cut = True
            return self.score(ids, first)
        return out


class Adam:
    """Steps of a model's training; ``m`` and ``s`` hold 10 and 100 times the means."""

    def __init__(self, model: AttentionModel):
        self.model, self.done = model, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, used: np.ndarray, rate: float) -> np.ndarray:
        """One step; gives the log probabilities of the real targets before it."""
        lp, g = self.model.learn(x, y, used)
        self.done += 1
        one, two = 1 - 0.9**self.done, 1 - 0.99**self.done
        size = float(rate / one * np.sqrt(two))
        for k, w in self.model.p.items():
            whole = [t.reshape(-1) for t in (w, self.m[k], self.s[k], g[k])]
            for a in range(0, w.size, PART):
                p, m, s, new = (t[a : a + PART] for t in whole)
                m *= 0.9
                m += new
                new *= new
                s *= 0.99
                s += new
                np.sqrt(s, out=new)
                new += 1e-7 * two**0.5
                np.divide(m, new, out=new)
                new *= size
                p -= new
        return lp


def windows_at(flat: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and the mask of real targets of the windows that begin at ``at``; their texts end before ``stop``."""
    pos = at[:, None] + np.arange(WINDOW + 1)
    ok = pos < stop[:, None]
    ids = flat[np.minimum(pos, len(flat) - 1)]
    used = ok[:, 1:]
    return np.where(ok[:, :-1], ids[:, :-1], 0), np.where(used, ids[:, 1:], 0), used


class _Sums:
    """Sums of rows by id: ``met`` are the different ids, ``row`` tells each place its own."""

    def __init__(self, ids: np.ndarray, most: int):
        self.by = np.argsort(ids.astype(np.uint16) if most < 1 << 16 else ids, kind="stable")
        here, new = ids[self.by], np.ones(len(ids), bool)
        np.not_equal(here[1:], here[:-1], out=new[1:])
        self.begin = np.flatnonzero(new)
        self.met = here[self.begin]
        self.row = np.empty(len(ids), np.intp)
        self.row[self.by] = np.cumsum(new) - 1

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        rows = np.take(rows.reshape(-1, rows.shape[-1]), self.by, 0)
        # two columns are added at a time, as a complex number
        return np.add.reduceat(rows.view(np.result_type(rows.dtype, np.complex64)), self.begin).view(rows.dtype)


@np.errstate(over="ignore", invalid="ignore")
def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, and their sums along the last axis; where numbers call for it, ``x`` is brought down by its maxima, in place."""
    one = np.ones(x.shape[-1], x.dtype)
    out = np.exp(x)
    total = out @ one
    if total.size and not (total.min() > 1e-20 and total.max() < 1e20):
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=out)
        total = out @ one
    return out, total


def _picked(x: np.ndarray, every: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials, the logits of one column of each row, and the sums of rows."""
    out, total = _exps(x)
    return out, x[every, at], total


def _log_pick(z: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray, cut: bool) -> np.ndarray:
    """Log softmax of each row of ``z @ weight + bias`` at one column."""
    x = z @ weight
    x += bias
    if cut:
        np.minimum(x, HIGH, out=x)
    own = x.ravel()[np.arange(len(x)) * x.shape[1] + at]
    np.exp(x, out=x)
    own -= np.log(x @ np.ones(x.shape[1], np.float32))
    return own
