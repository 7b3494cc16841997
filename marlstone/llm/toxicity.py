"""Toxicity with a gap-weighted subsequence string kernel and a support vector machine.

The kernel of two words sums, over all three-letter subsequences that both hold, ``DECAY`` to the length of the stretch
each occupies; divided by the root of the self-kernels it lies between 0 and 1.  Gaps and inserted characters lower it
but don't break it.  A linear squared-hinge SVM is trained on Nyström features of words: landmarks are the insults found
and a sample of clean words.  As a Nyström machine is a weighted sum of kernels with its landmarks, and the kernel is an
inner product of subsequence weights, the sum over landmarks is folded into one weight per subsequence; a word then costs
one look-up per subsequence, with exactly the same result.  A text scores as its worst word.

Training on labelled sentences (multiple instances).  A toxic sentence is one that holds an insult, which its label doesn't point out, and a clean
one holds none.  So the words whose rate among toxic sentences exceeds that among clean ones by more than chance are trained by the
labels of all sentences that hold them: as insults by the toxic share, as harmless by the clean one, so that wrong labels and
quotations weigh no more than they should.  All other words are harmless, in whichever sentences.  An insult follows several
different words in toxic sentences, since copies of one sentence repeat all its words, but with the same neighbours.
Variants with characters put in are added, and harmless words that the machine gets wrong are added to its training until it gets them right.

Training uses a bounded sample of labelled rows (``SAMPLE`` of each label, texts of at most ``SAMPLE_BYTES``).

Defined results: null and empty texts score as the machine's lowest (near 0); with no usable labels every score is 0;
a ``doc_id`` labelled both ways counts as toxic, and of several texts of one id the one with the least hash is learned from; null labels are left
out; repeated rows repeat; a null ``doc_id`` has no label; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.bpe import PIECE_BYTES, Recent
from marlstone.llm.langid import remainder
from marlstone.llm.textbatch import Words, pieces

SAMPLE, SAMPLE_BYTES = 4000, 1 << 16
#: An insult's rate in clean texts, as a share of that in toxic ones, is at most this, or twice that of the most telling words if labels are noisy.
TOLERANCE, SUREST = 0.05, 10
#: Different words that an insult need follow at most, however large the sample; near copies give a word a few.
CONTEXTS = 16
DECAY = 0.6
SYMBOLS = 48
#: Shorter words are never insults.
SHORTEST = 3
#: Longer words are read in windows of this many characters, half overlapping, so that all of a word counts.
WINDOW = 20
LANDMARKS = 300
THRESHOLD = 0.7
STEEPNESS = 4.0
#: Decision of a word that shares nothing with any landmark, and of no word at all.
BIAS, LOWEST = -1.0, -3.0
_memo: dict[int, Recent] = {}


@lru_cache(maxsize=1 << 16)
def symbol(ch: str) -> int:
    """1-26 letters without case, 27-43 other letters by code point, 44 digits, 45-46 other characters; 0 is a word's edge."""
    ch = ch.lower()[:1]
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 + ord(ch) % 17 if ch.isalpha() else 44 if ch.isdigit() else 45 + ord(ch) % 2


@lru_cache(maxsize=64)
def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of ``n`` symbols, and the weight of each."""
    t = np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3)
    return t, DECAY ** (t[:, 2] - t[:, 0] + 1.0)


def trim(word: str) -> str:
    """Without marks at its ends."""
    return word.lower().strip(".,;:!?\"'()[]{}|*_-<>/\\`~…«»„“”¿¡")


def views(word: str) -> list[list[int]]:
    """The symbol windows of a word."""
    if len(word) < SHORTEST:
        return []
    s = [0, *(symbol(c) for c in word), 0]
    if len(s) <= WINDOW:
        return [s]
    half = WINDOW // 2
    return [s[a : a + WINDOW] for a in range(0, len(s) - half, half)]


def subsequences(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length (a row each): codes of their triples, weights of the triples, and the words' norms."""
    t, weight = triples(block.shape[1])
    codes = (block[:, t[:, 0]] * SYMBOLS + block[:, t[:, 1]]) * SYMBOLS + block[:, t[:, 2]]
    order = np.argsort(codes, axis=1)
    sorted_codes = np.take_along_axis(codes, order, 1)
    total = np.cumsum(weight[order], axis=1)
    last = np.ones(codes.shape, bool)
    last[:, :-1] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    # per distinct subsequence, the sum of its weights is a difference of running totals
    row, col = np.nonzero(last)
    ends = total[row, col]
    begin = np.concatenate([[0.0], ends[:-1]])
    begin[np.concatenate([[True], row[1:] != row[:-1]])] = 0.0
    norm = np.sqrt(np.bincount(row, (ends - begin) ** 2, len(block)))
    return codes, weight, norm


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word windows grouped by length: the words they belong to, and their symbols."""
    groups: dict[int, tuple[list[int], list[list[int]]]] = defaultdict(lambda: ([], []))
    for k, w in enumerate(words):
        for v in views(w):
            groups[len(v)][0].append(k)
            groups[len(v)][1].append(v)
    for n, (at, rows) in sorted(groups.items()):
        step = max(64, (1 << 20) // len(triples(n)[1]))
        for a in range(0, len(at), step):
            yield np.array(at[a : a + step]), np.array(rows[a : a + step], dtype=np.int64)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values; a word longer than a window takes its best window."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    dense = np.zeros((SYMBOLS**3, len(landmarks)), np.float32)
    for at, block in by_length(landmarks):
        codes, weight, norm = subsequences(block)
        for k, c, n in zip(at.tolist(), codes, norm):
            np.add.at(dense[:, k], c, weight / n)
    for at, block in by_length(words):
        codes, weight, norm = subsequences(block)
        for s in range(0, len(at), 256):
            value = np.einsum("ntl,t->nl", dense[codes[s : s + 256]], weight.astype(np.float32)) / norm[s : s + 256, None]
            np.maximum.at(out, at[s : s + 256], value)
    return out


class Machine:
    """The trained machine: a weight per subsequence."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision values; a word too short to be an insult gets ``LOWEST``."""
        best = np.full(len(words), LOWEST)
        for at, block in by_length(words):
            codes, weight, norm = subsequences(block)
            np.maximum.at(best, at, self.weight[codes] @ weight / norm + BIAS)
        return best


def solve(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM by Newton's method on the rows inside the margin."""
    w = np.zeros(z.shape[1])
    active = np.ones(len(y), bool)
    keep = ridge * cost.sum() * np.eye(z.shape[1])
    loss = lambda v: v @ keep @ v + (cost * np.maximum(0, 1 - y * (z @ v + BIAS)) ** 2).sum()
    old = loss(w)
    for _ in range(rounds):
        a = z[active] * cost[active, None]
        step, size = np.linalg.solve(keep + a.T @ z[active], a.T @ (y[active] - BIAS)) - w, 1.0
        while (now := loss(w + size * step)) > old and size > 1e-4:
            size /= 2
        if now >= old * (1 - 1e-9):
            break
        w, old = w + size * step, now
        active = y * (z @ w + BIAS) < 1
    return w


def spread(words: list[str], most: int) -> list[str]:
    """Up to ``most`` words by pivoted Cholesky: each is the one that those before it explain least."""
    left, chosen, rows = np.ones(len(words)), [], np.zeros((0, len(words)))
    while len(chosen) < most and len(words) and (k := int(left.argmax())) not in chosen and left[k] > 1e-3:
        row = (kernel(words, [words[k]])[:, 0].astype(np.float64) - rows.T @ rows[:, k]) / np.sqrt(left[k])
        rows, left = np.vstack([rows, row]), left - row**2
        chosen.append(k)
    return [words[k] for k in chosen]


def disguised(word: str, rng: np.random.Generator) -> list[str]:
    """The word with characters put in: one, some, or one in each gap."""
    marks = list(".-*_ex1")
    out = ["".join(c + m for c, m in zip(word, m * len(word)))[: 2 * len(word) - 1] for m in (".", "-", "*")]
    for n in (1, 1, 2):
        w = list(word)
        for _ in range(n):
            w.insert(int(rng.integers(1, len(w))), str(rng.choice(marks)))
        out.append("".join(w))
    return out


def folded(marks: list[str], alpha: np.ndarray) -> Machine:
    """The machine whose decision is the sum of a word's kernels with the landmarks, times ``alpha``."""
    weight = np.zeros(SYMBOLS**3)
    for at, block in by_length(marks):
        codes, tw, norm = subsequences(block)
        for k, c, n in zip(at.tolist(), codes, norm):
            np.add.at(weight, c, alpha[k] * tw / n)
    return Machine(weight)


def telling(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, words: list[str]) -> set[str]:
    """Of ``words``, those that are in clean texts far more rarely than in toxic ones, by more than chance would bring about in one of them all."""
    share, found = n_toxic / max(1, n_toxic + n_clean), []
    for w in words:
        t, c = toxic[w], clean[w]
        if c * n_toxic < t * n_clean:
            n = t + c
            # Chernoff's bound on t or more of the n texts being toxic
            excess = t * np.log(t / n / share) + (c * np.log(c / n / (1 - share)) if c else 0.0)
            if excess > np.log(len(words)):
                found.append((-excess, w, c * n_toxic / (t * n_clean)))
    found.sort()
    noise = float(np.median([r for *_, r in found[:SUREST]])) if found else 0.0
    return {w for _, w, r in found if r <= max(TOLERANCE, 2 * noise)}


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS, contexts: float = 0.01, mined: int = 7) -> Machine | None:
    """Train on whole texts of both labels; an insult follows ``CONTEXTS`` different words, or ``contexts`` times the toxic texts if that is less, and 3 at least."""
    contexts = min(CONTEXTS, max(3, round(contexts * len(toxic))))
    after: dict[str, set[str]] = defaultdict(set)
    for text in toxic:
        words = [trim(w) for w in text.split()]
        for a, b in zip(["", *words], words):
            if len(after[b]) < CONTEXTS:
                after[b].add(a)
    n_toxic, n_clean = len(set(toxic)), len(set(clean))
    foul, fair = (Counter(w for text in set(texts) for w in {trim(w) for w in text.split()} if len(w) >= SHORTEST) for texts in (toxic, clean))
    insults = sorted(telling(foul, fair, n_toxic, n_clean, sorted(w for w in foul if len(after[w]) >= contexts)))
    harmless = Counter({w: n for w, n in fair.items() if w not in insults})
    if not insults or not harmless:
        return None
    # the labels of the sentences that hold an insult, as shares
    share = {w: foul[w] / n_toxic / (foul[w] / n_toxic + fair[w] / n_clean) for w in insults}
    rng, pool = np.random.default_rng(7), sorted(harmless)
    common = [w for w, _ in sorted(harmless.items(), key=lambda x: (-x[1], x[0]))][:1500]
    negative = list(dict.fromkeys([*common, *rng.choice(pool, min(len(pool), 3000), replace=False).tolist()]))
    positive = list(dict.fromkeys([*insults, *(d for w in insults for d in disguised(w, rng))]))
    quoted = [w for w in insults if fair[w]]
    third, machine = landmarks // 3, None
    marks = [*spread(insults, third), *spread(negative[:2000], third)]
    for turn in range(mined):
        if turn == 1:  # the harmless words that are hardest to tell from insults become landmarks too
            marks += spread(hard, third)
        if turn < 2:
            values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
            good = values > 1e-4 * values.max()
            root = vectors[:, good] / np.sqrt(values[good])
            features = lambda words: kernel(words, marks) @ root  # noqa: B023, E731
            zp, zq, zn = features(positive), features(quoted), features(negative)
        else:
            zn = np.vstack([zn, features(more)])
        y = np.concatenate([np.ones(len(zp)), -np.ones(len(zq) + len(zn))])
        cost = np.concatenate([[20.0 * share[w] if w in share else 1.0 for w in positive], [20.0 * (1 - share[w]) for w in quoted], np.ones(len(zn))])
        machine = folded(marks, root @ solve(np.vstack([zp, zq, zn]), y, cost, 1e-6))
        decided = machine.decide(pool)
        nearest = np.argsort(-decided, kind="stable")[:30000]
        known = set(negative)
        more = [pool[k] for k in nearest[:5000].tolist() if decided[k] > -0.6 and pool[k] not in known]
        hard = [pool[k] for k in nearest[:1500].tolist()]
        pool = [pool[k] for k in nearest.tolist()]  # the rest is far away, and further training moves little
        negative += more
        if turn and not more:
            break
    return machine


def decide_texts(machine: Machine, texts: pa.Array) -> np.ndarray:
    """The largest decision value among each text's words; runs of single characters are also read as one word."""
    words = Words(texts)
    codes, chunks = (lambda c: (c.indices.to_numpy(), c.dictionary.to_pylist()))(words.array().dictionary_encode())
    memo = _memo.setdefault(hash(machine.weight.tobytes()), Recent())
    each = [memo.get(c) for c in chunks]
    lacking = [k for k, v in enumerate(each) if v is None]
    if lacking:
        names = [trim(chunks[k]) for k in lacking]
        only = list(dict.fromkeys(names))
        value = dict(zip(only, machine.decide(only).tolist()))
        for k, name in zip(lacking, names):
            each[k] = value[name]
            memo.put(chunks[k], each[k])
    out = np.full(len(texts), LOWEST)
    decided = np.array(each)[codes] if len(codes) else np.empty(0)
    full = np.flatnonzero(np.diff(words.first))
    if len(full):
        out[full] = np.maximum(out[full], np.maximum.reduceat(decided, words.first[:-1][full]))
    single = np.array([len(c) <= 3 and len(trim(c)) == 1 for c in chunks], bool)[codes] if len(codes) else np.empty(0, bool)
    edge = np.zeros(len(codes) + 1, bool)  # runs end where rows do
    edge[words.first] = True
    starts = np.flatnonzero(single & (edge[:-1] | ~np.concatenate([[False], single[:-1]])))
    stops = np.flatnonzero(single & (edge[1:] | ~np.concatenate([single[1:], [False]]))) + 1
    row = np.searchsorted(words.first, starts, side="right") - 1
    long = stops - starts >= 4
    spelt = ["".join(trim(chunks[c]) for c in codes[a:b]) for a, b in zip(starts[long], stops[long])]
    if spelt:
        np.maximum.at(out, row[long], machine.decide(spelt))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, sample: int) -> tuple[list[str], list[str]]:
    """Texts of up to ``sample`` toxic and ``sample`` clean documents outside the held-out fold, drawn by hash."""
    known = labels.select(labels["doc_id"].alias("id"), labels[label_col].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.where(remainder(F.col("id"), folds) != held).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 30))
    share = lambda y: min(1 << 30, int(sample / max(1, counts.get(y, 0)) * (1 << 30)) + 1)
    drawn = known.where(draw < F.when(F.col("y") == 1, share(1)).otherwise(share(0))).where(F.col("y").isin(0, 1)).orderBy(draw, "id").limit(2 * sample + 1000)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.octet_length(docs[text_col]) <= SAMPLE_BYTES)
    # a text per id drawn, so this is bounded
    found = rows.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("id").select("text", "y")
    out: tuple[list[str], list[str]] = ([], [])
    for r in found.toLocalIterator():
        out[r.y].append(r.text)
    return out[1], out[0]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from ``threshold`` up)."""
    machine = fit(*labelled_sample(docs, labels, id_col, text_col, label_col, folds, held, sample))
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # SYMBOLS ** 3 weights
    src = docs.select(docs[id_col].alias("doc_id"), (remainder(docs[id_col], folds) == held).alias("held_out"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in pieces(batches, limit=PIECE_BYTES):
            score = 1 / (1 + np.exp(-STEEPNESS * decide_texts(m, b.column("text")))) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
