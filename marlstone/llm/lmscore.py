"""Language-model scores of documents, beside a unigram base.

Learning.  All training documents are learned from.

1. Every task counts its words, and its pairs of neighbouring subwords, and sets the passages aside on which the training begins.
   Word counts are dealt out by hash into shards, so that the table of all words is never in one place; pairs are summed
   in a table of fixed size (ids by ids).
2. A causal self-attention model (see ``attention``) over subwords - the first ``MERGES`` merges of a public vocabulary over bytes - begins
   on the driver with a draw of about ``SAMPLE`` passages, so that all tasks start from one place.  Then tasks go on from there, each with
   every subword of its documents, and their weights are averaged by the windows they saw.  On the way, the
   weights of pairs and of frequent words are fitted: what the model gives each subword before it is trained on it, against
   its pair, and so with words, is counted by ratio (``BINS``), and these counts are summed over all documents.
3. While documents are scored, texts are cut where the hash of the last ``MEMORY`` words says so (at one place in
   ``SEGMENT``).  What follows such words, up to the next cut, is a segment; all segments of training documents are counted in shards.

Scoring.  The model scores every subword once, in overlapping windows.  Its probabilities are mixed with those of the pairs (see
``subword_pairs``); a word's probability, the product of its subwords', is mixed with the frequency of the word where it is a
frequent one; a segment's, the product of its words', with the frequency of the segment after the words before it, where these were met in other
documents (Witten and Bell's weight; a document's own occurrences are taken off, so that none is recalled from itself).  Each
step mixes distributions over the same outcomes, by weights that depend on what comes before alone, and so gives a
distribution.  The score is the log10 probability of the text and its end.

Upper-case ASCII letters count as lower-case ones.  Words are told apart by 64-bit hashes, segments by those of their words.

Documents are handled piece by piece (``SCORED_BYTES`` of text).  A piece asks the shards for the counts of its distinct rare words and
segments, each once, however many of its rows hold them, and the answers go back to the piece.

Defined results: a null or empty text is its end token alone; without training documents N and V are 0, nothing is known, the base score is
that of counts of 0 over 1, and the model is untrained; repeated rows repeat and count each time; a null ``doc_id`` is trained on; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bpe
from marlstone.llm.attention import WINDOW, Adam, AttentionModel
from marlstone.llm.bpe_batch import BatchMerger, KnownChunks
from marlstone.llm.langid import remainder
from marlstone.llm.shared import written
from marlstone.llm.subword_pairs import BINS, PairBlend, PairTable, binned, likeliest
from marlstone.llm.textbatch import Words, dealt, mix, pieces, raw, runs, spans

MERGES = 1535  # with 512 byte symbols and the end: 2048 ids
#: Passages, of ``PASSAGE`` words, from which the driver's part of the training draws, and its steps.
SAMPLE, PASSAGE, STEPS = 8192, 96, 2000
#: The rate of the tasks' training, which falls from step to step.
RATE = 2e-3
FREQUENT = 1 << 17
MEMORY, SEGMENT = 8, 16
SHARD_BYTES = 16 << 20
#: A word with the space after it, for the share of passages drawn.
WORD_BYTES = 6
SCORED_BYTES = 3 << 20
#: Parts in which pairs and weights are summed.
PARTS = 128
#: Windows in a step of training.
TRAINED = 128
SEGMENT_AT = np.dtype([("at", "<u4"), ("lp", "<f4")])
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case; null is empty."""
    body, offsets = raw(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_UPPER[body]))


class Subwords:
    """Words as ids of a short vocabulary: byte symbols and the first merges of a public one, renumbered."""

    def __init__(self, path: str, merges: int):
        v = bpe.vocabulary(path)
        self.vocab = v
        kept = sorted((rank, pair, new) for pair, (rank, new) in v.merges.items() if rank < merges)
        ids = dict.fromkeys([*v.inner, *v.final, *(new for *_, new in kept)])
        self.number = {i: k for k, i in enumerate(ids)}
        self.merges = {pair: (rank, new) for rank, pair, new in kept}
        self.batch = BatchMerger(self.merges, v.inner, v.final)
        self.renumber = np.zeros(max(self.number) + 1, np.int64)
        self.renumber[list(self.number)] = list(self.number.values())
        self.end = len(self.number)
        self.size = self.end + 1
        self.known = KnownChunks(self.encode)

    def one(self, word: bytes) -> list[int]:
        """Ids of one word, by the vocabulary's numbers."""
        symbols = [*map(self.vocab.inner.__getitem__, word[:-1]), self.vocab.final[word[-1]]]
        return [i for i in bpe.merge_symbols(symbols, self.merges)[0] if i is not None]

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each word: a pool of ids, where each word's begin in it, and how many there are."""
        body, offsets = raw(words)
        pool, start, size = self.batch.arrays(body, offsets[:-1], np.diff(offsets), self.one)
        return self.renumber[pool].astype("<u4"), start, size

    def texts(self, words: Words, coded: pa.DictionaryArray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the rows, each with its end, where each row begins, and where each word or end does; ``coded`` are the words, if they are coded already."""
        coded = words.array().dictionary_encode() if coded is None else coded
        pool, start, size = self.known.look(coded.dictionary)
        codes = np.insert(coded.indices.to_numpy(), words.first[1:], len(start))
        pool = np.append(pool, np.uint32(self.end))
        start, size = np.append(start, len(pool) - 1), np.append(size, 1)
        each = size[codes]
        total = np.cumsum(each)
        ids = pool[np.repeat(start[codes] - (total - each), each) + np.arange(total[-1] if len(total) else 0)]
        ends = total[words.first[1:] + np.arange(len(words.first) - 1)]
        return ids, np.concatenate([[0], ends]).astype(np.int64), total - each


@lru_cache(maxsize=2)
def subwords(path: str, merges: int) -> Subwords:
    return Subwords(path, merges)


class Stretches:
    """Ids of some stretches of words: ``begin`` and ``many`` words; the ids of all, one after another, and where each stretch begins."""

    def __init__(self, coded: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, begin: np.ndarray, many: np.ndarray):
        pool, start, size = coded
        ends = np.cumsum(many)
        at = np.repeat(begin - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        each = size[codes[at]]
        total = np.cumsum(each)
        self.ids = pool[np.repeat(start[codes[at]] - (total - each), each) + np.arange(total[-1] if len(total) else 0)].astype(np.int64)
        self.first = np.concatenate([[0], total[ends - 1]]).astype(np.int64)


def count(docs: DataFrame, path: str, shards: int, share: float) -> DataFrame:
    """What all rows hold, by ``kind``.

    0: the words of a ``shard``, sorted hashes ``a`` with counts ``b``, their number ``v`` and sum ``n``; 1: pairs, likewise; 2: the number ``n`` of rows; 3: passages,
    a ``share`` of all, drawn by their hash ``n``, with ids ``a``.
    """
    size = subwords(path, MERGES).size
    names, kinds = ["kind", "shard", "a", "b", "n"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def passages(coded, codes: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple]:
        tokens = np.diff(first)
        chunks = -(-tokens // PASSAGE)
        owner = np.repeat(np.arange(len(tokens)), chunks)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * PASSAGE
        many = np.diff(np.append(begin, first[-1]))
        name = mix(np.add.reduceat(mix(h[codes] + np.arange(len(codes), dtype=np.uint64)), begin))
        drawn = np.flatnonzero(name <= bar(share))
        s = Stretches(coded, codes, begin[drawn], many[drawn])
        out = []
        for k, j in enumerate(drawn.tolist()):
            a, z = s.first[k], s.first[k + 1]
            if z - a > 40 * PASSAGE:  # one with a word of thousands of subwords is left to the tasks
                continue
            before = size if begin[j] == first[owner[j]] else int(last(coded, codes[begin[j] - 1]))
            out.append((3, int(name[j] % np.uint64(shards)), np.append(before, s.ids[a:z]).astype("<u2").tobytes(), b"", int(name[j].view(np.int64))))
        return out

    def last(coded, code: int) -> int:
        pool, start, many = coded
        return pool[start[code] + many[code] - 1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, MERGES)
        held, many, rows, pairs = [], 0, 0, PairTable(size)

        def parted(kind: int, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(part, kind="stable")
            part, a, b = part[order], a[order], b[order]
            return _batch([(kind, s, a[p].tobytes(), b[p].astype("<u4").tobytes(), 0) for s, p in dealt(part)], names, kinds)

        def flush() -> pa.RecordBatch:
            h, c = _summed([x for x, _ in held], [y for _, y in held])
            return parted(0, (h % np.uint64(shards)).astype(np.int64), h, c)

        for b in pieces(batches, limit=SCORED_BYTES):
            rows += b.num_rows
            w = Words(lowered(b.column("text")))
            dictionary = w.array().dictionary_encode()
            codes = dictionary.indices.to_numpy()
            times, h = np.bincount(codes, minlength=len(dictionary.dictionary)), Words(dictionary.dictionary).hashes()
            held.append((h, times))
            many += len(times)
            pool, start, each = sub.known.look(dictionary.dictionary)
            # the end of a text is a word of its own from here on
            coded = np.append(pool, sub.end), np.append(start, len(pool)), np.append(each, 1)
            ended, first = np.insert(codes, w.first[1:], len(start)), w.first + np.arange(b.num_rows + 1)
            pairs.add(*coded, np.append(times, b.num_rows), ended, first[:-1])
            yield _batch(passages(coded, ended, np.append(h, np.uint64(0)), first), names, kinds)
            if many > 3_000_000:
                yield flush()
                held, many = [], 0
        if many:
            yield flush()
        if rows:
            at = np.flatnonzero(pairs.table)
            yield parted(1, at % PARTS, at.astype("<u4"), pairs.table[at])
            yield _batch([(2, TaskContext.get().partitionId() % shards, b"", b"", rows)], names, kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[int, int], tuple[list, list]] = {}
        rows = 0
        for b in batches:
            kept: list[tuple] = []
            for kind, s, x, y, n in zip(b.column("kind").to_pylist(), b.column("shard").to_pylist(), b.column("a"), b.column("b"), b.column("n").to_pylist()):
                if kind == 2:
                    rows += n
                if kind >= 2:
                    kept += [(kind, s, x.as_py(), y.as_py(), 0, n)] if kind > 2 else []
                    continue
                xs, ys = by.setdefault((kind, s), ([], []))
                xs.append(np.frombuffer(x.as_buffer(), np.uint64 if kind == 0 else "<u4").copy())
                ys.append(np.frombuffer(y.as_buffer(), "<u4").astype(np.int64))
                if len(xs) > 64:  # tables of many tasks are added up as they come
                    x, y = _summed(xs, ys)
                    by[kind, s] = ([x], [y])
            yield _batch(kept, ["kind", "shard", "a", "b", "v", "n"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])
        out = [(2, 0, b"", b"", 0, rows)] if rows else []
        for (kind, s), (xs, ys) in by.items():
            x, y = _summed(xs, ys)
            out.append((kind, s, x.tobytes(), y.tobytes(), len(x), int(y.sum())))
        yield _batch(out, ["kind", "shard", "a", "b", "v", "n"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])

    dealt_out = docs.select("text").mapInArrow(gather, "kind int, shard long, a binary, b binary, n long").repartition(shards, "kind", "shard")
    return dealt_out.mapInArrow(add, "kind int, shard long, a binary, b binary, v long, n long")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def pair_counts(counts: DataFrame, size: int) -> np.ndarray:
    """The table of pairs: a row per id before (the last stands for a text's beginning), a column per id."""
    table = np.zeros((size + 1) * size, np.int64)
    for r in counts.where("kind = 1").select("a", "b").toLocalIterator():  # each pair of ids once
        table[np.frombuffer(r.a, "<u4")] = np.frombuffer(r.b, np.int64)
    return table.reshape(size + 1, size)


def bar(share: float) -> np.uint64:
    return np.uint64(min(1.0, share) * ((1 << 64) - 2048))


def drawn_passages(counts: DataFrame, most: int) -> list[np.ndarray]:
    """The passages drawn: ids with the id before them in front."""
    # the share makes this about SAMPLE rows; the limit holds it where many passages are copies of one
    rows = counts.where("kind = 3").select("n", "a").orderBy("n", "a").limit(most).collect()
    return [np.frombuffer(r.a, "<u2").astype(np.int64) for r in rows]


class Trainer:
    """A task's part of the training: texts are learned from subword by subword, and what the model gave them before is counted (``held``).

    Rows of ``held``: as many as levels of pairs (see ``PairBlend``), then one for frequent words; columns: ratios (see ``binned``).
    """

    def __init__(self, scorer: "Scorer"):
        self.scorer, self.seen, self.held = scorer, 0, np.zeros((scorer.blend.levels + 1, BINS))
        self.model = AttentionModel.__new__(AttentionModel)
        self.model.__dict__ = {**scorer.model.__dict__, "p": {k: v.copy() for k, v in scorer.model.p.items()}}
        self.adam = Adam(self.model)

    def learn(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Train on windows that hold each id of texts that ``first`` cuts as a target once; gives the ids' log probabilities before."""
        n = np.diff(first)
        texts, many = len(n), -(-n // WINDOW)
        shift = first[:-1] + np.arange(texts)  # inputs: the beginning, then all ids
        seq = np.full(len(ids) + texts + WINDOW, self.model.n_ids, np.int64)
        seq[np.arange(len(ids)) + 1 + np.repeat(np.arange(texts), n)] = ids
        owner = np.repeat(np.arange(texts), many)
        turn = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * WINDOW
        start, place, left = shift[owner] + turn, first[owner] + turn, n[owner] - turn
        out, inside = np.empty(len(ids)), np.arange(WINDOW)
        order = np.random.default_rng([len(ids), int(ids[:1000].sum())]).permutation(len(owner))  # a task that is run again does the same
        for a in range(0, len(order), TRAINED):
            w = order[a : a + TRAINED]
            at, used = start[w, None] + inside, inside < left[w, None]
            done = self.adam.done
            rate = RATE * min(1.0, done / 20 + 0.05) / np.sqrt(1 + done / 200) * len(w) / TRAINED
            out[(place[w, None] + inside)[used]] = self.adam.step(seq[at], np.where(used, seq[at + 1], 0), used, rate)
        self.seen += len(order)
        return out

    def read(self, ids: np.ndarray, first: np.ndarray, start: np.ndarray, times: np.ndarray) -> None:
        """Learn from texts of ids; ``start`` are words' or ends' beginnings, ``times`` how often each occurs (0: not a frequent one), this time included."""
        if not len(ids):
            return
        blend, lp = self.scorer.blend, self.learn(ids, first)
        before = blend.before(ids, first)
        pair = blend.others(before, ids)
        level = blend.bucket[before]
        self.held[:-1] += np.bincount(level * BINS + binned(np.log(pair) - lp), minlength=blend.levels * BINS).reshape(-1, BINS)
        share = blend.fitted(self.held[:-1])[level]
        word = np.add.reduceat(np.log(share * pair + (1 - share) * np.exp(lp)), start)
        with np.errstate(divide="ignore"):
            self.held[-1] += np.bincount(binned(np.log(np.maximum(times - 1, 0) / self.scorer.all) - word), minlength=BINS)


def refine(learn: DataFrame, path: str, scorer: "Scorer") -> "Scorer":
    """Training goes on with all rows: every task trains on every subword of its own ones; weights are averaged by the windows seen, and what fits the blend is summed."""
    names = sorted(scorer.model.p)
    shipped = learn.sparkSession.sparkContext.broadcast(scorer)  # FREQUENT words, and a fixed number of weights and pairs of ids
    schema = "slice int, seen double, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, trainer = subwords(path, MERGES), Trainer(shipped.value)
        for b in pieces(batches, limit=SCORED_BYTES):
            w = Words(lowered(b.column("text")))
            coded = w.array().dictionary_encode()
            times, _ = _look_up(Words(coded.dictionary).hashes(), trainer.scorer.words)
            trainer.read(*sub.texts(w, coded), np.insert(times[coded.indices.to_numpy()], w.first[1:], trainer.scorer.ends))
        if trainer.seen:
            flat = np.concatenate([trainer.model.p[k].ravel() for k in names]).astype(np.float64) * trainer.seen
            yield _batch([(k, float(trainer.seen), x.tobytes()) for k, x in enumerate([*np.array_split(flat, PARTS), trainer.held])], ["slice", "seen", "weights"], [pa.int32(), pa.float64(), pa.binary()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, x in zip(b.column("slice").to_pylist(), b.column("seen").to_pylist(), b.column("weights")):
                s = sums.setdefault(k, [0.0, 0.0])
                s[0], s[1] = s[0] + n, s[1] + np.frombuffer(x.as_buffer(), np.float64)
        yield _batch([(k, n, x.tobytes()) for k, (n, x) in sums.items()], ["slice", "seen", "weights"], [pa.int32(), pa.float64(), pa.binary()])

    rows = sorted(learn.select("text").mapInArrow(run, schema).repartition(PARTS, "slice").mapInArrow(add, schema).collect())  # PARTS slices of the weights, and the counts of ratios
    if rows:
        flat, at = np.concatenate([np.frombuffer(r.weights, np.float64) / r.seen for r in rows[:-1]]), 0
        for k in names:
            w = scorer.model.p[k]
            scorer.model.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        scorer.fit(np.frombuffer(rows[-1].weights, np.float64).reshape(-1, BINS))
    return scorer


class Scorer:
    """All that a document's words are scored with, but for what the shards know."""

    def __init__(self, model: AttentionModel, blend: PairBlend, words: tuple[np.ndarray, np.ndarray], ends: int):
        self.model, self.blend, self.words, self.ends = model, blend, words, ends
        self.all = max(1, int(words[1].sum()) + ends)
        self.share = 0.0

    def tokens(self, ids: np.ndarray, first: np.ndarray, start: np.ndarray, times: np.ndarray, unseen: int = 0) -> np.ndarray:
        """Natural log probability of each word or end, given how often it occurs (0: not a frequent one); ``unseen`` occurrences of its own are taken off."""
        lp = np.add.reduceat(self.blend(self.blend.before(ids, first), ids, self.model.score(ids, first)), start) if len(ids) else np.empty(0)
        return self.mixed(lp, times, unseen)

    def mixed(self, lp: np.ndarray, times: np.ndarray, unseen: int = 0) -> np.ndarray:
        if not self.share:
            return lp
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log1p(-self.share) + lp, np.log(self.share) + np.log(np.maximum(times - unseen, 0) / self.all))

    def fit(self, held: np.ndarray) -> "Scorer":
        """Set the weights of pairs and of frequent words by what was counted over all training documents (see ``Trainer``)."""
        self.blend.share = self.blend.fitted(held[:-1])[self.blend.bucket].astype(np.float32)
        self.share = min(float(likeliest(held[-1:])[0]), 0.9)
        return self


def train(path: str, learn: DataFrame, counts: DataFrame, words: tuple[np.ndarray, np.ndarray], ends: int, steps: int) -> Scorer:
    sub = subwords(path, MERGES)
    pairs = pair_counts(counts, sub.size)
    model = AttentionModel(sub.size, np.argsort(-pairs.sum(0), kind="stable"), int((pairs.sum(0) > 0).sum()))
    if own := drawn_passages(counts, 4 * SAMPLE):
        model.train(own, steps)
    scorer = refine(learn, path, Scorer(model, PairBlend(pairs), words, ends))
    scorer.model.ready()
    return scorer


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(at, np.concatenate(counts), len(h)).astype(np.int64)


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words that occur oftenest: all that reach the least count that ``most`` words allow."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("b"):
                level, n = np.unique(np.frombuffer(c.as_buffer(), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n)], ["level", "n"])

    levels = counts.select("b").mapInArrow(histogram, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    # the least level that fewer than ``most`` words reach: levels above the ``most``-th word alone matter, at most ``most`` of them
    bar, held = 0, 0
    for r in levels.orderBy(F.desc("level")).limit(most).collect():
        if held + r.n > most:
            break
        held, bar = held + r.n, r.level

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column("a"), b.column("b")):
                c = np.frombuffer(c.as_buffer(), np.int64)
                yes = c >= bar
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(h.as_buffer(), np.uint64)[yes].tobytes()], pa.binary()), pa.array([c[yes].tobytes()], pa.binary())], ["hashes", "counts"])

    rows = counts.select("a", "b").mapInArrow(pick, "hashes binary, counts binary").collect() if held else []
    h = np.concatenate([np.frombuffer(r.hashes, np.uint64) for r in rows] or [np.empty(0, np.uint64)])
    c = np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows] or [np.empty(0, np.int64)])
    order = np.argsort(h)
    return h[order], c[order]


def _look_up(h: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashes in a sorted table, and which are there."""
    hashes, counts = table
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    here = hashes[at] == h
    return np.where(here, counts[at], 0), here


def segments(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which texts are cut, and the hash of the ``MEMORY`` words before each; ``h`` are hashes of words, of which ``first`` begin texts."""
    before = runs(h, MEMORY)[: max(0, len(h) - MEMORY)]
    at = np.flatnonzero(before < np.uint64((1 << 64) // SEGMENT)) + MEMORY
    at = at[at - MEMORY >= first[np.searchsorted(first, at, side="right") - 1]]
    return at, before[at - MEMORY]


def scored(docs: DataFrame, path: str, shipped, shards: int) -> DataFrame:
    """Rows of documents (``kind`` 1), each with what it wants of the shards, and what their pieces ask of each (``kind`` 0)."""
    base = ["piece", "kind", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "segments"]
    asks = ["shard", "word_at", "words", "seg_at", "before", "seg", "rows"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"piece long, kind int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare binary, segments binary, shard long, word_at long, words binary, seg_at long, before binary, seg binary, rows binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, scorer = subwords(path, MERGES), shipped.value
        piece = TaskContext.get().partitionId() << 32
        for b in pieces(batches, limit=SCORED_BYTES):
            piece += 1
            texts = lowered(b.column("text")).dictionary_encode()  # copies are scored once
            of, n = texts.indices.to_numpy(), len(texts.dictionary)
            w = Words(texts.dictionary)
            coded = w.array().dictionary_encode()
            codes, each = coded.indices.to_numpy(), Words(coded.dictionary).hashes()
            times, here = _look_up(each, scorer.words)
            ids, first, start = sub.texts(w, coded)
            lp = scorer.tokens(ids, first, start, np.insert(times[codes], w.first[1:], scorer.ends))
            row_at = w.first[:-1] + np.arange(n)  # of each row's first token
            sums = lambda x, w=w: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
            # distinct rare words, by shard; rows tell theirs by number
            rare = np.flatnonzero(~here)
            rare = rare[np.lexsort((each[rare], each[rare] % np.uint64(shards)))]
            number = np.full(len(each) + 1, -1, np.int64)
            number[rare] = np.arange(len(rare))
            wanted = number[codes]
            rows = spans(w.first)[wanted >= 0]
            wanted = wanted[wanted >= 0].astype("<u4")
            # segments
            cut, before = segments(each[codes], w.first)
            row = np.searchsorted(w.first, cut, side="right") - 1
            bounds = np.sort(np.concatenate([row_at, cut + row]))
            place = np.searchsorted(bounds, cut + row)
            seg_lp = np.add.reduceat(lp, bounds)[place]
            token = np.insert(each[codes], w.first[1:], np.uint64(0))
            inside = (np.arange(len(token)) - np.repeat(bounds, np.diff(np.append(bounds, len(token))))).astype(np.uint64)
            seg = np.add.reduceat(mix(token ^ mix(inside + np.uint64(1))), bounds)[place]
            order = np.lexsort((seg, before, before % np.uint64(shards)))
            new = np.ones(len(order), bool)
            new[1:] = (before[order][1:] != before[order][:-1]) | (seg[order][1:] != seg[order][:-1])
            name = np.empty(len(order), np.int64)
            name[order] = np.cumsum(new) - 1
            learned = np.bincount(of, ~b.column("held_out").to_numpy(zero_copy_only=False), n)
            held = np.bincount(name, learned[row], int(new.sum())).astype("<u4")
            seg_of = np.empty(len(order), SEGMENT_AT)
            seg_of["at"], seg_of["lp"] = name, seg_lp
            before, seg = before[order][new], seg[order][new]
            cuts = lambda of, data: [data[a:z].tobytes() for a, z in pairwise(np.searchsorted(of, np.arange(n + 1)).tolist())]
            tokens = np.diff(w.first) + 1
            made = [
                pa.array(tokens), pa.array(sums(times[codes] > 0) + (scorer.ends > 0)), pa.array(sums(np.log10(times[codes] + 1.0)) + np.log10(scorer.ends + 1.0)), pa.array(np.add.reduceat(lp, row_at)),
                pa.array(cuts(rows, wanted), pa.binary()), pa.array(cuts(row, seg_of), pa.binary()),
            ]
            many = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(many, piece)), pa.array(np.ones(many, np.int32)), b.column("doc_id"), b.column("held_out"), *(x.take(texts.indices) for x in made),
                    *(pa.nulls(many, k) for k in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary())),
                ],
                [*base, *asks],
            )
            by: dict[int, dict[str, slice]] = {}
            for what, h in (("w", each[rare]), ("s", before)):
                for s, p in dealt((h % np.uint64(shards)).astype(np.int64)):
                    by.setdefault(s, {})[what] = p
            none, h = slice(0, 0), each[rare]
            out = [(piece, 0, s, (x := p.get("w", none)).start, h[x].tobytes(), (y := p.get("s", none)).start, before[y].tobytes(), seg[y].tobytes(), held[y].tobytes()) for s, p in by.items()]
            few = _batch(out, ["piece", "kind", *asks], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])
            some = len(out)
            doc = b.schema.field("doc_id").type
            nulls = [pa.nulls(some, k) for k in (doc, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), *nulls, *few.columns[2:]], [*base, *asks])

    return docs.mapInArrow(run, schema)


def answers(asked: DataFrame, counts: DataFrame, shards: int) -> DataFrame:
    """For every piece and shard, in the piece's order: counts of its words (``words``), and for its segments ``totals`` (see ``recalled``)."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        asked: dict[int, list] = {}
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() if c in ("shard", "piece", "word_at", "seg_at") else b.column(c) for c in ("shard", "piece", "word_at", "words", "seg_at", "before", "seg", "rows", "counts"))):
                if r[1] is None:
                    table[r[0]] = (np.frombuffer(r[3].as_py(), np.uint64), np.frombuffer(r[8].as_py(), np.int64))
                else:
                    asked.setdefault(r[0], []).append((r[1], r[2], np.frombuffer(r[3].as_py(), np.uint64), r[4], *(np.frombuffer(x.as_py(), k) for x, k in zip(r[5:8], (np.uint64, np.uint64, "<u4")))))
        none = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for s, requests in asked.items():
            before, seg, rows = (np.concatenate([r[k] for r in requests]) for k in (4, 5, 6))
            order = np.lexsort((seg, before))
            x, y, n = before[order], seg[order], rows[order].astype(np.int64)
            top = np.ones(len(x), bool)
            top[1:] = x[1:] != x[:-1]
            sub = top.copy()
            sub[1:] |= y[1:] != y[:-1]
            group, kind = np.cumsum(top) - 1, np.cumsum(sub) - 1
            each = np.bincount(kind, n)
            totals = np.empty((len(x), 3), np.int64)  # of the words before, of the segment after them, of different segments
            totals[order, 0] = np.bincount(group, n)[group] if len(x) else 0
            totals[order, 1] = each[kind] if len(x) else 0
            totals[order, 2] = np.bincount(group[sub], each > 0)[group] if len(x) else 0
            out, at = [], 0
            for piece, word_at, h, seg_at, p, *_ in requests:
                c, _ = _look_up(h, table.get(s, none))
                same = np.zeros(len(p), np.int64)  # which of the piece's segments follow the same words
                same[1:] = p[1:] == p[:-1]
                out.append((piece, 0, word_at, c.tobytes(), seg_at, np.column_stack([totals[at : at + len(p)], same]).tobytes()))
                at += len(p)
            yield _batch(out, ["piece", "kind", "word_at", "words", "seg_at", "totals"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()])

    cols = ["shard", "piece", "word_at", "words", "seg_at", "before", "seg", "rows"]
    known = counts.where("kind = 0").select("shard", F.col("a").alias("words"), F.col("b").alias("counts"))
    both = asked.where("kind = 0").select(*cols).unionByName(known, allowMissingColumns=True)
    return both.repartition(shards, "shard").mapInArrow(answer, "piece long, kind int, word_at long, words binary, seg_at long, totals binary")


def recalled(row: np.ndarray, at: np.ndarray, lp: np.ndarray, learned: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """What each segment's natural log probability gains by recalling it: segments ``at`` of rows, ``totals`` (columns: how often the words
    before it occur in training rows, how often it follows them, how many segments do, whether the words are those of the segment before it in the list).

    Occurrences of the row itself are taken off, if it is a training row.
    """
    if not len(at):
        return np.zeros(0)
    group = np.cumsum(totals[:, 3] == 0)[at]
    mine = learned[row].astype(np.int64)
    _, first, own, many = np.unique(np.stack([row, at]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    own = own.reshape(-1)
    # segments that occur in this row alone
    lost = mine[first] * (totals[at[first], 1] <= many)
    _, where = np.unique(np.stack([row, group]), axis=1, return_inverse=True)
    where = where.reshape(-1)
    n = totals[at, 0] - mine * np.bincount(where)[where]
    hit = totals[at, 1] - mine * many[own]
    kinds = totals[at, 2] - np.bincount(where[first], lost, where.max() + 1)[where]
    known = n > 0
    share = np.where(known, n / np.maximum(n + kinds, 1), 0.0)
    with np.errstate(divide="ignore"):
        return np.where(known, np.logaddexp(np.log1p(-share) + lp, np.log(share) + np.log(np.where(known, hit / np.maximum(n, 1), 0.0))) - lp, 0.0)


def settled(asked: DataFrame, told: DataFrame, parts: int, n: int, v: int) -> DataFrame:
    """The documents' rows, with what the shards told their pieces."""
    floor = float(np.log10(n + (v + 1.0)))
    kind = asked.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, words, totals = None, [], []

        def whole(parts: list, width: int) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, np.int64).reshape(-1, width) for _, x in sorted(parts)] or [np.empty((0, width), np.int64)])

        for both in batches:
            for piece, p in dealt(both.column("piece").to_numpy()):
                b = both.slice(p.start, p.stop - p.start)
                if piece != current:
                    current, words, totals = piece, [], []
                few = b.filter(pa.compute.equal(b.column("kind"), 0))
                for a, x, c, y in zip(*(few.column(k).to_pylist() for k in ("word_at", "words", "seg_at", "totals"))):
                    words += [(a, x)] if x else []
                    totals += [(c, y)] if y else []
                b = b.filter(pa.compute.equal(b.column("kind"), 1))
                if not b.num_rows:
                    continue
                count, total = whole(words, 1)[:, 0], whole(totals, 4)

                def lists(name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
                    data = [np.frombuffer(x.as_buffer(), dtype) for x in b.column(name)]
                    return np.repeat(np.arange(b.num_rows), [len(x) for x in data]), np.concatenate(data)

                row, at = lists("rare", "<u4")
                c = count[at]
                tokens = b.column("n_tokens").to_numpy()
                base = b.column("base_score").to_numpy() + np.bincount(row, np.log10(c + 1.0), b.num_rows) - tokens * floor
                known = b.column("n_known").to_numpy() + np.bincount(row, c > 0, b.num_rows).astype(np.int64)
                row, seg = lists("segments", SEGMENT_AT)
                gain = recalled(row, seg["at"].astype(np.int64), seg["lp"].astype(np.float64), ~b.column("held_out").to_numpy(zero_copy_only=False), total)
                score = (b.column("score").to_numpy() + np.bincount(row, gain, b.num_rows)) / np.log(10)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(tokens), pa.array(known), pa.array(np.full(b.num_rows, n)), pa.array(base), pa.array(score)], names)

    docs = asked.where("kind = 1").select("piece", "kind", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "segments")
    both = docs.unionByName(told, allowMissingColumns=True).repartition(parts, "piece").sortWithinPartitions("piece", "kind")
    return both.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, sample: int = SAMPLE, steps: int = STEPS, vocab_path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    path, spark = vocab_path or bpe.default_path(), docs.sparkSession
    src = docs.select(docs[id_col].alias("doc_id"), (remainder(docs[id_col], folds) == held).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    learn = src.where(~F.col("held_out"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, int(size // SHARD_BYTES))
    share = min(1.0, sample * PASSAGE * WORD_BYTES / max(1, size))
    counts = written(count(learn, path, shards, share), "counts")
    total = {r.kind: r for r in counts.where("kind in (0, 2)").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    ends = total[2].n if 2 in total else 0
    n, v = (total[0].n if 0 in total else 0) + ends, (total[0].v if 0 in total else 0) + (ends > 0)
    words = frequent_words(counts.where("kind = 0"), FREQUENT)
    shipped = spark.sparkContext.broadcast(train(path, learn, counts, words, ends, steps))  # FREQUENT words, and a fixed number of weights and pairs of ids
    asked = written(scored(src, path, shipped, shards), "scored")
    return settled(asked, answers(asked, counts, shards), shards, n, v)
