"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the distinct 1-, 2- and 3-grams that both hold, divided by the root of the product of
their own numbers of distinct grams.  Grams are taken over bytes folded to 64 symbols (letters without case, white
space, other ASCII, and the low bits of UTF-8 lead and continuation bytes, which also folds the case of accented
Latin letters).  Nyström landmarks turn the kernel into features, and kernel ridge regression, one language against
the rest, is solved on them.  Texts are scored in batches: presence matrix times landmark matrix, times weights.

Training uses a sample of at most about ``sample`` labelled rows, spread evenly over the languages.

Defined results: a null text or one without any letter gives ``und`` and score 0; with nothing to learn from, every
text gives ``und`` and 0; equal scores go to the language first in the alphabet; repeated rows repeat; a null
``doc_id`` is trained on (its remainder is taken as 0); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textbatch import SPACE, pieces, raw

GRAMS = 64**3 + 64**2 + 64
SAMPLE, LANDMARKS, RIDGE = 3000, 128, 1e-2
#: Languages learned at most, the most frequent ones; rarer ones are never predicted.
LANGUAGES = 1000
#: Presence columns are built for this many texts at a time.
ROWS = 256


def _fold() -> np.ndarray:
    table = np.full(256, 1, np.uint8)  # other ASCII
    table[SPACE] = 0
    for k in range(26):
        table[65 + k] = table[97 + k] = 2 + k
    table[0x80:0xC0] = 28 + (np.arange(64) & 31)
    table[0xC0:] = 60 + np.minimum(3, np.arange(64) // 3)  # C0-C2, C3-C5, C6-C8, others
    return table


FOLD = _fold()


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def presence(texts: pa.Array) -> Iterator[np.ndarray]:
    """The codes of each text's distinct grams, in order."""
    body, offsets = raw(texts)
    c = FOLD[body].astype(np.int32)
    two = (c[:-1] << 6) | c[1:] if len(c) else c
    three = (two[:-1] << 6) | c[2:] if len(c) > 1 else two[:0]
    flag = np.zeros(GRAMS, dtype=bool)
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        flag[three[a : max(a, b - 2)]] = True
        flag[two[a : max(a, b - 1)] + 64**3] = True
        flag[c[a:b] + (64**3 + 64**2)] = True
        found = np.flatnonzero(flag).astype(np.int32)
        flag[found] = False
        yield found


def has_letter(texts: pa.Array) -> np.ndarray:
    body, offsets = raw(texts)
    ascii_letter = np.zeros(len(body) + 1, np.int64)
    np.cumsum((FOLD[body] >= 2) & (FOLD[body] < 28), out=ascii_letter[1:])
    yes = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for k in np.flatnonzero(~yes & (np.diff(offsets) > 0)).tolist():
        yes[k] = any(ch.isalpha() for ch in texts[k].as_py() or "")
    return yes


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # gram code -> column of the landmark matrix, or -1
    landmarks: np.ndarray  # packed bits, a row per landmark
    width: int
    norm: np.ndarray  # of the landmarks
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their grams, with the landmarks."""
        if not hasattr(self, "_matrix"):
            self._matrix = np.unpackbits(self.landmarks, axis=1, count=self.width).astype(np.float32).T
        x = np.zeros((len(found), self.width), np.float32)
        for r, f in enumerate(found):
            at = self.column[f]
            x[r, at[at >= 0]] = 1
        own = np.sqrt(np.maximum(1, [len(f) for f in found]))
        return (x @ self._matrix) / (own[:, None] * self.norm)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Ridge outputs, a row per text and a column per language."""
        out, held = [], []
        for f in presence(texts):
            held.append(f)
            if len(held) == ROWS:
                out.append(self.kernel(held))
                held = []
        if held:
            out.append(self.kernel(held))
        k = np.concatenate(out) if out else np.zeros((0, len(self.norm)))
        return k @ self.weights + self.bias


def fit(grams: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression on Nyström features; the landmarks take turns over the languages, and are as many as these at least."""
    keep = [k for k, g in enumerate(grams) if len(g)]
    grams, labels = [grams[k] for k in keep], [labels[k] for k in keep]
    if not grams:
        return None
    languages = sorted(set(labels))
    turn, seen = [], dict.fromkeys(languages, 0)
    for k, y in enumerate(labels):
        turn.append((seen[y], y, k))
        seen[y] += 1
    chosen = [k for *_, k in sorted(turn)[: max(landmarks, len(languages))]]
    codes = np.unique(np.concatenate([grams[k] for k in chosen]))
    column = np.full(GRAMS, -1, np.int32)
    column[codes] = np.arange(len(codes))
    rows = np.zeros((len(chosen), len(codes)), bool)
    for r, k in enumerate(chosen):
        rows[r, column[grams[k]]] = True
    m = Model(languages, column, np.packbits(rows, axis=1), len(codes), np.sqrt(rows.sum(1)), np.empty(0), np.empty(0))
    values, vectors = np.linalg.eigh(m.kernel([grams[k] for k in chosen]).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # the Nyström map
    z = np.concatenate([m.kernel(grams[a : a + ROWS]) @ root for a in range(0, len(grams), ROWS)])
    y = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
    # every language weighs the same, however many rows it has
    row = np.array([len(labels) / (len(languages) * seen[v]) for v in labels])
    mean_z, mean_y = np.average(z, axis=0, weights=row), np.average(y, axis=0, weights=row)
    zc, yc = z - mean_z, y - mean_y
    w = np.linalg.solve((zc * row[:, None]).T @ zc + ridge * len(labels) / 100 * np.eye(z.shape[1]), (zc * row[:, None]).T @ yc)
    m.weights, m.bias = root @ w, mean_y - mean_z @ w
    return m


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held: int, sample: int, landmarks: int, languages: int) -> Model | None:
    """Fit on about ``sample`` rows outside the held-out fold, as many of each language as there are, drawn by hash; only the ``languages`` most frequent ones are learned."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    quota = max(3, sample // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30))
    bar = F.lit(0)
    for lang, n in counts.items():
        bar = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int(quota / n * (1 << 30)) + 1))).otherwise(bar)
    drawn = rows.where(draw < bar).dropDuplicates(["lang", "text"]).withColumn("h", draw)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            packed = pa.array([f.tobytes() for f in presence(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), packed], ["h", "lang", "grams"])

    # copies are gone, so the draw is close to its size; the limit holds it where ids are not spread evenly
    found = drawn.mapInArrow(grams, "h long, lang string, grams binary").orderBy("h", "grams").limit(max(sample, quota * len(counts)) * 2).collect()
    return fit([np.frombuffer(r.grams, np.int32) for r in found], [r.lang for r in found], landmarks)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE, landmarks: int = LANDMARKS, keep: tuple[str, ...] = (), languages: int = LANGUAGES) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1), and the columns named in ``keep``."""
    model = train(docs, id_col, text_col, lang_col, folds, held, sample, landmarks, languages)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS or ``languages`` landmarks over a fixed gram alphabet
    made = ["doc_id", "held_out", "lang_pred", "score"]
    kept = [c for c in keep if c not in made]
    src = docs.select(docs[id_col].alias("doc_id"), (remainder(docs[id_col], folds) == held).alias("held_out"), docs[text_col].alias("__text"), *(docs[c] for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in pieces(batches, "__text"):
            text = b.column("__text")
            lang, score = np.full(len(text), "und", dtype=object), np.zeros(len(text))
            if m is not None:
                s = m.scores(text)
                best = s.argmax(1)
                ok = has_letter(text)
                lang[ok] = np.array(m.languages, dtype=object)[best[ok]]
                score[ok] = np.clip((s[np.arange(len(s)), best][ok] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score), *(b.column(c) for c in kept)], [*made, *kept])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in kept]
    return src.mapInArrow(run, ", ".join([f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double", *fields]))
