"""Substring deduplication: words covered by a repeated window of words are removed, with a count-min prefilter.

Pass 1 counts.  A window of ``width`` words holds ``width - GRAM + 1`` grams of ``GRAM`` words; the one with the least hash is
its anchor.  If a window occurs twice, its anchor occurs at two places, so the anchor's count, and any count-min
estimate of it, is no less than the window's: an estimate below two rules a repeat out, and no repeat is lost.  Only about
a tenth of all positions are anchors, so only these are put in the sketches.  Every task sketches its own part
(saturating at two), and the parts are merged slice by slice.

Pass 2 groups.  Windows estimated repeated are dealt out by their anchor, and grouped by a 96-bit hash of their words.  Windows
that meet an equal within a piece are settled on the spot and sent once for all, so however common a passage is, a
piece sends it once.  Repeats come back as stretches of words, keyed by the MD5 of the text, and are joined with the documents.

Equality is that of 64-bit word hashes and 96-bit window hashes, which no sum of powers enters (see ``textbatch``).

Defined results: a null or empty text has no words, none removed, and the digest of the empty string; windows never
span two documents; a repeated row repeats all of its windows; a null ``doc_id`` stays null; other columns are ignored
unless named in ``keep``; texts shorter than a window keep all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import written
from marlstone.llm.textbatch import Words, dealt, pieces, runs, spans

WIDTH = 35
GRAM = 16
DEPTH = 2
SLICES = 64
#: Cells of a sketch row: 2**MIN_BITS to 2**MAX_BITS, about one for 16 bytes of text; MAX_BITS bounds what is broadcast (32 MB).
MIN_BITS, MAX_BITS = 16, 27
#: Bytes of text whose candidate windows are grouped in one task.
SHARD_BYTES = 6 << 20
FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
#: A window as it is sent: 96 bits of hash, its text's place in the list sent along, its first word, and whether its piece has settled it.
RECORD = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<u4"), ("at", "<u4")])
KNOWN = np.uint32(1 << 31)


def _slide(x: np.ndarray, n: int, of: np.ufunc, end) -> np.ndarray:
    """``of`` over x[i : i + n] for every i; beyond the array counts as ``end``."""
    x = np.concatenate([x, np.full(n, end, x.dtype)])
    done = 1
    while done * 2 <= n:
        x = of(x[:-done], x[done:])
        done *= 2
    if done < n:
        x = of(x[: len(x) - (n - done)], x[n - done :])
    return x


class Anchored:
    """Windows of a piece with their anchors."""

    def __init__(self, texts: pa.Array, width: int):
        self.words = w = Words(texts)
        self.hash = w.hashes()
        n, gram = len(w), min(GRAM, width)
        many = width - gram + 1
        row_end = np.repeat(w.first[1:], np.diff(w.first))
        at = np.arange(n)
        g = np.full(n, FAR)
        g[: max(0, n - gram + 1)] = runs(self.hash, gram)
        g[at + gram > row_end] = FAR
        self.whole = at + width <= row_end
        #: Anchor of the window that starts at each word; 0 where none starts.
        self.anchor = np.where(self.whole, _slide(g, many, np.minimum, FAR)[:n], np.uint64(0))
        # a gram is an anchor if one of the windows around it chose it
        back = _slide(self.anchor[::-1], many, np.maximum, np.uint64(0))[:n][::-1]
        self.grams = g[(back == g) & (g != FAR)]

    def window_hashes(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at the given words."""
        return runs(self.hash, width)[at], runs(self.hash, width, 1)[at]


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h * r) >> np.uint64(64 - bits)).astype(np.int64) for r in ROWS]


def repeated_cells(docs: DataFrame, bits: int, width: int) -> list[np.ndarray]:
    """Per sketch row, the packed bits of the cells that were counted twice or more."""
    size = (1 << bits) // SLICES

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            for r, c in enumerate(cells(h, bits)):
                cell, n = np.unique(c, return_counts=True)
                local = (cell % size).astype(np.uint32) * 2 + (n > 1)
                cut = list(dealt(cell // size))
                yield pa.RecordBatch.from_arrays([pa.array([s + r * SLICES for s, _ in cut], pa.int64()), pa.array([local[p].astype("<u4").tobytes() for _, p in cut], pa.binary())], ["slice", "cells"])

        for b in pieces(batches):
            if len(g := Anchored(b.column("text"), width).grams):
                held.append(g)
                many += len(g)
            if many > 2_000_000:
                yield from flush()
                held, many = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, data in zip(b.column("slice").to_pylist(), b.column("cells")):
                x = np.frombuffer(data.as_buffer(), "<u4")
                once, twice = seen.setdefault(s, (np.zeros(size, bool), np.zeros(size, bool)))
                cell = x >> 1
                twice[cell] |= once[cell] | (x & 1 == 1)
                once[cell] = True
        for s, (_, twice) in seen.items():
            yield pa.RecordBatch.from_pydict({"slice": [s], "bits": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    parts = docs.mapInArrow(sketch, "slice long, cells binary").repartition(SLICES * DEPTH // 4, "slice").mapInArrow(merge, "slice long, bits binary")
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    for r in parts.toLocalIterator():  # DEPTH * 2**bits / 8 bytes at most
        at = r.slice % SLICES * (size // 8)
        out[r.slice // SLICES][at : at + size // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _stretches(row: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """Per row, the merged stretches of words that the windows cover, as pairs of 32-bit integers."""
    if not len(at):
        return
    order = np.lexsort((at, row))
    row, at = row[order].astype(np.int64), at[order].astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + width)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(at)) - 1
    pairs = np.stack([at[start], at[stop] + width], axis=1).astype("<u4")
    owner = row[start]
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(owner[a]), pairs[a:b].tobytes()


def repeats(docs: DataFrame, bits: int, sketch: list[np.ndarray], width: int, shards: int) -> DataFrame:
    """Stretches covered by repeated windows: ``md5`` of the text (16 bytes) and ``stretches``, some rows per text."""
    shipped = docs.sparkSession.sparkContext.broadcast(sketch)  # DEPTH * 2**MAX_BITS / 8 bytes at most
    out_of = ["shard", "settled", "md5", "data"]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = shipped.value
        for b in pieces(batches):
            w = Anchored(b.column("text"), width)
            at = np.flatnonzero(w.whole)
            hit = np.ones(len(at), bool)
            for row, c in zip(bit, cells(w.anchor[at], bits)):
                hit &= row[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 == 1
            at = at[hit]
            if not len(at):
                continue
            x, y = w.window_hashes(at, width)
            order = np.lexsort((y, x))
            x, y, at = x[order], y[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            row_of = np.searchsorted(w.words.first, at, side="right") - 1
            place = at - w.words.first[row_of]
            body, offsets = w.words.body, w.words.offsets
            md5: dict[int, bytes] = {}

            def digest(k: int) -> bytes:
                if k not in md5:
                    md5[k] = hashlib.md5(body[offsets[k] : offsets[k + 1]].tobytes()).digest()
                return md5[k]

            settled = many[group]
            found = list(_stretches(row_of[settled], place[settled], width))
            if found:  # these only pass through, and any shard will do
                yield pa.RecordBatch.from_arrays([pa.array([(int(x[0]) + k) % shards for k, _ in found], pa.int64()), pa.array([True] * len(found)), pa.array([digest(k) for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.binary())], out_of)
            first = np.flatnonzero(new)
            shard = (w.anchor[at[first]] * ROWS[0] % np.uint64(shards)).astype(np.int64)
            deal = np.argsort(shard, kind="stable")
            first, shard = first[deal], shard[deal]
            full, names, sent = [], [], []
            for s, p in dealt(shard):
                f = first[p]
                full.append(s)
                rows, doc = np.unique(row_of[f], return_inverse=True)
                r = np.empty(len(f), RECORD)
                r["a"], r["b"], r["doc"], r["at"] = x[f], y[f], doc, place[f].astype(np.uint32) | KNOWN * many[group[f]]
                names.append(b"".join(digest(k) for k in rows.tolist()))
                sent.append(r.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([False] * len(full)), pa.array(names, pa.binary()), pa.array(sent, pa.binary())], out_of)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, records, base = [], [], 0
        for both in batches:
            done = both.filter(both.column("settled"))
            yield pa.RecordBatch.from_arrays([done.column("md5"), done.column("data")], ["md5", "stretches"])
            b = both.filter(pa.compute.invert(both.column("settled")))
            for name, data in zip(b.column("md5"), b.column("data")):
                r = np.frombuffer(data.as_buffer(), RECORD).copy()
                r["doc"] += base
                base += len(name.as_buffer()) // 16
                names.append(name.as_py())
                records.append(r)
        if not records:
            return
        r = np.concatenate(records)
        records.clear()
        order = np.lexsort((r["b"], r["a"]))
        r = r[order]
        new = np.ones(len(r), bool)
        new[1:] = (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])
        g = np.cumsum(new) - 1
        known = r["at"] >= KNOWN
        again = (np.bincount(g) > 1) | (np.bincount(g, known) > 0)
        # what a piece settled for itself it has sent already
        r = r[again[g] & ~known]
        md5 = b"".join(names)
        found = list(_stretches(r["doc"], r["at"], width))
        for a in range(0, len(found), 5000):
            part = found[a : a + 5000]
            yield pa.RecordBatch.from_arrays([pa.array([md5[k * 16 : k * 16 + 16] for k, _ in part], pa.binary()), pa.array([d for _, d in part], pa.binary())], ["md5", "stretches"])

    return docs.mapInArrow(propose, "shard long, settled boolean, md5 binary, data binary").repartition(shards, "shard").mapInArrow(group, "md5 binary, stretches binary")


def strip(texts: pa.Array, stretches: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Kept words joined by one space, number of words, number removed, per row; ``stretches`` holds lists of packed pairs."""
    w = Words(texts)
    n_words = np.diff(w.first)
    edge = np.zeros(len(w) + 1, np.int32)
    for k, parts in enumerate(stretches.to_pylist()):
        for p in parts or ():
            pair = np.frombuffer(p, "<u4").astype(np.int64) + w.first[k]
            np.add.at(edge, pair[0::2], 1)
            np.add.at(edge, pair[1::2], -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.flatnonzero(~gone)
    row = spans(w.first)[kept] if len(w) else kept
    size = w.stop[kept] - w.start[kept] + 1
    total = np.cumsum(size)
    source = np.repeat(w.start[kept] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    out = np.append(w.body, np.uint8(32))[source]
    out[total - 1] = 32
    count = np.bincount(row, minlength=len(n_words)) if len(row) else np.zeros(len(n_words), np.int64)
    ends = np.concatenate([[0], total])[np.cumsum(count)]
    begins = np.concatenate([[0], ends[:-1]])
    flat = out.tobytes()
    return [flat[a : max(a, b - 1)] for a, b in zip(begins.tolist(), ends.tolist())], n_words, n_words - count


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept_sha256"), keep: tuple[str, ...] = (), max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document with what is left of its text; a row of the sketch, which every task gets, has ``2**max_bits`` cells at most.

    ``outputs``: ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space) and ``kept_sha256``.
    """
    if width < 1:
        raise ValueError("a window has one word at least")
    text_only = docs.select(docs[text_col].alias("text")).where(F.col("text").isNotNull())
    size = text_only.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max_bits, max(MIN_BITS, int(size // 16).bit_length()))
    found = repeats(text_only, bits, repeated_cells(text_only, bits, width), width, max(16, int(size // SHARD_BYTES)))
    # written first, so that the documents lie under the join as they were shuffled, and copies of one text are split there if there are very many
    per_text = written(found.groupBy("md5").agg(F.collect_set("stretches").alias("stretches")), "stretches")
    kept = [c for c in keep if c not in {*outputs, "doc_id"}]
    # kept columns go by number until the end, so that none clashes
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"kept{k}") for k, c in enumerate(kept)))
    both = src.withColumn("md5", F.unhex(F.md5(F.col("text").cast("binary")))).join(per_text, "md5", "left").drop("md5")
    kinds = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            left, n, removed = strip(b.column("text"), b.column("stretches"))
            made = {
                "n_words": lambda: pa.array(n), "n_removed": lambda: pa.array(removed), "kept": lambda: pa.array(left, pa.binary()).cast(pa.string()),
                "kept_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(f"kept{k}") for k in range(len(kept))), *(made[c]() for c in outputs)], ["doc_id", *kept, *outputs])

    fields = [f"`{c}` {src.schema[name].dataType.simpleString()}" for c, name in [("doc_id", "id"), *((c, f"kept{k}") for k, c in enumerate(kept))]]
    return both.mapInArrow(run, ", ".join([*fields, *(f"{c} {kinds[c]}" for c in outputs)]))
