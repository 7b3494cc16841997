"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may differ from a document's passage by ``floor(rate * m)`` edits.  It is cut into one piece more
than that, so at least one piece occurs exactly.  Pieces are searched by the hash of their first bytes at every position of the text
at once; each hit says where the passage would lie, and Myers' bit-parallel algorithm finds the least number of edits there.

Texts and items are compared in lower case with runs of ASCII white space as one space.  The items are the
query set: they are taken in blocks of at most ``BLOCK_CHARS`` characters, each block against all documents in one pass.

Defined results: null and empty texts contain nothing; items that are null, blank or without an id are left out; repeated items
count once; a document that holds an item several times lists it once, with its least number of edits; repeated rows repeat; a null ``doc_id``
stays null; other columns are ignored unless named in ``keep``; without items nothing is contaminated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.textbatch import SPACE, pieces, raw

RATE = 0.08
BLOCK_CHARS = 8 << 20
#: Bytes of a piece that are looked up; shorter pieces are looked up whole.
PROBE = 12
FILTER_BITS = 20
_ODDS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(PROBE)]


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[SPACE] = 32
    return table


LOWER = _lower()


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets in lower case (ASCII, and two-byte Latin-1 letters), white space collapsed."""
    body, offsets = raw(texts)
    low = LOWER[body]
    accent = np.zeros(len(low), bool)
    accent[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low[accent] += 32
    space = low == 32
    drop = np.zeros(len(low), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[offsets[:-1][offsets[:-1] < len(low)]] = False
    kept = np.zeros(len(low) + 1, np.int64)
    np.cumsum(~drop, out=kept[1:])
    return low[~drop], kept[offsets]


def distance(pattern: str, text: str) -> int:
    """The least number of edits between the pattern and any stretch of the text (Myers, bit-parallel)."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(pattern):
        where[ch] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for ch in text:
        eq = where.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


class Pieces:
    """A block of items, cut into pieces and indexed by the hashes of their beginnings."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.budget = items, []
        found: dict[int, dict[int, list[tuple[int, int, int, bytes]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, text) in enumerate(items):
            e = int(rate * len(text))
            cuts = [len(text) * j // (e + 1) for j in range(e + 2)]
            self.budget.append(e)
            for a, b in zip(cuts, cuts[1:]):
                piece = text[a:b].encode()
                q = min(PROBE, len(piece))
                h = int(probe_hash(np.frombuffer(piece, np.uint8), q)[0])
                found[q][h].append((k, a, len(text[:a].encode()), piece))
        self.lookup = {q: dict(x) for q, x in found.items()}
        self.filters = {}
        for q, x in self.lookup.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[np.array(list(x), np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
            self.filters[q] = bits

    def search(self, body: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], int]:
        """(row, item) -> least number of edits, for all that stay within their budget."""
        out: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int, int]] = set()
        flat = body.tobytes()
        for q, index in self.lookup.items():
            if len(body) < q:
                continue
            h = probe_hash(body, q)
            at = np.flatnonzero(self.filters[q][h >> np.uint64(64 - FILTER_BITS)])
            row = np.searchsorted(offsets, at, side="right") - 1
            for p, r, v in zip(at.tolist(), row.tolist(), h[at].tolist()):
                for k, chars, before, piece in index.get(v, ()):
                    if out.get((r, k)) == 0 or (r, k, p - before) in tried or flat[p : p + len(piece)] != piece:
                        continue
                    tried.add((r, k, p - before))
                    # what lies as far to both sides as the item does, and as many characters more as there may be edits
                    item, e = self.items[k][1], self.budget[k]
                    left, right = chars + e, len(item) - chars + e
                    low, high = max(int(offsets[r]), p - 4 * left), min(int(offsets[r + 1]), p + 4 * right)
                    head = flat[low:p].decode("utf-8", "ignore")
                    text = head[max(0, len(head) - left) :] + flat[p:high].decode("utf-8", "ignore")[:right]
                    d = distance(item, text)
                    if d <= e:
                        out[r, k] = min(d, out.get((r, k), d))
        return out


def probe_hash(body: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all ``q``-byte stretches; what they find is compared byte by byte, so that products will do."""
    count = len(body) - q + 1
    levels = [body.astype(np.uint64)]  # one, two, four and eight bytes from every place on, as numbers
    for k in range(min(q, 8).bit_length() - 1):
        levels.append(levels[-1][: -(1 << k)] | levels[-1][1 << k :] << np.uint64(8 << k))
    out, done = None, 0
    while done < q:
        k = min(q - done, 8).bit_length() - 1
        part = levels[k][done : done + count] * _ODDS[done % len(_ODDS)]
        out = part if out is None else np.add(out, part, out=out)
        done += 1 << k
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Normalised items, block by block."""
    rows = items.select(items[id_col].alias("id"), items[text_col].alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct().orderBy("id", "text")
    block, held = [], 0
    for r in rows.toLocalIterator():
        body, _ = normalise(pa.array([r.text]))
        if text := body.tobytes().decode().strip(" "):
            block.append((r.id, text))
            held += len(text)
        if held > BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``contaminated``, ``items`` (ids, ascending), ``edits`` (of each) and the columns named in ``keep``."""
    made = ["doc_id", "contaminated", "items", "edits"]
    kept = [c for c in keep if c not in made]
    cur = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text"), *(docs[c] for c in kept))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cur.schema)
    cur = cur.withColumn("__found", F.expr("cast(array() as array<struct<item: bigint, edits: int>>)"))

    def searcher(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for b in pieces(batches, "__text"):
                hits: dict[int, list] = defaultdict(list)
                for (r, k), d in index.search(*normalise(b.column("__text"))).items():
                    hits[r].append({"item": index.items[k][0], "edits": d})
                before = b.column("__found")
                new = pa.array([hits.get(r, []) for r in range(b.num_rows)], before.type)
                if pa.compute.sum(pa.compute.list_value_length(before)).as_py():
                    new = pa.array([x + y for x, y in zip(before.to_pylist(), new.to_pylist())], before.type)
                yield b.set_column(b.schema.get_field_index("__found"), "__found", new)

        return run

    for block in item_blocks(items, item_id, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(Pieces(block, rate))  # bounded by BLOCK_CHARS
        cur = cur.mapInArrow(searcher(shipped), f"{fields}, __found array<struct<item: bigint, edits: int>>")
    # an id may stand for several texts: the best match counts
    best = F.array_sort(F.expr("aggregate(__found, cast(map() as map<bigint, int>), (m, x) -> map_concat(map_filter(m, (k, v) -> k <> x.item), map(x.item, least(x.edits, coalesce(try_element_at(m, x.item), x.edits)))), m -> map_entries(m))"))
    return cur.withColumn("__best", best).select("doc_id", (F.size("__best") > 0).alias("contaminated"), F.col("__best.key").alias("items"), F.col("__best.value").alias("edits"), *kept)
