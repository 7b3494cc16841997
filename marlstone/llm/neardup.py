"""Near-duplicate classes: DartMinHash signatures, banded, with an exact check.

1. Texts with the same words are copies and count as one from here on.
2. Each distinct text's set of five-word shingles gets a DartMinHash signature; bands of it put similar texts into
   common buckets (two texts at the threshold miss each other in all of them about three times in 100,000).
3. In every bucket, each member is compared with one leader: the member whose buckets are fullest, which in a group of
   copies tends to be their original.  That is linear in the bucket, and settles what is alike.
4. Buckets whose members are still in several components are compared in blocks of texts of like size: intersections of all pairs of a block pair
   are one matrix product, and only links that join components come out.
5. Classes are the connected components of the links.

Shingles weigh one each by default, so that the similarity is the Jaccard similarity of the shingle sets; with
``weighted=True`` a shingle weighs as often as it occurs, and the similarity is the weighted one.
Copies are told by 128-bit digests of their words; shingles are compared by 32-bit hashes: at most a shingle or so among thousands is confused.

Defined results: null and empty texts are copies of one another; a text of fewer words than a shingle is one shingle; rows with the
same ``doc_id`` are in the classes of their texts; a class whose ids are all null has a null ``class_id``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.components import components
from marlstone.llm.dartminhash import signatures
from marlstone.llm.shared import Scratch, arrow_rows, written
from marlstone.llm.textbatch import Words, mix, pieces, windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 20, 4
#: Members of a block in step 4.
BLOCK = 256
#: Block pairs that a worker gets at a time.
DUELS = 8


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles of all rows, their rows and multiplicities, and a 16-byte key of each row's words."""
    w = Words(texts)
    h, n = w.hashes(), len(texts)
    g, at = windows(h, w.first, width)
    row = np.searchsorted(w.first, at, side="right") - 1
    size = np.diff(w.first)
    keys = w.keys()
    short = np.flatnonzero((size > 0) & (size < width))
    whole = np.array([int.from_bytes(keys[k][:8], "little") for k in short.tolist()], np.uint64)
    g, row = np.concatenate([g, whole]), np.concatenate([row, short])
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return g[first], row[first], np.diff(np.append(first, len(g))), keys


def profiles(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``row`` if it has one, ``key`` of its words, ``bands`` (a hash each) and ``shingles``; copies within a piece have the latter two null."""
    own = [c for c in ("doc_id", "row") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            e, row, times, keys = shingle_sets(b.column("text"))
            n = b.num_rows
            first = {k: i for i, k in reversed(list(enumerate(keys)))}
            fresh = np.array([first[k] == i for i, k in enumerate(keys)])
            pick = fresh[row]
            sig = signatures(e[pick], row[pick], n, BANDS * BAND_ROWS, times[pick] if weighted else None)
            band = mix(sig.reshape(n, BANDS, BAND_ROWS) * np.array([3, 5, 7, 11], np.uint64)[:BAND_ROWS]).sum(2, dtype=np.uint64)
            band = mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            if weighted:  # the j-th occurrence of a shingle is an element of its own, so sets stand for multisets
                j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                e, row = mix(np.repeat(e, times) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(row, times)
            small = (e >> np.uint64(32)).astype(np.uint32).view(np.int32)
            cut = np.searchsorted(row, np.arange(n + 1))
            has = fresh & (np.diff(cut) > 0)
            none = ~has
            flat = band.reshape(-1)
            at = np.arange(0, (n + 1) * BANDS, BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c) for c in own), pa.array(keys, pa.binary()),
                    pa.array([None if none[i] else flat[at[i] : at[i + 1]] for i in range(n)], pa.list_(pa.int64())),
                    pa.array([None if none[i] else np.unique(small[cut[i] : cut[i + 1]]) for i in range(n)], pa.list_(pa.int32())),
                ],
                [*own, "key", "bands", "shingles"],
            )

    fields = {"doc_id": "doc_id long", "row": "row string"}
    return docs.mapInArrow(run, ", ".join([*(fields[c] for c in own), "key binary, bands array<long>, shingles array<int>"]))


def block_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between members of different components in pairs of blocks; of those that would close a ring, none."""
    for b in batches:
        for r in range(b.num_rows):
            same = b.column("same")[r].as_py()
            sides = [b.column(c)[r].values for c in (("left",) if same else ("left", "right"))]
            split = 0 if same else len(sides[0])
            keys = [k for s in sides for k in s.field("key").to_pylist()]
            comps = [k for s in sides for k in s.field("comp").to_pylist()]
            sets = []
            for s in sides:
                lists = s.field("shingles")
                flat, cut = lists.values.to_numpy(), lists.offsets.to_numpy()
                sets += [flat[x:y] for x, y in zip(cut, cut[1:])]
            size = np.array([len(s) for s in sets], np.float64)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size.astype(int))
            _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
            shared = times[code] > 1
            names = np.cumsum(times > 1) - 1
            code, owner = names[code[shared]], owner[shared]
            n, wide = len(sets), 4096
            a, z = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
            both = np.zeros((len(range(n)[a]), len(range(n)[z])), np.float32)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            for low in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
                p, q = np.searchsorted(code, (low, low + wide))
                x = np.zeros((n, wide), np.float32)
                x[owner[p:q], code[p:q] - low] = 1
                both += x[a] @ x[z].T
            ok = both >= threshold * (size[a][:, None] + size[z][None, :] - both) - 1e-6
            parent = {c: c for c in comps}

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            left, right = [], []
            for i, j in zip(*(v.tolist() for v in np.nonzero(ok))):
                p, q = root(comps[i]), root(comps[j + split])
                if p != q:
                    parent[p] = q
                    left.append(keys[i])
                    right.append(keys[j + split])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def duels(scratch: Scratch, members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks of a bucket's members (``bucket``, ``key``, ``comp``) that can hold similar texts: ``left``, ``right`` and whether these are ``same``.

    Blocks hold texts of one class of size; similar texts are of the same class or of neighbouring ones.  Pairs are listed by number and dealt
    out before the members join them, each block by its own name, so that a full bucket is spread over tasks.  Shingles join last.
    """
    wide = float(-np.log(min(threshold, 0.99))) * (1 + 1e-9)  # a little more than sizes of similar texts may differ by
    size = F.floor(F.log(F.greatest(F.size("shingles"), F.lit(1)).cast("double")) / wide).cast("int").alias("size")
    sized = scratch.written(members.join(sets.select("key", size), "key"), "open")
    parts = scratch.written(sized.groupBy("bucket", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    block = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    placed = sized.join(parts, ["bucket", "size"]).withColumn("block", block).join(sets, "key").repartition("bucket", "size", "block")
    blocks = scratch.written(placed.groupBy("bucket", "size", "block").agg(F.collect_list(F.struct("key", "comp", "shingles")).alias("members")), "blocks")
    above = parts.select("bucket", (F.col("size") - 1).alias("size"), F.col("parts").alias("more"))
    each = parts.join(above, ["bucket", "size"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.transform(F.sequence("block", F.col("parts") - 1), lambda k: F.struct(F.col("size").alias("size"), k.alias("block")))
    next_ = F.when(F.col("more") > 0, F.transform(F.sequence(F.lit(0), F.col("more") - 1), lambda k: F.struct((F.col("size") + 1).alias("size"), k.alias("block")))).otherwise(F.expr("array()"))
    listed = each.repartition("bucket", "size", "block").select("bucket", "size", "block", F.explode(F.concat(own, next_)).alias("other"))
    left = blocks.withColumnRenamed("members", "left")
    right = blocks.select("bucket", F.struct("size", "block").alias("other"), F.col("members").alias("right"))
    same = (F.col("other.size") == F.col("size")) & (F.col("other.block") == F.col("block"))
    return listed.join(left, ["bucket", "size", "block"]).join(right, ["bucket", "other"]).select("left", "right", same.alias("same"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least id of its class), ``class_size`` (documents) and ``n_texts`` (distinct texts) of the class.

    ``row_col`` names a string column that tells rows apart whatever their ids; with it there are also ``row`` and ``first_row``,
    the row of the class with the least id (nulls last), and of those the least ``row``.
    """
    own = ["row"] if row_col else []
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), *(docs[row_col].alias(c) for c in own), docs[text_col].alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        made = scratch.written(profiles(src, weighted), "profiles")
        texts = made.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"))
        banded = texts.select("key", F.explode("bands").alias("bucket"))
        # what is joined by bucket, leader or class is written first, so that the side with a row per text lies under the join as it was
        # shuffled, and is split there if one key has much of it
        sizes = scratch.written(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        hits = scratch.written(banded.join(sizes, "bucket"), "hits")
        score = hits.groupBy("key").agg(F.sum("n").alias("score"))
        leaders = scratch.written(hits.join(score, "key").groupBy("bucket").agg(F.max(F.struct("score", "key")).alias("top")).select("bucket", F.col("top.key").alias("leader")), "leaders")
        pairs = hits.join(leaders, "bucket").where("key <> leader").select("leader", "key").distinct()
        sets = scratch.written(made.where("shingles is not null").select("key", "shingles").join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "sets")
        both = pairs.join(sets, "key").join(sets.select(F.col("key").alias("leader"), F.col("shingles").alias("s")), "leader")
        common = F.size(F.array_intersect("shingles", "s"))
        linked = scratch.written(both.where(common >= threshold * (F.size("shingles") + F.size("s") - common) - 1e-6).select(F.col("leader").alias("a"), F.col("key").alias("b")), "links")
        labels = components(linked)

        placed = hits.select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("comp"))
        mixed = scratch.written(placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket"), "mixed")
        more = duels(scratch, placed.join(mixed, "bucket"), sets, threshold).mapInArrow(lambda it: block_links(it, threshold), "a binary, b binary")
        with arrow_rows(docs.sparkSession, DUELS):
            more = scratch.written(more, "links")
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

        classed = made.select("doc_id", *own, "key").join(labels.withColumnRenamed("node", "key"), "key", "left").select("doc_id", *own, "key", F.coalesce("label", "key").alias("label"))
        classed = written(classed, "classes")
    least = lambda c: [F.min(c).alias("first")] if own else []
    summary = classed.groupBy("label", "key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), *least(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *own)))
    summary = written(summary.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"), *least(F.col("first"))), "summary")
    out = classed.select("doc_id", *own, "label").join(summary, "label")
    return out.select("doc_id", "class_id", "class_size", "n_texts", *own, *(F.col("first.row").alias("first_row") for _ in own))
