"""Approximate nearest neighbours by cross-polytope hashing.

Vectors, less the mean of a sample and brought to unit length, go through pseudo-rotations (three rounds of random signs and a fast Hadamard
transform); a table's code is the signed axis nearest to the rotated vector, together with the nearest of some axes of a second
rotation.  There are about as many buckets as vectors (one for ``FILL`` of them), up to ``MOST_BUCKETS`` and to what two rotations give: the finer they
are, the fewer vectors that are not near the probes bring along.  A query probes, in every table, the buckets whose axes lie
nearest; what the tables collect, and nothing else, is ranked by exact Euclidean distance on the original vectors.

How many buckets are probed is measured, not set: on a sample of at most ``SAMPLE`` vectors of each length, the neighbours of
``ASKED`` of them are found by brute force, and the probes are the fewest that find ``RECALL`` of these.  Neighbours among all vectors are
nearer than those in a sample, and so easier to find.  On data without any structure in hundreds of dimensions, that many
probes are much of the table: all neighbours are then about as far as any other vector, and no hash tells them.

Equal vectors are one entry of the index with their least ids, so a vector that a third of all rows hold costs one comparison.
The queries are a stated set against all rows: they lie in blocks of about ``QUERY_BLOCK`` in the shared folder, with the buckets they probe, and tasks over
the index read block after block.  A query that its buckets leave with too few neighbours is compared with every vector.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, take no
part; only vectors of the same number of components are compared (tables are made for the ``LENGTHS`` commonest numbers; others are
compared with all of theirs); a row that occurs repeatedly counts once; with fewer candidates than ``k``, all are returned; ties go to the
smaller id; components of any size are fine; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import Scratch, filesystem, shared_path, written

TABLES, FILL, MOST_BUCKETS = 24, 1, 1 << 16
SAMPLE, ASKED, RECALL = 8192, 256, 0.95
LENGTHS = 16
QUERY_BLOCK = 4096
SEED = 20
#: Vectors that are compared at a time within a task, and pairs whose components are in memory at a time.
TILE, PAIRS = 4096, 1 << 15
#: Queries whose probes are worked out at a time, by number of buckets.
COSTS = 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, orthonormal; the row length is a power of two."""
    rows, n = x.shape
    half = 1
    while half < n:
        y = x.reshape(rows, n // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=8)
def signs(dimension: int, tables: int) -> np.ndarray:
    """Random signs: tables x 2 rotations x 3 rounds x padded dimension."""
    padded = 1 << max(0, dimension - 1).bit_length()
    return np.random.default_rng([SEED, dimension]).choice([-1.0, 1.0], (tables, 2, 3, padded))


def lengths(d: np.ndarray) -> np.ndarray:
    """Euclidean length of each row, whatever the size of its components: these are brought near one by a power of two, which is exact."""
    most = np.abs(d).max(1, initial=0.0)
    shift = np.frexp(most)[1]
    plain = (most == 0) | (np.abs(shift) < 400)
    out = np.empty(len(d))
    out[plain] = np.sqrt(np.einsum("ij,ij->i", d[plain], d[plain]))
    if not plain.all():
        x = np.ldexp(d[~plain], -shift[~plain, None])
        out[~plain] = np.ldexp(np.sqrt(np.einsum("ij,ij->i", x, x)), shift[~plain])
    return out


@dataclass
class Tables:
    """Hash tables for vectors of one length."""

    center: np.ndarray
    second: int  # axes of the second rotation
    tables: int
    probes: int = 1

    @property
    def buckets(self) -> int:
        return 2 * signs(len(self.center), self.tables).shape[-1] * 2 * self.second

    def rotations(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per table: values along the signed axes of the first rotation, and along those used of the second."""
        flips = signs(v.shape[1], self.tables)
        x = v / 2 - self.center / 2  # halves, so that the difference doesn't overflow
        x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
        size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        u = np.zeros((len(v), flips.shape[-1]))
        u[:, : v.shape[1]] = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        for table in flips:
            both = []
            for rounds in table:
                r = u
                for s in rounds:
                    r = hadamard(r * s)
                both.append(r)
            second = both[1][:, : self.second]
            yield np.hstack([both[0], -both[0]]), np.hstack([second, -second])

    def codes(self, v: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        return np.stack([a.argmax(1) * b.shape[1] + b.argmax(1) for a, b in self.rotations(v)], axis=1).astype(np.int32)

    def costs(self, v: np.ndarray) -> Iterator[np.ndarray]:
        """Per table, how far each bucket is from each vector: by how much its axes fall short of the nearest ones."""
        for a, b in self.rotations(v):
            cost = ((a.max(1, keepdims=True) - a) ** 2)[:, :, None] + ((b.max(1, keepdims=True) - b) ** 2)[:, None, :]
            yield cost.reshape(len(v), -1)

    def probed(self, v: np.ndarray) -> np.ndarray:
        """queries x tables x probes: the nearest buckets."""
        most, out, step = min(self.probes, self.buckets), [], max(1, COSTS // self.buckets)
        for at in range(0, len(v), step):
            out.append(np.stack([np.argpartition(c, most - 1, axis=1)[:, :most] for c in self.costs(v[at : at + step])], axis=1).astype(np.int32))
        return np.concatenate(out) if out else np.empty((0, self.tables, most), np.int32)


def calibrated(sample: np.ndarray, n: int, k: int, tables: int = TABLES, recall: float = RECALL) -> Tables:
    """Tables for ``n`` vectors, and the fewest probes that find ``recall`` of the nearest neighbours within the sample."""
    center = sample.mean(0)
    if not np.isfinite(center).all():
        center = np.ldexp(np.ldexp(sample, -1030).mean(0), 1030)
    padded = signs(sample.shape[1], tables).shape[-1]
    made = Tables(center, int(np.clip(min(n // FILL, MOST_BUCKETS) // (4 * padded), 1, padded)), tables)
    asked = sample[: min(ASKED, len(sample))]
    ranks, code, step = [], made.codes(sample), max(1, COSTS // made.buckets)
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        near = np.empty((len(q), min(k, len(sample) - 1)), np.int64)
        for i in range(len(q)):
            d = lengths(sample - q[i])
            d[at + i] = np.inf
            near[i] = np.argsort(d, kind="stable")[: near.shape[1]]
        rank = np.full(near.shape, made.buckets)
        for t, cost in enumerate(made.costs(q)):
            own = np.take_along_axis(cost, code[near, t].astype(np.int64), 1)
            order = np.sort(cost, axis=1)
            rank = np.minimum(rank, np.stack([np.searchsorted(order[i], own[i], side="right") for i in range(len(q))]))
        ranks.append(rank.reshape(-1))
    ranks = np.sort(np.concatenate(ranks)) if ranks else np.empty(0)
    made.probes = int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) if len(ranks) else made.buckets
    return made


class Asked:
    """A block of queries of one length, listed by the buckets they probe."""

    def __init__(self, rep: np.ndarray, vec: np.ndarray, probes: np.ndarray | None, buckets: int):
        """``probes``: queries x tables x probes; without them, every vector is a candidate."""
        self.rep, self.vec, self.lists = rep, vec, []
        if probes is not None:
            for t in range(probes.shape[1]):
                flat = probes[:, t].reshape(-1)
                order = np.argsort(flat, kind="stable")
                self.lists.append((order // probes.shape[2], np.searchsorted(flat[order], np.arange(buckets + 1))))

    def candidates(self, code: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of queries and vectors that share a bucket in some table, each once, by query."""
        met = np.zeros((len(self.rep), n), bool)
        if not self.lists:
            met[:] = True
        for t, (query, at) in enumerate(self.lists):
            begin, many = at[code[:, t]], at[code[:, t] + 1] - at[code[:, t]]
            ends = np.cumsum(many)
            met[query[np.repeat(begin - (ends - many), many) + np.arange(ends[-1])], np.repeat(np.arange(n), many)] = True
        return np.nonzero(met)

    def search(self, vectors: np.ndarray, code: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, vectors and distances of the ``k`` nearest candidates of each query."""
        found, edge = [], np.full(len(self.rep), np.inf)
        for a in range(0, len(vectors), TILE):
            part = vectors[a : a + TILE]
            query, at = self.candidates(None if code is None else code[a : a + TILE], len(part))
            for b in range(0, len(query), PAIRS):
                q, v = query[b : b + PAIRS], at[b : b + PAIRS]
                d = lengths(part[v] - self.vec[q])
                keep = np.flatnonzero(d <= edge[q])
                q, v, d = q[keep], v[keep], d[keep]
                order = np.lexsort((v, d, q))
                q, v, d = q[order], v[order], d[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                keep = nth < k
                found.append((q[keep], v[keep] + a, d[keep]))
                full = nth == k - 1
                edge[q[full]] = np.minimum(edge[q[full]], d[full])
        q, v, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], d[keep]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` nearest others: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (distance)."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(sound).groupBy("vec", "id").agg(F.lit(1).alias("one"))
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    entries = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    scratch = Scratch(spark)
    entries = scratch.written(entries.select(F.col("ids")[0].alias("rep"), "ids", "vec", F.size("vec").alias("d")), "entries")
    models = fitted(entries, k, tables, recall)
    shipped = spark.sparkContext.broadcast(models)  # LENGTHS of them at most, each with one vector

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        size = b.column("d").to_numpy()
        for d in np.unique(size).tolist():
            yield d, b.filter(pa.array(size == d))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b):
                m = shipped.value.get(d)
                code = [c.tobytes() for c in m.codes(matrix(part.column("vec"), d))] if m else [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.binary())], ["rep", "ids", "vec", "d", "codes"])

    with scratch:
        index = written(entries.mapInArrow(coded, "rep long, ids array<long>, vec array<double>, d int, codes binary"), "index")
    asking = written(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vec").join(index.select("vec", "rep"), "vec").select("query_id", "rep"), "queries")
    wanted = index.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "vec", "d")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in by_length(b):
                m = shipped.value.get(d)
                probes = [p.tobytes() for p in m.probed(matrix(part.column("vec"), d))] if m else [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(probes, pa.binary())], ["rep", "vec", "d", "probes"])

    found = scan(index, wanted.mapInArrow(probing, "rep long, vec array<double>, d int, probes binary"), k + 1, shipped)
    population = rows.groupBy(F.size("vec").alias("d")).agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("enough"))
    held = found.groupBy("rep").agg(F.sum(F.size("ids")).alias("held"))
    lacking = wanted.join(held, "rep", "left").join(population, "d").where(F.coalesce("held", F.lit(0)) < F.col("enough"))
    lacking = written(lacking.select("rep", "vec", "d", F.lit(None).cast("binary").alias("probes")), "lacking")
    if not lacking.isEmpty():
        found = found.join(lacking.select("rep"), "rep", "left_anti").unionByName(scan(index, lacking, k + 1, shipped))
    spread = asking.join(found, "rep").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(entries: DataFrame, k: int, tables: int, recall: float) -> dict[int, Tables]:
    """Tables for the ``LENGTHS`` commonest lengths of vectors, each from ``SAMPLE`` vectors drawn by hash."""
    out = {}
    for r in entries.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect():
        draw = F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 30))
        some = entries.where((F.col("d") == r.d) & (draw < min(1 << 30, int(1.2 * SAMPLE / r.n * (1 << 30)) + 1)))
        sample = np.array([x.vec for x in some.select("vec", draw.alias("draw")).orderBy("draw", "vec").limit(SAMPLE).collect()])
        out[r.d] = calibrated(sample, r.n, k, tables, recall)
    return out


def scan(index: DataFrame, queries: DataFrame, k: int, shipped) -> DataFrame:
    """The ``k`` nearest entries of each query (``rep``, ``vec``, ``d``, ``probes``) among its candidates: ``rep``, ``ids`` and ``score``; queries without probes are compared with every entry."""
    spark = index.sparkSession
    folder = shared_path(spark, "asked")
    queries = written(queries, "probes")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)

    def block(k: int) -> Iterator[tuple[int, Asked]]:
        """The queries of a block, by length, as they lie in the shared folder."""
        fs, place = filesystem(f"{folder}/block={k}")
        from pyarrow.fs import FileSelector, FileType

        files = sorted(f.path for f in fs.get_file_info(FileSelector(place, allow_not_found=True)) if f.type == FileType.File and f.path.endswith(".parquet"))
        if not files:
            return
        t = pa.concat_tables([pq.read_table(fs.open_input_file(f), columns=["rep", "vec", "d", "probes"]) for f in files]).combine_chunks()
        size = t["d"].to_numpy()
        for d in np.unique(size).tolist():
            part = t.filter(pa.array(size == d)).combine_chunks()
            rep, vec, m = part["rep"].to_numpy(), matrix(part["vec"].chunk(0), d), shipped.value.get(d)
            raw = [p.as_buffer() for p in part["probes"] if p.is_valid]
            probes = np.stack([np.frombuffer(p, np.int32).reshape(m.tables, -1) for p in raw]) if raw else None
            yield d, Asked(rep, vec, probes, m.buckets if m else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = list(block(0)) if blocks == 1 else None
        for b in batches:
            size = b.column("d").to_numpy()
            for n in range(blocks):
                for d, asked in one if one is not None else block(n):
                    part = b.filter(pa.array(size == d))
                    if not part.num_rows:
                        continue
                    code = np.stack([np.frombuffer(c.as_buffer(), np.int32) for c in part.column("codes")]) if asked.lists else None
                    q, v, score = asked.search(matrix(part.column("vec"), d), code, k)
                    yield pa.RecordBatch.from_arrays([pa.array(asked.rep[q]), part.column("ids").take(pa.array(v)), pa.array(score)], ["rep", "ids", "score"])

    best = F.row_number().over(Window.partitionBy("rep").orderBy("score", F.col("ids")[0]))
    return written(index.mapInArrow(run, "rep long, ids array<long>, score double").withColumn("n", best).where(F.col("n") <= k).drop("n"), "found")
