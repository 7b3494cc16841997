"""Token-id files: documents in ascending id order, coded by the context-mixing range coder.

A file holds ``MAGIC``, then length-prefixed blocks (see ``mixcoder``), then an index of
the documents (ids, null flags and token counts, deflated), the index's length, its CRC-32 and ``MAGIC``
again.  Blocks are cut by number of ids only, so a long document spans several; each can be decoded alone.

Files are written by the tasks of a range-partitioned, sorted stage straight into the shared folder, under a name
of the attempt's own; only the files that the finished attempts report are read, so a lost or repeated task does no harm.

Ids are those of the ``tokenizers`` library; distinct chunks of a piece that the worker hasn't met before are merged together (see
``bpe_batch``), which the tests hold against the library.

Defined results: a null or empty text has the end id alone; null document ids come first; equal ids follow one
another by text, each with a start of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import bpe, mixcoder
from marlstone.llm.shared import filesystem, shared_path
from marlstone.llm.textbatch import Words, pieces

MAGIC = b"MARLTOK1"
END_ID = 1
PIECE_BYTES = 6 << 20


def token_ids(texts: pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows, one row after another, and each row's number of ids; each distinct chunk is encoded once."""
    words = Words(texts)
    coded = words.array().dictionary_encode()
    pool, start, size = bpe.vocabulary(path).known.look(coded.dictionary)
    if end_id is not None:
        pool = np.append(pool, np.uint32(end_id))
    start, size = np.append(start, len(pool) - 1), np.append(size, end_id is not None)
    codes = np.insert(coded.indices.to_numpy(), words.first[1:], len(coded.dictionary))
    each = size[codes]
    total = np.cumsum(each)
    ids = pool[np.repeat(start[codes] - (total - each), each) + np.arange(total[-1] if len(total) else 0)]
    row_end = words.first[1:] + np.arange(1, len(texts) + 1)
    return ids, np.diff(np.concatenate([[0], total[row_end - 1]])) if len(texts) else np.empty(0, np.int64)


class Writer:
    """Writes one file, block by block."""

    def __init__(self, out, n_ids: int):
        self.out, self.n_ids, self.left, self.held, self.docs = out, n_ids, [], 0, []
        self.total = 0
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids, nulls, counts))
        self.left.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= mixcoder.BLOCK_IDS:
            flat = np.concatenate(self.left)
            whole = len(flat) // mixcoder.BLOCK_IDS * mixcoder.BLOCK_IDS
            for at in range(0, whole, mixcoder.BLOCK_IDS):
                self.block(flat[at : at + mixcoder.BLOCK_IDS])
            self.left, self.held = [flat[whole:]], len(flat) - whole

    def block(self, ids: np.ndarray) -> None:
        data = mixcoder.encode_block(ids, self.n_ids)
        self.out.write(len(data).to_bytes(4, "little") + data)

    def close(self) -> int:
        if self.held:
            self.block(np.concatenate(self.left))
        parts = list(zip(*self.docs)) or [(), (), ()]
        index = zlib.compress(b"".join(np.concatenate([np.empty(0, kind), *p]).astype(kind).tobytes() for p, kind in zip(parts, ("<i8", "u1", "<i8"))), 1)
        self.out.write((0).to_bytes(4, "little") + index + len(index).to_bytes(8, "little") + zlib.crc32(index).to_bytes(4, "little") + MAGIC)
        return sum(len(d[0]) for d in self.docs)


def read_file(source, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, null flags, token counts and CRC-32s of a file's documents, in runs of documents that end in the same block."""
    source.seek(size - 20)
    tail = source.read(20)
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 20 - n)
    index = source.read(n)
    source.seek(0)
    if tail[12:] != MAGIC or source.read(8) != MAGIC or zlib.crc32(index) != int.from_bytes(tail[8:12], "little"):
        raise ValueError("not a whole token file")
    flat = zlib.decompress(index)
    docs = len(flat) // 17
    doc_id, null, count = np.frombuffer(flat, "<i8", docs), np.frombuffer(flat, "u1", docs, docs * 8), np.frombuffer(flat, "<i8", docs, docs * 9)
    ends = np.cumsum(count)
    done, crc, first = 0, 0, 0
    while size := int.from_bytes(source.read(4), "little"):
        ids = mixcoder.decode_block(source.read(size)).astype("<u4")
        last = int(np.searchsorted(ends, done + len(ids), side="right"))
        sums, at, raw = [], 0, ids.tobytes()
        for end in (ends[first:last] - done).tolist():
            sums.append(zlib.crc32(raw[at * 4 : end * 4], crc))
            at, crc = end, 0
        crc = zlib.crc32(raw[at * 4 :], crc)
        done += len(ids)
        yield doc_id[first:last], null[first:last], count[first:last], np.array(sums, np.int64)
        first = last
    if first != docs:
        raise ValueError("a token file lacks blocks")


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, end_id: int = END_ID) -> list[tuple[str, int, int]]:
    """Write all documents in ascending id order; gives each file's path, documents and ids, in order (one entry a file)."""
    path = vocab_path or bpe.default_path()
    n_ids = bpe.library(path).get_vocab_size(with_added_tokens=True)
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    fs, place = filesystem(folder)
    fs.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        fs, place = filesystem(f"{folder}/{name}")
        with fs.open_output_stream(place) as out:
            w = Writer(out, n_ids)
            for b in pieces(batches, limit=PIECE_BYTES):
                ids, counts = token_ids(b.column("text"), path, end_id)
                key = b.column("doc_id")
                w.add(key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), counts, ids)
            n = w.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [n], "ids": [w.total]})

    done = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "part long, name string, docs long, ids long").collect()
    return [(f"{folder}/{r.name}", r.docs, r.ids) for r in sorted(done) if r.docs]


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, from the files alone."""
    start, rows = 0, []
    for k, (name, _, n) in enumerate(files):
        rows.append((k, name, start))
        start += n
    todo = spark.createDataFrame(rows, "k long, name string, start long")
    if rows:
        todo = todo.repartitionByRange(len(rows), F.col("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, place = filesystem(row["name"])
                at = row["start"]
                with fs.open_input_file(place) as f:
                    for doc_id, null, count, crc in read_file(f, f.size()):
                        before = at + np.cumsum(count) - count
                        at += int(count.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64(), mask=null.astype(bool)), pa.array(before), pa.array(count), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids to files in ``folder`` (by default a new one in the shared folder) and read them back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, folder or shared_path(spark, "tokens"), **options))
