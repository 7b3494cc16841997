"""Avro object container files, read block by block in a task a file."""

from __future__ import annotations

import bz2
import datetime as dt
import decimal
import io
import json
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa

MAGIC = b"Obj\x01"
ROWS = 4096
EPOCH, DAY_ONE = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.date(1970, 1, 1)


class AvroError(ValueError):
    """A file that isn't Avro, or holds what isn't read here."""


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


#: Codecs by the format's names for them (fixed values).
CODECS: dict[str, Callable[[bytes], bytes]] = {"null": bytes, "deflate": lambda d: zlib.decompress(d, -15), "bzip2": bz2.decompress, "xz": lzma.decompress, "zstandard": _zstd}


def read_long(f) -> int:
    """A zigzag number of variable length."""
    n = shift = 0
    while True:
        byte = f.read(1)
        if not byte:
            raise EOFError
        n |= (byte[0] & 0x7F) << shift
        if byte[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def read_bytes(f) -> bytes:
    return f.read(read_long(f))


def header(f) -> tuple[dict, str, bytes]:
    """Schema, codec and the marker between blocks."""
    if f.read(4) != MAGIC:
        raise AvroError("not an Avro file")
    meta = {}
    while n := read_long(f):
        if n < 0:
            read_long(f)
        for _ in range(abs(n)):
            key = read_bytes(f).decode()
            meta[key] = read_bytes(f)
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def reader(schema, names: dict) -> tuple[Callable, pa.DataType, bool]:
    """A function that reads a value, the value's Arrow type, and whether it may be null."""
    if isinstance(schema, list):
        options = [reader(s, names) for s in schema]
        real = [o for s, o in zip(schema, options) if s != "null"]
        if len(real) != 1:
            raise AvroError("a union of null and one type is read")
        return (lambda f: options[read_long(f)][0](f)), real[0][1], len(real) < len(schema)
    kind = schema["type"] if isinstance(schema, dict) else schema
    logical = schema.get("logicalType") if isinstance(schema, dict) else None
    if kind in names:
        return names[kind]
    if isinstance(kind, (dict, list)):
        return reader(kind, names)
    if kind == "null":
        return (lambda f: None), pa.null(), True
    if kind == "boolean":
        return (lambda f: f.read(1) == b"\x01"), pa.bool_(), False
    if kind == "int" and logical == "date":
        return (lambda f: DAY_ONE + dt.timedelta(days=read_long(f))), pa.date32(), False
    if kind == "long" and logical in ("timestamp-millis", "timestamp-micros"):
        unit = {"timestamp-millis": 1000, "timestamp-micros": 1}[logical]
        return (lambda f: EPOCH + dt.timedelta(microseconds=read_long(f) * unit)), pa.timestamp("us", "UTC"), False
    if kind in ("int", "long"):
        return read_long, pa.int32() if kind == "int" else pa.int64(), False
    if kind in ("float", "double"):
        code, size, made = ("<f", 4, pa.float32()) if kind == "float" else ("<d", 8, pa.float64())
        return (lambda f: struct.unpack(code, f.read(size))[0]), made, False
    if kind in ("bytes", "fixed"):
        take = read_bytes if kind == "bytes" else lambda f, n=schema["size"]: f.read(n)
        out = (take, pa.binary(), False)
        if logical == "decimal":
            precision, scale = schema["precision"], schema.get("scale", 0)
            wide = decimal.Context(prec=80)
            out = (lambda f: decimal.Decimal(int.from_bytes(take(f), "big", signed=True)).scaleb(-scale, wide)), pa.decimal128(precision, scale), False
    elif kind == "string":
        out = (lambda f: read_bytes(f).decode()), pa.string(), False
    elif kind == "enum":
        symbols = schema["symbols"]
        out = (lambda f: symbols[read_long(f)]), pa.string(), False
    elif kind == "array":
        item, made, null = reader(schema["items"], names)
        out = (lambda f: list(_blocks(f, item))), pa.list_(pa.field("element", made, null)), False
    elif kind == "map":
        value, made, null = reader(schema["values"], names)
        out = (lambda f: list(_blocks(f, lambda g: (read_bytes(g).decode(), value(g))))), pa.map_(pa.string(), pa.field("value", made, null)), False
    elif kind == "record":
        fields = [(f["name"], *reader(f["type"], names)) for f in schema["fields"]]
        out = (lambda f: {name: read(f) for name, read, *_ in fields}), pa.struct([pa.field(name, made, null) for name, _, made, null in fields]), False
    else:
        raise AvroError(f"{kind} is not read")
    if isinstance(schema, dict) and "name" in schema:
        names[schema["name"]] = out
    return out


def _blocks(f, item: Callable) -> Iterator:
    while n := read_long(f):
        if n < 0:
            read_long(f)
        for _ in range(abs(n)):
            yield item(f)


def arrow_schema(f) -> pa.Schema:
    """The columns of a file whose top is a record."""
    schema, _, _ = header(f)
    _, made, _ = reader(schema, {})
    if not pa.types.is_struct(made):
        raise AvroError("rows are records")
    return pa.schema(list(made))


def batches(f, expected: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All rows of a file; one of another schema fails."""
    schema, codec, marker = header(f)
    read, made, _ = reader(schema, {})
    if not pa.types.is_struct(made) or pa.schema(list(made)) != expected:
        raise AvroError("files of one source have one schema")
    if codec not in CODECS:
        raise AvroError(f"codec {codec} is not read")
    held = []
    while True:
        try:
            n = read_long(f)
        except EOFError:
            break
        block = io.BytesIO(CODECS[codec](read_bytes(f)))
        if f.read(16) != marker:
            raise AvroError("a block is broken")
        for _ in range(n):
            held.append(read(block))
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, expected)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, expected)
