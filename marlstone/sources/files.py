"""File sources: formats and compressions by name, strict types, failing instead of nulling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "tsv": "tsv", "json": "ndjson", "jsonl": "ndjson", "ndjson": "ndjson", "parquet": "parquet", "avro": "avro", "arrow": "arrow", "ipc": "arrow", "feather": "arrow"}
COMPRESSIONS = ("gz", "bz2", "zst", "xz")
#: Logical types of models, as Spark types.
LOGICAL = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
INFER_RECORDS = 1000


class SourceError(ValueError):
    """A source that can't be read as declared."""


@dataclass(frozen=True)
class FileSource:
    """A file or folder; ``format`` is needed for folders, ``schema`` gives columns their types before anything is read."""

    path: str
    format: str | None = None
    schema: T.StructType | None = None
    header: bool = True
    delimiter: str | None = None
    quote: str = '"'
    escape: str | None = None
    null_regex: str | None = None
    infer_records: int = INFER_RECORDS


def infer_format(path: str) -> tuple[str | None, str | None]:
    """Format and compression by a name's suffixes."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    compression = parts.pop() if len(parts) > 1 and parts[-1] in COMPRESSIONS else None
    return (FORMATS.get(parts[-1]) if len(parts) > 1 else None), compression


def schema_of_model(fields: dict[str, str], scales: dict[str, tuple[int, int]] | None = None) -> T.StructType:
    """Physical types of a model's logical ones; decimals must state precision and scale."""
    out = T.StructType()
    for name, kind in fields.items():
        if kind == "decimal":
            if name not in (scales or {}):
                raise SourceError(f"{name}: a decimal needs precision and scale")
            out.add(name, T.DecimalType(*scales[name]))
        elif kind in LOGICAL:
            out.add(name, LOGICAL[kind])
        else:
            raise SourceError(f"{name}: unknown type {kind}")
    return out


def read(spark: SparkSession, source: FileSource) -> DataFrame:
    """The source as a DataFrame; a value that doesn't fit its declared type fails the query that reads it."""
    fmt, compression = infer_format(source.path)
    fmt = FORMATS.get(source.format, source.format) if source.format else fmt
    if fmt is None:
        raise SourceError(f"{source.path}: a format is needed")
    if compression and fmt not in ("csv", "tsv", "ndjson"):
        raise SourceError(f"{fmt} files aren't compressed as a whole")
    for option in (source.delimiter, source.quote, source.escape):
        if option is not None and (len(option) != 1 or ord(option) > 127):
            raise SourceError("delimiter, quote and escape are one ASCII character each")
    if fmt in ("parquet", "arrow", "avro") and source.schema is not None:
        raise SourceError(f"{fmt} files carry their schema")
    if fmt == "parquet":
        return spark.read.parquet(source.path)
    if fmt == "arrow":
        return read_arrow(spark, source.path)
    if fmt == "avro":
        return read_avro(spark, source.path)
    if compression == "xz":
        return read_xz(spark, source, fmt)
    if fmt == "ndjson":
        if source.schema is not None:
            return spark.read.schema(source.schema).option("mode", "FAILFAST").json(source.path)
        # types from the first records, then a strict read of all
        sample = spark.read.text(source.path).limit(source.infer_records)
        inferred = spark.read.json(sample.rdd.map(lambda r: r.value)).schema
        return spark.read.schema(inferred).option("mode", "FAILFAST").json(source.path)
    options = {"header": source.header, "sep": source.delimiter or ("\t" if fmt == "tsv" else ","), "quote": source.quote, "escape": source.escape or source.quote, "mode": "FAILFAST"}
    schema = source.schema
    if schema is None:
        lines = spark.read.text(source.path).limit(source.infer_records + bool(source.header))
        schema = spark.read.options(**options, inferSchema=True).csv(lines.rdd.map(lambda r: r.value)).schema
    if source.null_regex is None:
        return spark.read.schema(schema).options(**options).csv(source.path)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(text).options(**options).csv(source.path)
    # ANSI casts: what doesn't fit fails
    return raw.select(*(F.when(~F.col(f"`{f.name}`").rlike(f"^(?:{source.null_regex})$"), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema))


def opened(p: str):
    """A file as executors read it, by the path that Spark lists."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
    return system.open_input_file(place)


def listed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The paths of a file or of a folder's files, and the first of them."""
    files = spark.read.format("binaryFile").load(path).select("path")
    first = files.first()
    if first is None:
        raise SourceError(f"{path}: no file")
    return files, first.path


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, one task a file, batch by batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files, first = listed(spark, path)
    with pa.ipc.open_file(opened(first)) as reader:
        schema = from_arrow_schema(reader.schema)

    def run(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with pa.ipc.open_file(opened(p)) as reader:
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    return files.mapInArrow(run, schema)


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro container files, one task a file, block by block."""
    from pyspark.sql.pandas.types import from_arrow_schema

    from marlstone.sources import avro

    files, first = listed(spark, path)
    with opened(first) as f:
        schema = avro.arrow_schema(f)

    def run(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with opened(p) as f:
                    yield from avro.batches(f, schema)

    return files.mapInArrow(run, from_arrow_schema(schema))


def read_xz(spark: SparkSession, source: FileSource, fmt: str) -> DataFrame:
    """Lines of xz files, which Spark doesn't unpack itself, parsed as strictly as others; a quoted value holds no line break."""
    import io
    import lzma

    import pyarrow as pa

    files, _ = listed(spark, source.path)
    skip = 1 if fmt != "ndjson" and source.header else 0

    def run(batches):
        for b in batches:
            for p in b.column("path").to_pylist():
                with opened(p) as f, lzma.open(f) as raw:
                    held = []
                    for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", newline="\n")):
                        held.append((n, line.rstrip("\r\n")))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], ["n", "value"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], ["n", "value"])

    lines = files.mapInArrow(run, "n long, value string").where(F.length("value") > 0)
    if fmt == "ndjson":
        schema = source.schema or spark.read.json(lines.limit(source.infer_records).rdd.map(lambda r: r.value)).schema
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    options = {"sep": source.delimiter or ("\t" if fmt == "tsv" else ","), "quote": source.quote, "escape": source.escape or source.quote, "mode": "FAILFAST"}
    if source.null_regex is not None:
        raise SourceError("null_regex goes with files that Spark unpacks")
    schema = source.schema or spark.read.options(**options, header=source.header, inferSchema=True).csv(lines.limit(source.infer_records + skip).rdd.map(lambda r: r.value)).schema
    return lines.where(F.col("n") >= skip).select(F.from_csv("value", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def normalise_result(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns brought to the declared types by strict casts; a null where the schema has none fails."""
    if df.columns != schema.fieldNames():
        raise SourceError(f"columns {df.columns}, declared {schema.fieldNames()}")
    cols = []
    for f in schema:
        c = F.col(f"`{f.name}`").cast(f.dataType)
        if not f.nullable:
            c = F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)
