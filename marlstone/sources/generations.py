"""Versioned tables: every change writes new Parquet files and publishes a numbered manifest of all files that count.

Readers take the files of the highest manifest, so they see one whole state.  A manifest's name is its number, and it is created only if
there is none of that number yet, as one step: of two writers that start from the same state, one publishes and the other is told
that it lost.  Inserts add files; updates, deletes and merges write anew those files alone that hold a row to change.  Rows are counted while
they are written.  Files that no manifest names any longer go by ``vacuum``.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass
from enum import Enum
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Outcome(Enum):
    REJECTED = "rejected"
    ABORTED = "aborted"
    COMMITTED = "committed"
    UNKNOWN = "outcome_unknown"


@dataclass(frozen=True)
class Receipt:
    outcome: Outcome
    rows: int
    generation: str | None = None
    detail: str = ""


class WriteError(ValueError):
    """A write that is refused before anything changes."""


class Store:
    """Small files of a folder through Hadoop's file systems, as the executors see them."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self.fs = self.path(".").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.local = self.fs.getUri().getScheme() == "file"
        self.io, self.codec = jvm.org.apache.commons.io.IOUtils, jvm.java.nio.charset.StandardCharsets.UTF_8

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.io.toString(stream, self.codec)
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Make a file as one step, unless it is there already; tells whether it was made."""
        where = self.path(name)
        if self.local:  # a link appears whole, or fails if its name is taken
            target = unquote(where.toUri().getPath())
            os.makedirs(os.path.dirname(target), exist_ok=True)
            draft = f"{target}.{uuid.uuid4().hex}.draft"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            stream = self.fs.create(where, False)
        except Exception:  # noqa: BLE001 - what it is depends on the store; it failed for a reason other than the name if that is free
            if self.fs.exists(where):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def files(self, folder: str) -> list[str]:
        return [n for n in self.names(folder) if n.endswith(".parquet")]

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Generations:
    """A table under ``path``; ``key`` columns, if any, are unique and not null in every generation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark, self.path)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.store.names("manifests") if re.fullmatch(r"\d{12}\.json", n)]

    def manifest(self, number: int | None = None) -> dict:
        if number is None:
            numbers = self.numbers()
            if not numbers:
                raise WriteError("there is no such table")
            number = numbers[-1]
        return json.loads(self.store.read(f"manifests/{number:012d}.json")) | {"generation": number}

    def exists(self) -> bool:
        return bool(self.numbers())

    def create(self, schema: T.StructType, key: tuple[str, ...] = ()) -> Receipt:
        if self.exists():
            raise WriteError("the table exists")
        if set(key) - set(schema.fieldNames()):
            raise WriteError("a key column is missing")
        return self.publish([], schema, 0, None, list(key))

    def read(self, generation: int | None = None) -> DataFrame:
        return self.of(m := self.manifest(generation), m["files"])

    def of(self, m: dict, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def age(self) -> float:
        return time.time() - self.manifest()["at"]

    def publish(self, files: list[str], schema: T.StructType, rows: int, expected: int | None, key: list[str]) -> Receipt:
        """Make ``files`` the next generation after ``expected`` (``None``: the first), if no other has come first."""
        number = 0 if expected is None else expected + 1
        m = {"files": files, "schema": schema.jsonValue(), "at": time.time(), "key": key}
        try:
            made = self.store.create(f"manifests/{number:012d}.json", json.dumps(m))
        except Exception as e:  # noqa: BLE001 - whether the store took the file can't be told from here
            return Receipt(Outcome.UNKNOWN, 0, None, str(e)[:200])
        return Receipt(Outcome.COMMITTED, rows, str(number)) if made else Receipt(Outcome.ABORTED, 0, None, "another write came first")

    def written(self, df: DataFrame, counted: Column | None = None) -> tuple[list[str], int]:
        """Write rows to new files; gives these, and how many rows ``counted`` holds for."""
        folder, seen = f"data-{uuid.uuid4().hex}", Observation()
        flagged = df if counted is None else df.withColumn("__counted", counted)
        flagged = flagged.observe(seen, F.coalesce(F.sum(F.lit(1) if counted is None else F.col("__counted").cast("bigint")), F.lit(0)).alias("n"))
        flagged.select(*(c for c in flagged.columns if c != "__counted")).write.parquet(f"{self.path}/{folder}")
        return [f"{folder}/{f}" for f in self.store.files(folder)], seen.get["n"]

    def replace(self, df: DataFrame) -> Receipt:
        """Make ``df`` the whole table, whatever it held."""
        old = self.manifest() if self.exists() else None
        files, rows = self.written(df)
        return self.publish(files, df.schema, rows, old["generation"] if old else None, old["key"] if old else [])

    def vacuum(self, keep: int = 2, seconds: float = 3600.0) -> int:
        """Delete all but the last ``keep`` manifests, and files that none of these names and that are ``seconds`` old; gives the folders deleted."""
        numbers, gone = self.numbers(), 0
        named = {f.split("/")[0] for n in numbers[-keep:] for f in self.manifest(n)["files"]}
        for n in numbers[:-keep]:
            self.store.drop(f"manifests/{n:012d}.json")
        for s in self.store.fs.listStatus(self.store.path(".")):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in named and s.getModificationTime() <= (time.time() - seconds) * 1000:
                self.store.drop(name)
                gone += 1
        return gone

    # -- mutations -------------------------------------------------------------------------------------------

    def _touched(self, m: dict, hits: DataFrame) -> tuple[list[str], list[str]]:
        """The table's files that hold a row of ``hits`` (rows as they are read, with ``__file``), and the others."""
        found = {unquote("/".join(r[0].split("/")[-2:])) for r in hits.select("__file").distinct().collect()}  # file names, no rows
        return [f for f in m["files"] if f in found], [f for f in m["files"] if f not in found]

    def _filed(self, m: dict) -> DataFrame:
        return self.of(m, m["files"]).withColumn("__file", F.input_file_name())

    def insert(self, rows: DataFrame, columns: list[str]) -> Receipt:
        m = self.manifest()
        schema = T.StructType.fromJson(m["schema"])
        if len(columns) != len(rows.columns) or set(columns) - set(schema.fieldNames()) or len(set(columns)) != len(columns):
            raise WriteError("columns don't match the source")
        named = rows.toDF(*columns)
        new = named.select(*((F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        self._check_key(new, m["key"])
        if m["key"] and m["files"] and not self.read(m["generation"]).join(new.select(*m["key"]), m["key"], "left_semi").isEmpty():
            raise WriteError("a key is there already")
        files, n = self.written(new)
        return self.publish([*m["files"], *files], schema, n, m["generation"], m["key"])

    def update(self, assignments: dict[str, str], where: str = "true") -> Receipt:
        m = self.manifest()
        cur = self._filed(m)
        if set(assignments) - set(cur.columns) or set(assignments) & set(m["key"]):
            raise WriteError("only columns that are no key can be set")
        for e in [*assignments.values(), where]:
            if re.search(r"\b(select|over)\b", e, re.I):
                raise WriteError("expressions read the row alone")
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched, others = self._touched(m, cur.where(hit))
        if not touched:
            return Receipt(Outcome.COMMITTED, 0, str(m["generation"]))
        part = self.of(m, touched).withColumn("__hit", hit)
        out = part.select(F.col("__hit").alias("__counted"), *((F.when(F.col("__hit"), F.expr(assignments[f.name])).otherwise(F.col(f.name)).cast(f.dataType) if f.name in assignments else F.col(f.name)).alias(f.name) for f in T.StructType.fromJson(m["schema"])))
        files, n = self.written(out, F.col("__counted"))
        return self.publish([*others, *files], T.StructType.fromJson(m["schema"]), n, m["generation"], m["key"])

    def delete(self, where: str) -> Receipt:
        m = self.manifest()
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched, others = self._touched(m, self._filed(m).where(hit))
        if not touched:
            return Receipt(Outcome.COMMITTED, 0, str(m["generation"]))
        part, seen = self.of(m, touched), Observation()
        marked = part.withColumn("__hit", hit).observe(seen, F.coalesce(F.sum(F.col("__hit").cast("bigint")), F.lit(0)).alias("n"))
        files, _ = self.written(marked.where(~F.col("__hit")).drop("__hit"))
        return self.publish([*others, *files], T.StructType.fromJson(m["schema"]), seen.get["n"], m["generation"], m["key"])

    def merge(self, source: DataFrame, update: list[str] | None = None, insert: bool = True) -> Receipt:
        """Rows of the source by the table's whole key: matches get the ``update`` columns (by default all others) if any differs, others are inserted unless ``insert`` is false.

        Source keys must be unique and not null.  Rows = changed + inserted, so a second run changes none, and publishes nothing.
        """
        m = self.manifest()
        schema, key = T.StructType.fromJson(m["schema"]), m["key"]
        if not key or set(key) - set(source.columns):
            raise WriteError("a merge needs the table's whole key")
        update = [c for c in source.columns if c not in key] if update is None else update
        if set(update) & set(key) or set(update) - set(source.columns) or set(source.columns) - set(schema.fieldNames()):
            raise WriteError("columns don't match")
        self._check_key(source, key)
        # any match of a source row lies in a touched file, so a source row without a match there has none
        touched, others = self._touched(m, self._filed(m).join(source.select(*key), key, "left_semi"))
        s = source.select(*(F.col(c).alias(f"__s_{c}") for c in source.columns), F.lit(True).alias("__new"))
        t = self.of(m, touched).withColumn("__old", F.lit(True))
        both = t.join(s, [t[k] == s[f"__s_{k}"] for k in key], "full" if insert else "left")
        matched = F.col("__old").isNotNull() & F.col("__new").isNotNull()
        differs = F.lit(False)
        for c in update:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"__s_{c}").cast(schema[c].dataType))
        cols = []
        for f in schema:
            value = F.col(f.name)
            if f.name in source.columns:
                mine = F.col(f"__s_{f.name}").cast(f.dataType)
                value = F.when(F.col("__old").isNull(), mine)
                value = value.when(matched & differs, mine).otherwise(F.col(f.name)) if f.name in update else value.otherwise(F.col(f.name))
            cols.append(value.alias(f.name))
        changed = F.col("__old").isNull() | (matched & differs)
        files, n = self.written(both.select(*cols, changed.alias("__counted")), F.col("__counted"))
        if not n:
            for folder in {f.split("/")[0] for f in files}:
                self.store.drop(folder)
            return Receipt(Outcome.COMMITTED, 0, str(m["generation"]))
        return self.publish([*others, *files], schema, n, m["generation"], key)

    def _check_key(self, df: DataFrame, key: list[str]) -> None:
        if not key:
            return
        bad = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in [*key, *key])).cast("boolean"))
        if not bad.isEmpty():
            raise WriteError("a key is null or repeats")


class Materialized:
    """A relation's result kept as a generation and read again while it is fresh."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def get(self, name: str, identity: str, build, max_age: float, max_rows: int | None = None) -> DataFrame:
        """The kept rows for ``identity`` (say an engine's, which changes when a relation below is written), or new ones from ``build()``; over ``max_rows`` nothing is published."""
        table = Generations(self.spark, f"{self.folder}/{name}-{uuid.uuid5(uuid.NAMESPACE_OID, identity).hex}")
        if table.exists() and table.age() <= max_age:
            return table.read()
        df = build()
        if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
            raise WriteError(f"{name} has more than {max_rows} rows")
        table.replace(df)
        return table.read()
