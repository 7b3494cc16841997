"""Connectors: named factories that check their options, connect, and give tables as DataFrames on first use."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources.files import FileSource, SourceError, normalise_result, read


class Connector(Protocol):
    def validate(self, options: Mapping[str, str]) -> None: ...

    def table(self, spark: SparkSession, options: Mapping[str, str], name: str) -> DataFrame: ...


class Files:
    """Files under a ``root`` folder; a table is a name in it."""

    def validate(self, options: Mapping[str, str]) -> None:
        if set(options) - {"root", "format"} or "root" not in options:
            raise SourceError("options: root, format")

    def table(self, spark: SparkSession, options: Mapping[str, str], name: str) -> DataFrame:
        if "/" in name or "://" in name:
            raise SourceError(f"{name!r} is no table name")
        return read(spark, FileSource(f"{options['root']}/{name}", options.get("format")))


@dataclass(frozen=True)
class Jdbc:
    """A database by JDBC: columns and filters are pushed down by Spark's own source, and with the options ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions`` it is read in parts.

    Text predicates stay local unless ``push_text`` is set, since collations differ: text columns are read through a function that no
    source takes, while all other filters go to the database.
    """

    prefix: str
    driver: str
    push_text: bool = False

    def validate(self, options: Mapping[str, str]) -> None:
        if not str(options.get("url", "")).startswith(self.prefix):
            raise SourceError(f"url must start with {self.prefix}")

    def table(self, spark: SparkSession, options: Mapping[str, str], name: str) -> DataFrame:
        extra = {k: v for k, v in options.items() if k not in ("url", "dbtable", "driver")}
        return self.guarded(spark.read.format("jdbc").options(**extra, url=options["url"], dbtable=name, driver=self.driver).load())

    def guarded(self, df: DataFrame) -> DataFrame:
        if self.push_text:
            return df
        return df.select(*(F.substring(f.name, 1, 1 << 30).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


class Registry:
    """Connectors by kind, and tables that are opened when first read (the latest ``keep`` stay open)."""

    def __init__(self, keep: int = 256):
        self.kinds: dict[str, Connector] = {"files": Files(), "postgresql": Jdbc("jdbc:postgresql:", "org.postgresql.Driver"), "clickhouse": Jdbc("jdbc:clickhouse:", "com.clickhouse.jdbc.ClickHouseDriver")}
        self.connections: dict[str, tuple[str, dict]] = {}
        self.keep, self._open, self._lock = keep, OrderedDict(), threading.Lock()

    def register(self, kind: str, connector: Connector) -> None:
        if kind in self.kinds:
            raise SourceError(f"{kind} is registered already")
        self.kinds[kind] = connector

    def connect(self, name: str, kind: str, options: Mapping[str, str]) -> None:
        if kind not in self.kinds:
            raise SourceError(f"unknown connector {kind}")
        self.kinds[kind].validate(options)
        self.connections[name] = (kind, dict(options))

    def deferred(self, spark: SparkSession, connection: str, table: str, schema: T.StructType | None = None) -> Callable[[], DataFrame]:
        """A function that opens the table when it is first called, once; with ``schema``, results are held to it."""
        if connection not in self.connections:
            raise SourceError(f"unknown connection {connection}")
        key = (connection, table)

        def get() -> DataFrame:
            with self._lock:
                if key not in self._open:
                    kind, options = self.connections[connection]
                    df = self.kinds[kind].table(spark, options, table)
                    self._open[key] = normalise_result(df, schema) if schema else df
                    while len(self._open) > self.keep:
                        self._open.popitem(last=False)
                self._open.move_to_end(key)
                return self._open[key]

        return get
