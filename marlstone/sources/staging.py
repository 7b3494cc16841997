"""Inputs that are read more than once: kept in memory and on disk, and refused beyond a number of rows."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from marlstone.sources.generations import WriteError


@contextmanager
def staged(df: DataFrame, most_rows: int):
    """The rows of ``df``, computed once while the block runs."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if kept.count() > most_rows:
            raise WriteError(f"more than {most_rows} rows")
        yield kept
    finally:
        kept.unpersist()
