"""Results as they come: rows of a query under a deadline, and whether all of them came."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marlstone.session import batches


@dataclass
class Report:
    """How far a reader got; ``complete`` is true only after the last row."""

    rows: int = 0
    complete: bool = False


def stream(df: DataFrame, size: int = 1024, seconds: float = 30.0) -> tuple[Iterator[list], Report]:
    """Batches of rows and a report that is kept up to date while they are read."""
    report = Report()

    def run() -> Iterator[list]:
        held = []
        for row in batches(df, seconds):
            held.append(row)
            report.rows += 1
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held
        report.complete = True

    return run(), report
