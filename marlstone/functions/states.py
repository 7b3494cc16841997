"""Mergeable metric states: partial results that can be kept, merged over coarser groups, and only then finished.

A state is some columns of a grouped frame.  Which states may be merged depends on how they came about: sums and counts of rows
need disjoint populations, identities may overlap, balances take the latest and are never summed across time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exact
from marlstone.plans.errors import CompileError

#: Identities that a state of an exact distinct count holds at most.
MOST_IDENTITIES = 100_000


@dataclass(frozen=True)
class State:
    """``kind``: sum_count_average, weighted_average, exact_distinct or snapshot_balance; ``fields`` it reads; ``dimensions`` it may be merged over."""

    kind: str
    fields: tuple[str, ...]
    dimensions: frozenset[str]
    zero: str = "null"

    def __post_init__(self):
        wanted = {"sum_count_average": 1, "weighted_average": 2, "exact_distinct": 1, "snapshot_balance": 3}
        if self.kind not in wanted:
            raise CompileError("unsupported_metric_state", self.kind)
        if len(self.fields) != wanted[self.kind] or len(set(self.fields)) != len(self.fields) or not all(f.strip() for f in self.fields):
            raise CompileError("metric_state_identity", self.kind)

    def parts(self) -> dict[str, Column]:
        """The state's columns over rows."""
        f = [F.col(x) for x in self.fields]
        wide = lambda c: F.sum(c.cast(exact.WIDE))
        if self.kind == "sum_count_average":
            return {"s": wide(f[0]), "n": F.count(f[0])}
        if self.kind == "weighted_average":
            both = f[0].isNotNull() & f[1].isNotNull()
            ok = F.when(both & (f[1] < 0), F.raise_error(F.lit("a weight is negative")).cast(exact.WIDE)).when(both, f[1].cast(exact.WIDE))
            return {"s": F.sum(F.when(both, f[0].cast(exact.WIDE)) * ok), "n": F.sum(ok)}
        if self.kind == "exact_distinct":
            return {"s": F.collect_set(f[0])}
        return dict(zip(("high", "low"), exact.latest(*f)))

    def partial(self, rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*(c.alias(f"state_{k}") for k, c in self.parts().items()))

    def merge(self, states: DataFrame, by: list[str], disjoint: bool = False, across_time: bool = False) -> DataFrame:
        """States over the coarser groups ``by``; ``disjoint``: no row is in two of them, which sums need."""
        if not set(by) <= self.dimensions:
            raise CompileError("metric_state_dimension", ", ".join(sorted(set(by) - self.dimensions)))
        if self.kind in ("sum_count_average", "weighted_average"):
            if not disjoint:
                raise CompileError("metric_state_overlap", self.kind)
            made = {k: F.sum(f"state_{k}") for k in ("s", "n")}
        elif self.kind == "exact_distinct":
            made = {"s": F.array_distinct(F.flatten(F.collect_list("state_s")))}
        else:
            if across_time:
                raise CompileError("metric_state_time_additivity", self.kind)
            made = {k: F.max(f"state_{k}") for k in ("high", "low")}
        return states.groupBy(*by).agg(*(c.alias(f"state_{k}") for k, c in made.items()))

    def finish(self, states: DataFrame, name: str) -> DataFrame:
        """The metric's value in place of its state."""
        if self.kind in ("sum_count_average", "weighted_average"):
            value = exact.ratio(F.col("state_s"), F.col("state_n"), self.zero)
        elif self.kind == "exact_distinct":
            value = F.when(F.size("state_s") <= MOST_IDENTITIES, F.size("state_s").cast("bigint")).otherwise(F.raise_error(F.lit("too many identities")).cast("bigint"))
        else:
            value = exact.one_balance(F.col("state_high"), F.col("state_low"))
        return states.select(*(c for c in states.columns if not c.startswith("state_")), value.alias(name))
