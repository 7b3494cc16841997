"""Checks that two engines answer the same queries alike, for tests of connectors over fixture data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marlstone.plans.errors import CompileError
from marlstone.session import Engine, plan_facts


def check_equivalence(actual: Engine, expected: Engine, queries: list[str]) -> None:
    """Same columns and types, and the same rows as often; in the same order, where a query sorts its result."""
    for sql in queries:
        a, b = actual.sql(sql), expected.sql(sql)
        if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
            raise CompileError("conformance_schema", sql)
        if not (same_in_order(a, b) if sorts(actual, sql) else same_rows(a, expected_in(a, b))):
            raise CompileError("conformance_rows", sql)


def sorts(engine: Engine, sql: str) -> bool:
    top = engine.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while top.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit", "Offset", "UnresolvedWith"):
        top = top.children().head()
    plan_facts(engine.spark, sql)
    return top.getClass().getSimpleName() == "Sort"


def expected_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` in the session of ``a``."""
    session = a.sparkSession
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, b._jdf.logicalPlan()), session)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def same_in_order(a: DataFrame, b: DataFrame) -> bool:
    """Row by row, partition after partition, without holding either result."""
    end = object()
    x, y = a.toLocalIterator(), b.toLocalIterator()
    while True:
        p, q = next(x, end), next(y, end)
        if p is end or q is end:
            return p is q
        if p != q:
            return False
