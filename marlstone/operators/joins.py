"""Joins that hold their authors' promises: a broken one fails the query instead of multiplying rows.

Every check is part of a value that the result uses, so it can't be pruned away.  Right sides are aggregated before they are
joined, by partial aggregation; which side is sent where is left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_condition(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_safe: bool) -> Column:
    out = None
    for a, b in keys:
        one = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = one if out is None else out & one
    return out


def related(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], absent: bool = False, null_safe: bool = False) -> DataFrame:
    """Left rows that have (or lack) a right row; multiplicity stays."""
    return left.join(right, key_condition(left, right, keys, null_safe), "left_anti" if absent else "left_semi")


def _must(ok: Column, value: Column, kind: str, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def lookup(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str, name: str, missing: str = "null", null_safe: bool = False) -> DataFrame:
    """Left rows with one value of their right row as ``name``; a right key that occurs twice fails the query, matched or not."""
    kind = right.schema[value].dataType.simpleString()
    names = [f"__k{i}" for i in range(len(keys))]
    grouped = right.groupBy(*(F.col(b).alias(n) for n, (_, b) in zip(names, keys))).agg(F.min(value).alias("__v"), F.count(F.lit(1)).alias("__n"))
    if not null_safe:
        # rows with a null key match nothing, so they promise nothing
        grouped = grouped.where(" and ".join(f"{n} is not null" for n in names))
    single = grouped.select(*names, _must(F.col("__n") <= 1, F.col("__v"), kind, "a key is not unique").alias("__v"))
    on = key_condition(left, single, [(a, n) for n, (a, _) in zip(names, keys)], null_safe)
    return left.join(single, on, "left" if missing == "null" else "inner").select(*left.columns, F.col("__v").alias(name))


def as_of(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], time: str, valid_from: str, valid_to: str, values: dict[str, str], missing: str = "null", exactly_one: bool = False) -> DataFrame:
    """Left rows with the values of the right row whose half-open interval holds ``time``.

    Two matches fail the query; none gives nulls, or takes the row out (``missing="exclude"``), or fails (``exactly_one``).
    The right side is cut at all bounds of a key's intervals first: stretches that one interval covers carry its values, and those that
    several cover say so.  Stretches don't overlap, so a left row meets one at most, and needs no count.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = right.select(*(F.col(b).alias(n) for n, (_, b) in zip(names, keys)), F.col(valid_from).alias("__from"), F.col(valid_to).alias("__to"), *(F.col(v).alias(f"__v_{n}") for n, v in values.items()))
    rows = rows.where(" and ".join(["__from < __to", *(f"{n} is not null" for n in names)]))
    state = F.struct("__to", *(f"__v_{n}" for n in values))
    begun = rows.select(*names, F.col("__from").alias("__t"), F.lit(1).alias("__d"), state.alias("__s"))
    ended = rows.select(*names, F.col("__to").alias("__t"), F.lit(-1).alias("__d"), F.when(F.lit(False), state).alias("__s"))
    bounds = begun.unionByName(ended).groupBy(*names, "__t").agg(F.sum("__d").alias("__d"), F.max("__s").alias("__s"))
    order = Window.partitionBy(*names).orderBy("__t")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # where one interval is open, it is the one of those begun that ends last
    cut = bounds.select(*names, F.col("__t").alias("__since"), F.lead("__t").over(order).alias("__until"), F.sum("__d").over(so_far).alias("__open"), F.max("__s").over(so_far).alias("__s")).where("__open > 0")
    on = (F.col(time) >= F.col("__since")) & (F.col(time) < F.col("__until"))
    for n, (a, _) in zip(names, keys):
        on = on & (left[a] == F.col(n))
    joined = left.join(cut, on, "inner" if missing == "exclude" and not exactly_one else "left")
    ok = F.coalesce(F.col("__open") == 1, F.lit(not exactly_one))
    message = "a row has not exactly one valid match" if exactly_one else "intervals overlap"
    return joined.select(*left.columns, *(_must(ok, F.col("__s")[f"__v_{n}"], right.schema[v].dataType.simpleString(), message).alias(n) for n, v in values.items()))


def exactly_one(left: DataFrame, right: DataFrame, key: tuple[Column, str], values: dict[str, str]) -> DataFrame:
    """Left rows with values of the one right row of their key; none or several fail the query.  A null key gives nulls."""
    left_key, right_key = key
    kinds = {n: right.schema[v].dataType.simpleString() for n, v in values.items()}
    single = right.groupBy(F.col(right_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"), *(F.min(v).alias(f"__v_{n}") for n, v in values.items()))
    joined = left.withColumn("__lk", left_key).join(single, F.col("__lk") == F.col("__k"), "left")
    ok = F.col("__lk").isNull() | (F.col("__n") == 1)
    return joined.select(*left.columns, *(_must(F.coalesce(ok, F.lit(False)), F.col(f"__v_{n}"), kinds[n], "a date has not exactly one calendar row").alias(n) for n in values))


def compose(left: DataFrame, right: DataFrame, keys: list[tuple[str, str, str]], outputs: list[tuple[str, str, str, str]], domain: str, null_safe: bool) -> DataFrame:
    """Two aggregated frames side by side.

    ``keys``: (left, right, name); ``outputs``: (side, column, name, missing), where a missing group gives null or zero - which a
    marker tells from a null measure.  Without keys both have one row.
    """
    a = left.select(*(F.col(k).alias(f"__a{i}") for i, (k, _, _) in enumerate(keys)), F.lit(True).alias("__left"), *(F.col(c).alias(f"__l_{n}") for s, c, n, _ in outputs if s == "left"))
    b = right.select(*(F.col(k).alias(f"__b{i}") for i, (_, k, _) in enumerate(keys)), F.lit(True).alias("__right"), *(F.col(c).alias(f"__r_{n}") for s, c, n, _ in outputs if s == "right"))
    how = {"union": "full", "intersection": "inner", "left": "left", "right": "right"}[domain]
    # frames without keys are global aggregates, of one row each
    both = a.join(b, key_condition(a, b, [(f"__a{i}", f"__b{i}") for i in range(len(keys))], null_safe), how) if keys else a.crossJoin(b)
    cols = [F.coalesce(f"__a{i}", f"__b{i}").alias(name) for i, (_, _, name) in enumerate(keys)]
    for side, _, name, missing in outputs:
        c = F.col(f"__{side[0]}_{name}")
        if missing == "zero":
            c = F.when(F.col(f"__{side}").isNull(), F.lit(0).cast(both.schema[f"__{side[0]}_{name}"].dataType)).otherwise(c)
        cols.append(c.alias(name))
    return both.select(*cols)


def _membership(left: DataFrame, right: DataFrame, wanted: Column) -> DataFrame:
    """The different rows of both frames that are ``wanted`` by ``__left`` and ``__right``: whether that frame has them.

    Each task first reduces what it reads to its different rows, so that equal ones are neither brought together nor sorted, however many there are.
    """
    names = [f"__c{i}" for i in range(len(left.columns))]
    both = left.toDF(*names).withColumns({"__l": F.lit(True), "__r": F.lit(False)}).union(right.toDF(*names).withColumns({"__l": F.lit(False), "__r": F.lit(True)}))
    found = both.groupBy(*names).agg(F.max("__l").alias("__left"), F.max("__r").alias("__right"))
    return found.where(wanted).select(*names).toDF(*left.columns)


def set_operation(left: DataFrame, right: DataFrame, operator: str, duplicates: str) -> DataFrame:
    """UNION, INTERSECT or EXCEPT, ALL or DISTINCT, of frames with the same columns in order; nulls are equal."""
    return {
        ("union", "all"): lambda: left.union(right),
        ("union", "distinct"): lambda: left.union(right).distinct(),
        ("intersect", "all"): lambda: left.intersectAll(right),
        ("intersect", "distinct"): lambda: _membership(left, right, F.col("__left") & F.col("__right")),
        ("except", "all"): lambda: left.exceptAll(right),
        ("except", "distinct"): lambda: _membership(left, right, F.col("__left") & ~F.col("__right")),
    }[operator, duplicates]()
