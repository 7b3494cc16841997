"""Allocation of whole amounts over weighted targets, by largest remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.exact import WIDE, allocation_floor, allocation_remainder


def allocate(source: DataFrame, bridge: DataFrame, keys: list[tuple[str, str]], amount: str, expected_count: str, expected_weight: str, targets: list[str], weight: str) -> DataFrame:
    """Shares of every source row over its bridge rows: the targets and ``share``, one row per bridge row.

    Each share is the amount times the weight over all weights, cut toward zero; the units left go to the largest
    remainders, ties to the smaller target.  The query fails where a source key repeats, where number or sum of the weights differ from what the source
    expects, and where a target repeats or a weight is null or negative.

    The bridge is sorted by key and target, while its rows are narrow; the totals of a key and the join use that order.  What is sorted once
    more, by remainder, are the columns that the last step reads.
    """
    names, tags = [f"__k{i}" for i in range(len(keys))], [f"__t{i}" for i in range(len(targets))]
    per_source = Window.partitionBy(*names)
    left = source.select(*(F.col(a).alias(n) for n, (a, _) in zip(names, keys)), F.col(amount).alias("__amount"), F.col(expected_count).alias("__count"), F.col(expected_weight).alias("__weight"))
    left = left.withColumn("__rows", F.count(F.lit(1)).over(per_source))

    ours = [f"__b{i}" for i in range(len(keys))]
    right = bridge.select(*(F.col(b).alias(n) for n, (_, b) in zip(ours, keys)), *(F.col(t).alias(n) for n, t in zip(tags, targets)), F.col(weight).alias("__w"))
    # rows with a null key match nothing
    right = right.where(" and ".join(f"{n} is not null" for n in ours))
    per_key = Window.partitionBy(*ours)
    in_order = per_key.orderBy(*tags)
    again = F.row_number().over(in_order) > 1
    for t in tags:
        again = again & F.lag(t).over(in_order).eqNullSafe(F.col(t))
    right = right.withColumn("__again", again)
    right = right.withColumns({"__n": F.count(F.lit(1)).over(per_key), "__sum": F.sum(F.col("__w").cast(WIDE)).over(per_key), "__twice": F.max("__again").over(per_key), "__low": F.min(F.coalesce("__w", F.lit(-1))).over(per_key)}).drop("__again")

    both = left.join(right, [left[n] == right[b] for n, b in zip(names, ours)], "left")
    sound = (F.col("__rows") == 1) & (F.col("__n") == F.col("__count")) & (F.col("__sum") == F.col("__weight")) & ~F.col("__twice") & (F.col("__low") >= 0) & (F.col("__sum") > 0)
    both = both.withColumn("__amount", F.when(F.coalesce(sound, F.lit(False)), F.col("__amount")).otherwise(F.raise_error(F.lit("the allocation's members are not as declared")).cast("bigint")))
    rest = allocation_remainder(F.col("__amount"), F.col("__w"), F.col("__sum"))
    if isinstance(source.schema[expected_weight].dataType, T.IntegralType):
        rest = rest.cast("bigint")  # less than the sum of the weights, which is the expected one
    both = both.select(*names, *tags, "__amount", allocation_floor(F.col("__amount"), F.col("__w"), F.col("__sum")).alias("__floor"), rest.alias("__rest"))
    both = both.withColumn("__rank", F.row_number().over(per_source.orderBy(F.desc("__rest"), *tags)))
    both = both.withColumn("__left", F.col("__amount") - F.sum("__floor").over(per_source))
    unit = F.when(F.col("__rank") <= F.abs("__left"), F.signum(F.col("__left")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return both.select(*(F.col(t).alias(n) for t, n in zip(tags, targets)), (F.col("__floor") + unit).alias("share"))
