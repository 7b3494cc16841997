"""Exact arithmetic as plain column expressions: nothing here leaves the JVM.

All results are exact or the query fails (ANSI mode).  Quotients have 18 decimals, cut toward zero unless said
otherwise; ``zero`` says what a zero denominator gives, ``"null"`` or ``"zero"``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
RESULT = "decimal(38,18)"
_NINE = 10**9


def guard(ok: Column, value: Column, message: str) -> Column:
    """``value``, if ``ok`` holds; else the query fails.  The check is part of the value, so it can't be pruned while the value is used."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def checked_sum(x: Column, distinct: bool = False) -> Column:
    """Sum of integers that overflows at the end only: transient overflow is no error."""
    x = x.cast(WIDE)
    return (F.sum_distinct(x) if distinct else F.sum(x)).cast("bigint")


def decimal_sum(x: Column, precision: int, scale: int, distinct: bool = False) -> Column:
    """Sum of decimals in ``decimal(min(precision + 10, 38), scale)``."""
    total = F.sum_distinct(x) if distinct else F.sum(x)
    return total.cast(f"decimal({min(precision + 10, 38)},{scale})")


def _whole(n: Column, d: Column) -> Column:
    """The whole quotient of non-negative wide decimals; ``n - n % d`` divides without rest, so ``/`` can't round."""
    return ((n - n % d) / d).cast("decimal(38,0)")


def quotient(n: Column, d: Column, half_even: bool = False) -> Column:
    """``n / d`` for whole numbers, with 18 decimals, by three exact divisions of the digits."""
    num, den = n.cast(WIDE), F.nullif(d.cast(WIDE), F.lit(0).cast(WIDE))
    negative = (num < 0) != (den < 0)
    a, b = F.abs(num), F.abs(den)
    q0, r0 = _whole(a, b), a % b
    s1 = (r0.cast("decimal(28,0)") * F.lit(_NINE)).cast(WIDE)
    q1, r1 = _whole(s1, b), s1 % b
    s2 = (r1.cast("decimal(28,0)") * F.lit(_NINE)).cast(WIDE)
    q2, r2 = _whole(s2, b), s2 % b
    if half_even:
        twice = (r2.cast("decimal(28,0)") * F.lit(2)).cast(WIDE)
        up = (twice > b) | ((twice == b) & (q2 % 2 == 1))
        q2 = F.when(up, q2 + 1).otherwise(q2)
        carry = q2 == _NINE
        q2, q1 = F.when(carry, F.lit(0)).otherwise(q2).cast(WIDE), F.when(carry, q1 + 1).otherwise(q1).cast(WIDE)
        carry = q1 == _NINE
        q1, q0 = F.when(carry, F.lit(0)).otherwise(q1).cast(WIDE), F.when(carry, q0 + 1).otherwise(q0).cast(WIDE)
    digits = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), q0.cast("string"), F.lit("."), F.lpad(q1.cast("string"), 9, "0"), F.lpad(q2.cast("string"), 9, "0"))
    return digits.cast(RESULT)


def ratio(n: Column, d: Column, zero: str = "null") -> Column:
    """Exact ratio of whole numbers; nulls propagate."""
    q = quotient(n, d)
    if zero == "zero":
        return F.when(n.isNotNull() & (d == 0), F.lit(0).cast(RESULT)).otherwise(q)
    return q


def exact_mean(x: Column) -> Column:
    """Mean of integers; null without values."""
    return quotient(F.sum(x.cast(WIDE)), F.count(x))


def weighted_mean(value: Column, weight: Column, zero: str = "null") -> Column:
    """Sum of value times weight over sum of weights; pairs with a null don't count, a negative weight fails, no weight gives null or zero."""
    both = value.isNotNull() & weight.isNotNull()
    sound = F.when(both, F.when(weight >= 0, weight).otherwise(F.raise_error(F.lit("negative weight")).cast("bigint"))).cast(WIDE)
    total = F.coalesce(F.sum(sound), F.lit(0).cast(WIDE))
    product = F.sum(F.when(both, (value.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).cast(WIDE)))
    mean = quotient(product, total)
    return F.coalesce(mean, F.lit(0).cast(RESULT)) if zero == "zero" else mean


def exact_distinct(x: Column, limit: int | None = None) -> Column:
    """Number of distinct values, however many; if there is a ``limit``, more in a group fail."""
    n = F.count_distinct(x)
    if limit is None:
        return n
    return F.when(n <= limit, n).otherwise(F.raise_error(F.lit("too many distinct values")).cast("bigint"))


def latest(value: Column, time: Column, tie: Column) -> tuple[Column, Column]:
    """Aggregates that see the latest (time, tie) from both ends: one prefers values and large ones, the other nulls and small ones; a null time or tie fails."""
    sound = F.when(time.isNotNull() & tie.isNotNull(), time).otherwise(F.raise_error(F.lit("null snapshot time")).cast("timestamp"))
    high = F.max(F.struct(sound.alias("t"), tie.alias("k"), value.isNotNull().alias("p"), value.alias("v")))
    return high, F.max(F.struct(sound.alias("t"), tie.alias("k"), value.isNull().alias("p"), (-value.cast("decimal(20,0)")).alias("v")))


def one_balance(high: Column, low: Column) -> Column:
    """The value that both ends of ``latest`` agree on; differing ones fail."""
    return F.when(high["v"].eqNullSafe((-low["v"]).cast("bigint")), high["v"]).otherwise(F.raise_error(F.lit("conflicting snapshot values")).cast("bigint"))


def snapshot_balance(value: Column, time: Column, tie: Column) -> Column:
    """The value at the greatest (time, tie)."""
    return one_balance(*latest(value, time, tie))


def scale(x: Column, numerator: int, denominator: int, half_even: bool = False) -> Column:
    """A whole number times an exact factor, with 18 decimals."""
    if numerator <= 0 or denominator <= 0:
        raise ValueError("a conversion factor is positive")
    return quotient((x.cast("decimal(19,0)") * F.lit(numerator).cast("decimal(19,0)")).cast(WIDE), F.lit(denominator), half_even)


def scale_by(x: Column, numerator: Column, denominator: Column) -> Column:
    """``scale`` with factors from columns; a factor that isn't positive fails."""
    ok = (numerator > 0) & (denominator > 0)
    top = F.when(ok, numerator).otherwise(F.raise_error(F.lit("a rate is positive")).cast("bigint"))
    return quotient((x.cast("decimal(19,0)") * top.cast("decimal(19,0)")).cast(WIDE), denominator)


def allocation_floor(amount: Column, weight: Column, total: Column) -> Column:
    """The share cut toward zero, in minor units."""
    product = F.abs((amount.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).cast(WIDE))
    return (F.signum(amount) * _whole(product, total.cast(WIDE))).cast("bigint")


def allocation_remainder(amount: Column, weight: Column, total: Column) -> Column:
    """What the cut share leaves, without sign."""
    product = F.abs((amount.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).cast(WIDE))
    return (product % total.cast(WIDE)).cast(WIDE)


def utc_month(ts: Column) -> Column:
    """First instant of the month in the session's zone, which is UTC."""
    return F.date_trunc("month", ts)


def local_date(ts: Column, zone: str) -> Column:
    """Date of an instant in an IANA zone."""
    from zoneinfo import ZoneInfo

    ZoneInfo(zone)
    return F.to_date(F.from_utc_timestamp(ts, zone))
