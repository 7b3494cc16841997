"""Calendar intervals, computed on the driver from a pinned instant and zone, and month spines."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.errors import CompileError

MAX_PERIODS, MAX_MONTHS = 100_000, 120
UTC = dt.timezone.utc


@dataclass(frozen=True)
class TimeContext:
    """The instant, IANA zone and calendar that a request is read at; never the clock."""

    instant: dt.datetime
    zone: str = "UTC"
    calendar: str = "gregorian"


def midnight(day: dt.date, zone: str) -> dt.datetime:
    """The instant of a civil midnight, which must exist once."""
    z = ZoneInfo(zone)
    naive = dt.datetime(day.year, day.month, day.day)
    early, late = (naive.replace(tzinfo=z, fold=f).astimezone(UTC) for f in (0, 1))
    if early != late or early.astimezone(z).replace(tzinfo=None) != naive:
        raise CompileError("ambiguous_calendar_boundary", f"{day} in {zone}")
    return early


def _shift(start: dt.date, unit: str, n: int) -> dt.date:
    try:
        if unit == "day":
            return start + dt.timedelta(days=n)
        if unit == "iso_week":
            return start + dt.timedelta(weeks=n)
        months = start.year * 12 + start.month - 1 + n * (12 if unit == "year" else 1)
        return dt.date(months // 12, months % 12 + 1, 1)
    except (OverflowError, ValueError):
        raise CompileError("temporal_range") from None


def interval(context: TimeContext | None, unit: str, offset: int, count: int) -> tuple[dt.date, dt.date]:
    """First day, and day after the last, of ``count`` whole periods, ``offset`` periods from the one that holds the instant."""
    if context is None:
        raise CompileError("unresolved_time_context")
    if context.calendar != "gregorian" or context.instant.tzinfo is None:
        raise CompileError("invalid_time_context")
    if not 1 <= count <= MAX_PERIODS or abs(offset) > MAX_PERIODS or unit not in ("day", "iso_week", "month", "year"):
        raise CompileError("temporal_range")
    today = context.instant.astimezone(ZoneInfo(context.zone)).date()
    start = {"day": today, "iso_week": today - dt.timedelta(days=today.weekday()), "month": today.replace(day=1), "year": today.replace(month=1, day=1)}[unit]
    return _shift(start, unit, offset), _shift(start, unit, offset + count)


def month_spine(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """``month`` of every month from ``start`` up to ``end``, both UTC month starts."""
    months = (end.year - start.year) * 12 + end.month - start.month
    if any((t.day, t.hour, t.minute, t.second, t.microsecond) != (1, 0, 0, 0, 0) for t in (start, end)):
        raise CompileError("calendar_spine_range")
    if not 1 <= months <= MAX_MONTHS:
        raise CompileError("calendar_spine_limit" if months > MAX_MONTHS else "calendar_spine_range")
    first = F.timestamp_micros(F.lit(int(start.replace(tzinfo=UTC).timestamp()) * 10**6).cast("bigint"))
    return spark.range(months).select(F.add_months(F.to_date(first), F.col("id").cast("int")).cast("timestamp").alias("month"))


def calendar_fill(counted: DataFrame, month: str, count: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The months of the interval with their counts, zero where none was."""
    spine = month_spine(counted.sparkSession, start, end)
    joined = spine.join(counted.select(F.col(month).alias("__m"), F.col(count).alias("__c")), F.col("month") == F.col("__m"), "left")
    return joined.select(F.col("month").alias(month), F.coalesce("__c", F.lit(0).cast("bigint")).alias(count))
