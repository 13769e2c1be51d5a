"""Schedules and periods as Column expressions."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

# Days until a record of a priority ends; others never do.
TTL_DAYS = {"transient": 1, "short_term": 3, "long_term": 30}
# Periods up to now, in days, with their labels.
PERIOD_LABELS = ((1, "近 1 天"), (3, "近 3 天"), (7, "近 1 周"), (30, "近 1 月"), (182, "近 6 月"), (365, "近 1 年"))
# Least and greatest value of a schedule's fields: minute, hour, day, month, weekday (0 and 7 are Sunday).
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def expiry(time: str, priority: Column) -> Column:
    """When a record ends; null for one that never does."""
    days = F.coalesce(*[F.when(priority == p, d) for p, d in TTL_DAYS.items()])
    return F.col(time) + F.make_dt_interval(days, F.lit(0), F.lit(0), F.lit(0))


def period_label(days: Column) -> Column:
    """The label of the shortest period that reaches back so many days; null beyond all."""
    return F.coalesce(*[F.when(days <= most, label) for most, label in PERIOD_LABELS])


def _values(field: str, least: int, most: int) -> set[int]:
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        lo, _, hi = span.partition("-")
        first = least if span == "*" else int(lo)
        last = most if span == "*" or (step and not hi) else int(hi or lo)
        if not least <= first <= last <= most or (step and int(step) < 1):
            raise ValueError(f"bad field {field!r}")
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def cron_after(expression: str, after: datetime.datetime) -> datetime.datetime | None:
    """The first time after ``after`` that a schedule of five fields names; six have seconds in front. None if there is none in eight years.

    A field is ``*``, a number, a range, a list, each with ``/step`` if wanted. If both
    day and weekday are given, either does.
    """
    fields = expression.split()
    seconds = _values(fields[0], 0, 59) if len(fields) == 6 else {0}
    minute, hour, day, month, weekday = (_values(f, *span) for f, span in zip(fields[-5:], FIELDS, strict=True))
    weekday = {d % 7 for d in weekday}
    any_day, any_weekday = fields[-3] == "*", fields[-1] == "*"
    at = after.replace(microsecond=0) + datetime.timedelta(seconds=1)
    end = at + datetime.timedelta(days=8 * 366)
    while at < end:
        by_day, by_weekday = at.day in day, at.isoweekday() % 7 in weekday
        right = by_day and by_weekday if any_day or any_weekday else by_day or by_weekday
        if at.month not in month or not right:
            at = (at + datetime.timedelta(days=1)).replace(hour=0, minute=0, second=0)
        elif at.hour not in hour:
            at = (at + datetime.timedelta(hours=1)).replace(minute=0, second=0)
        elif at.minute not in minute:
            at = (at + datetime.timedelta(minutes=1)).replace(second=0)
        elif at.second not in seconds:
            at += datetime.timedelta(seconds=1)
        else:
            return at
    return None


def next_at(at: Column, now: Column) -> Column:
    """A single run's time if it is still to come, else null."""
    return F.when(at > now, at)


def next_every(time: Column, seconds: int) -> Column:
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def next_cron(expression: str, time: str) -> Column:
    """:func:`cron_after` of a column, in UTC; null stays null."""
    cron_after(expression, datetime.datetime(2024, 1, 1))  # a bad expression fails here

    @F.pandas_udf(TimestampType())
    def run(s: pd.Series) -> pd.Series:
        return pd.to_datetime(s.map(lambda t: None if pd.isna(t) else cron_after(expression, t.to_pydatetime())))

    return run(F.col(time).cast("timestamp"))
