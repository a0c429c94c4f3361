"""Dates, seasons and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factsieve.functions import labels


def season(month: Column) -> Column:
    return (
        F.when(month.between(3, 5), labels.SPRING)
        .when(month.between(6, 8), labels.SUMMER)
        .when(month.between(9, 11), labels.AUTUMN)
        .otherwise(labels.WINTER)
    )


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def is_weekend(weekday: Column) -> Column:
    return weekday.isin(6, 7)


def month_text(day: Column) -> Column:
    """Month name in lower case, padded with blanks to nine characters."""
    return F.rpad(F.lower(F.date_format(day, "MMMM")), 9, " ")


def whole_days(days: Column) -> Column:
    """A fractional day count as an integer, to the nearest, ties to even."""
    return F.rint(days).cast("int")


def years_between(day: Column, first: int, last: int) -> Column:
    """Whether the date lies in the given years, as a plain range the scan can push down."""
    start = F.lit(f"{first:04d}-01-01").cast("date")
    end = F.lit(f"{last + 1:04d}-01-01").cast("date")
    return (day >= start) & (day < end)


def lifetime_days(start: Column, moment: Column) -> Column:
    """Full days from start to moment, floored toward minus infinity.

    Interval arithmetic keeps the clock time of zone-less timestamps as it is, whatever the
    session time zone.
    """
    gap = moment - start
    days = F.extract(F.lit("DAY"), gap)
    return days - F.when(gap < F.make_dt_interval(days), 1).otherwise(0)
