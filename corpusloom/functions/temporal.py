"""Half-open periods, month arithmetic and working days as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Public holidays with the same date each year, as month and day.
FIXED_HOLIDAYS = ["01-01", "04-23", "05-01", "05-19", "07-15", "08-30", "10-29"]


def covers(lo: Column, hi: Column, at: Column) -> Column:
    """Whether the period [lo, hi) holds a date; a null end is open."""
    return (lo <= at) & (hi.isNull() | (at < hi))


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    """Whether two half-open ranges meet; empty ranges meet nothing."""
    return (lo < hi) & (other_lo < other_hi) & (lo < other_hi) & (other_lo < hi)


def add_months_clamped(day: Column, months: Column) -> tuple[Column, Column]:
    """The day some months later, clamped to the month's end, and whether it was clamped."""
    later = F.add_months(day, months)
    return later, F.dayofmonth(later) != F.dayofmonth(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def month_day(day: Column) -> Column:
    """Month and day as one number; a timestamp, as formats need, ends in the year 294247."""
    return F.month(day) * 100 + F.dayofmonth(day)


def is_fixed_holiday(day: Column) -> Column:
    return month_day(day).isin([int(x.replace("-", "")) for x in FIXED_HOLIDAYS])


def in_recess(day: Column) -> Column:
    """Within the judicial recess, 20 July to 31 August."""
    return month_day(day).between(720, 831)


#: A run of weekends and fixed holidays is always shorter than this.
LONGEST_RUN = 14


def next_workday(day: Column) -> Column:
    """The day itself if it is a working day, else the next one; null for null."""
    ahead = F.transform(F.sequence(F.lit(0), F.lit(LONGEST_RUN)), lambda i: F.date_add(day, i))
    return F.get(F.filter(ahead, lambda x: ~(is_weekend(x) | is_fixed_holiday(x))), F.lit(0))


def deadline(start: Column, days: Column) -> Column:
    """End of a period of days before it is moved to a working day.

    A period that ends in the recess ends seven days after it.
    """
    end = F.date_add(start, days)
    after = F.make_date(F.year(end), F.lit(9), F.lit(7))
    return F.when(in_recess(end), after).otherwise(end)


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Numbers runs of equal ``value`` within ``keys`` in column ``island``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w)).drop("__changed")
