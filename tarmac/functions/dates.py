"""Date and time expressions.  Naive timestamps are TIMESTAMP_NTZ throughout,
so no result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: hours 0-23 and minutes 0-59, one or two digits each.
CLOCK = r"^([01]?[0-9]|2[0-3]):([0-5]?[0-9])$"


def uk_date(col: Column) -> Column:
    """``dd/mm/yyyy`` text as a date; anything unparseable becomes NULL."""
    return F.try_to_date(col, "d/M/yyyy")


def join_clock(date: Column, clock: Column) -> Column:
    """Date plus ``HH:mm`` text; NULL when either part is missing or bad."""
    hour = F.regexp_extract(clock, CLOCK, 1).try_cast("int")
    minute = F.regexp_extract(clock, CLOCK, 2).try_cast("int")
    return F.when(
        clock.rlike(CLOCK),
        F.make_timestamp_ntz(
            F.year(date), F.month(date), F.dayofmonth(date), hour, minute, F.lit(0).cast("decimal(16,6)")
        ),
    )


def london_to_utc(local: Column) -> Column:
    """Wall-clock time in Europe/London as UTC."""
    return F.convert_timezone(F.lit("Europe/London"), F.lit("UTC"), local)


def month_name(col: Column) -> Column:
    return F.date_format(col, "MMMM")


def day_name(col: Column) -> Column:
    return F.date_format(col, "EEEE")


def nearest_month(date: Column) -> Column:
    """First day of the nearest month; halfway goes to the later one."""
    start = F.trunc(date, "month")
    following = F.add_months(start, 1)
    return F.when(F.datediff(date, start) < F.datediff(following, date), start).otherwise(following)


def clock_hour(clock: Column) -> Column:
    """Hour taken from the first two characters of the time text."""
    return F.substring(clock, 1, 2).try_cast("int")
