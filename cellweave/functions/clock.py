"""Days from 12 UTC to 12 UTC, file-name times, days of year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_HOUR = 12


def convective_day(ts: Column, start_hour: int = START_HOUR) -> Column:
    """The day whose half-open window from ``start_hour`` UTC holds ``ts``."""
    return F.to_date(ts - F.expr(f"INTERVAL {start_hour} HOURS"))


def name_time(name: Column) -> Column:
    """UTC time in a file name, as 20160721T081530Z or 20160721-081530; null where absent or invalid."""
    date, time = (F.regexp_extract(name, r"(\d{8})[T-](\d{6})Z?", g) for g in (1, 2))
    return F.try_to_timestamp(F.concat(date, time), F.lit("yyyyMMddHHmmss"))


def doy_distance(a: Column, b: Column, length: int = 366) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(length) - d)


def two_digit_year(year: Column) -> Column:
    return F.when(year < 80, year + 2000).otherwise(year + 1900)


def era(day: Column) -> Column:
    """Source in use on a day."""
    return F.when(day >= F.lit("2020-10-14").cast("date"), "MRMS").when(day >= F.lit("2012-01-01").cast("date"), "GridRad").otherwise("MYRORSS")
