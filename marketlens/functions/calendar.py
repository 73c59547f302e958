"""The sales calendar: double dates, festivals, paydays and mid-month sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tiers by priority, highest first: fixed values.
TIERS = ["mega", "cny", "major", "songkran", "newyear", "double", "payday", "midmonth"]
BIG_TIERS = ["mega", "major", "cny", "songkran", "newyear"]

#: Lunar new year by year: fixed values.
CNY = {2024: "2024-02-10", 2025: "2025-01-29", 2026: "2026-02-17", 2027: "2027-02-06", 2028: "2028-01-26"}


def last_business_day(date: Column) -> Column:
    """The last Monday-to-Friday of the date's month."""
    end = F.last_day(date)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def tier(date: Column, cny: dict[int, str] = CNY) -> Column:
    """The most important tier that falls on a date, or null."""
    month, day = F.month(date), F.dayofmonth(date)
    lunar = F.lit(False)
    for d in cny.values():
        lunar = lunar | ((F.abs(F.datediff(date, F.lit(d).cast("date"))) <= 1) & (F.year(date) == int(d[:4])))
    same = month == day
    return (
        F.when(same & (month >= 11), "mega")
        .when(lunar, "cny")
        .when(same & (month >= 6), "major")
        .when((month == 4) & day.between(13, 15), "songkran")
        .when(((month == 12) & (day == 31)) | ((month == 1) & (day <= 2)), "newyear")
        .when(same, "double")
        .when(date == last_business_day(date), "payday")
        .when(day == 15, "midmonth")
    )


def event_calendar(spark: SparkSession, start: str, days: int, cny: dict[int, str] = CNY) -> DataFrame:
    """(date, tier) of the events in the days after ``start``, inclusive."""
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_add(F.lit(start).cast("date"), days))).alias("date"))
    return with_events(dates, cny)


def with_events(dates: DataFrame, cny: dict[int, str] = CNY) -> DataFrame:
    """(date, tier) of those dates of a table that are events."""
    return dates.select("date", tier(F.col("date"), cny).alias("tier")).filter("tier is not null")
