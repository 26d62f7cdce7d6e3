"""Session calendars, calendar features and event distances.

Frames here have one row per day (bounded by the calendar), so ordered windows over them
and broadcasts of them are safe at any panel size.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, QUANT

# One-off closures of the exchange.
SPECIAL_CLOSURES = ("2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def day_window(order: Column | str = DATE):
    """Ordered window over a one-row-per-day frame."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def distinct_dates(df: DataFrame, column: str = DATE) -> DataFrame:
    return df.select(F.col(column).alias(DATE)).where(F.col(column).isNotNull()).distinct()


def session_index(sessions: DataFrame, start: int = 0) -> DataFrame:
    """(date, session_index): dense index of the ordered distinct dates."""
    return sessions.select(DATE, (F.row_number().over(day_window()) - 1 + start).cast("bigint").alias("session_index"))


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (n - 1))


def nearest_workday(day: Column) -> Column:
    """Saturday moves to Friday, Sunday to Monday."""
    weekday = F.weekday(day)
    return F.when(weekday == 5, F.date_sub(day, 1)).when(weekday == 6, F.date_add(day, 1)).otherwise(day)


def easter(year: Column) -> Column:
    """Gregorian computus (anonymous algorithm) as column arithmetic."""
    def div(a, b):
        return F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    l = (32 + 2 * e + 2 * i - h - k) % 7
    m = div(a + 11 * h + 19 * l, 433)
    month = div(h + l - 7 * m + 90, 25)
    day = (h + l - 7 * m + 33 * month + 19) % 32
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def holidays(years: DataFrame) -> DataFrame:
    """Exchange holidays for a frame of ``year`` values."""
    y = F.col("year")

    def fixed(month, day):
        return nearest_workday(F.make_date(y, F.lit(month), F.lit(day)))

    may_end = F.make_date(y, F.lit(5), F.lit(31))
    rules = [
        fixed(1, 1), nth_weekday(y, 1, "MON", 3), nth_weekday(y, 2, "MON", 3),
        F.date_sub(easter(y), 2), F.date_sub(F.next_day(may_end, "MON"), 7),
        F.when(y >= 2022, fixed(6, 19)), fixed(7, 4), nth_weekday(y, 9, "MON", 1),
        nth_weekday(y, 11, "THU", 4), fixed(12, 25)]
    return years.select(F.explode(F.array(*rules)).alias(DATE)).where(F.col(DATE).isNotNull())


def exchange_sessions(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Trading sessions for one-row bounds: weekdays minus holidays minus one-off closures."""
    spark = bounds.sparkSession
    days = bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias(DATE)).where(F.weekday(DATE) < 5)
    years = bounds.select(F.explode(F.sequence(F.year(start), F.year(end) + 1)).alias("year"))
    closed = holidays(years).unionByName(
        spark.createDataFrame([(d,) for d in SPECIAL_CLOSURES], f"{DATE} string").select(F.to_date(DATE).alias(DATE)))
    return days.join(F.broadcast(closed), DATE, "left_anti")


def exchange_sessions_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    bounds = spark.range(1).select(F.to_date(F.lit(start)).alias("start"), F.to_date(F.lit(end)).alias("end"))
    return exchange_sessions(bounds)


def sessions_until(dates: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each distinct date: how many sessions are <= it (``upto``), < it (``before``) and in all."""
    marks = (distinct_dates(dates).withColumn("is_session", F.lit(0))
             .unionByName(distinct_dates(sessions).withColumn("is_session", F.lit(1)))
             .groupBy(DATE).agg(F.max("is_session").alias("is_session")))
    running = day_window().rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.select(DATE, "is_session", F.sum("is_session").over(running).alias("upto"),
                           F.sum("is_session").over(Window.partitionBy(F.lit(0))).alias("total"))
    return counted.select(DATE, "upto", "total", (F.col("upto") - F.col("is_session")).alias("before"))


def event_distances(days: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """days_to_next_/days_since_last_ in calendar days (0 on the day, -1 when there is none),
    is_ on the day, and whether an event falls in the same ISO week."""
    marks = (distinct_dates(days).withColumn("is_day", F.lit(1))
             .unionByName(distinct_dates(events).withColumn("is_day", F.lit(0)))
             .groupBy(DATE).agg(F.max("is_day").alias("is_day"),
                                F.max(F.when(F.col("is_day") == 0, F.col(DATE))).alias("event")))
    after = day_window().rowsBetween(0, Window.unboundedFollowing)
    before = day_window().rowsBetween(Window.unboundedPreceding, 0)
    per_week = Window.partitionBy(F.extract(F.lit("YEAROFWEEK"), F.col(DATE)), F.weekofyear(DATE))
    out = marks.select(
        DATE, "is_day",
        F.col("event").isNotNull().cast("int").alias(f"is_{name}_day"),
        F.coalesce(F.datediff(F.first("event", True).over(after), F.col(DATE)), F.lit(-1)).alias(f"days_to_next_{name}"),
        F.coalesce(F.datediff(F.col(DATE), F.last("event", True).over(before)), F.lit(-1)).alias(f"days_since_last_{name}"),
        (F.count("event").over(per_week) > 0).cast("int").alias(f"is_{name}_week"))
    return out.where(F.col("is_day") == 1).drop("is_day")


def quad_witching_days(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Third Friday of March, June, September and December inside the bounds."""
    years = bounds.select(F.col(start).alias("s"), F.col(end).alias("e"),
                          F.explode(F.sequence(F.year(start), F.year(end))).alias("year"))
    fridays = F.array(*[nth_weekday(F.col("year"), m, "FRI", 3) for m in (3, 6, 9, 12)])
    return (years.select("s", "e", F.explode(fridays).alias(DATE))
            .where(F.col(DATE).between(F.col("s"), F.col("e"))).select(DATE))


def cyclical(df: DataFrame) -> DataFrame:
    d = F.col(DATE)
    parts = {"day_of_week": (F.weekday(d), 7.0), "month_of_year": (F.month(d), 12.0),
             "day_of_month": (F.dayofmonth(d), 31.0), "day_of_year": (F.dayofyear(d), 366.0)}
    out = {}
    for name, (value, period) in parts.items():
        angle = F.lit(2.0 * pi) * value.cast("double") / period
        out |= {f"{QUANT}{name}_sin": F.sin(angle), f"{QUANT}{name}_cos": F.cos(angle)}
    return df.withColumns(out)


def period_edges(dates: DataFrame) -> DataFrame:
    """First / last observed date of each month and quarter; the panel's last date is an end."""
    w = day_window()
    out = {}
    for unit, fmt in (("month", "MM"), ("quarter", "quarter")):
        period = F.trunc(DATE, fmt)
        out[f"{QUANT}is_{unit}_start"] = (~F.coalesce(F.lag(period).over(w) == period, F.lit(False))).cast("int")
        out[f"{QUANT}is_{unit}_end"] = (~F.coalesce(F.lead(period).over(w) == period, F.lit(False))).cast("int")
    return distinct_dates(dates).withColumns(out)


def add_calendar_features(df: DataFrame) -> DataFrame:
    return cyclical(df).join(F.broadcast(period_edges(df)), DATE, "left")


def business_days_before(day: Column, n: int) -> Column:
    """The date ``n`` weekdays before ``day``; counting from a weekend starts at the next Monday."""
    weekday = F.weekday(day)
    anchor = F.when(weekday == 5, F.date_add(day, 2)).when(weekday == 6, F.date_add(day, 1)).otherwise(day)
    weeks, rest = divmod(n, 5)
    over_weekend = F.when(F.weekday(anchor) < rest, 2).otherwise(0)
    return F.date_sub(anchor, (over_weekend + (7 * weeks + rest)).cast("int"))
