"""Calendar expressions and the public-holiday date dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH_ORDINAL = 719163  # ordinal of 1970-01-01 when 0001-01-01 is day 1


def ordinal(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(EPOCH_ORDINAL)


def iso_day_of_week(day: Column) -> Column:
    return F.weekday(day) + 1


def season(day: Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 autumn."""
    return (F.month(day) % 12 / 3).cast("int") + 1


def with_calendar(df: DataFrame, column: str = "date") -> DataFrame:
    day = F.col(column)
    return df.withColumns(
        {
            "day_of_week": iso_day_of_week(day),
            "week_of_year": F.weekofyear(day),
            "month": F.month(day),
            "season": season(day),
        }
    )


# Month and day of the holidays that never move.
FIXED_HOLIDAYS = (
    (1, 1), (2, 16), (3, 11), (5, 1), (6, 24), (7, 6), (8, 15), (11, 1), (11, 2), (12, 24), (12, 25), (12, 26),
)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    ell = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * ell, 451)
    n = h + ell - 7 * m + 114
    return F.make_date(y, div(n, 31), n % 31 + 1)


def first_sunday(year: Column, month: int) -> Column:
    before = F.date_sub(F.make_date(year.cast("int"), F.lit(month), F.lit(1)), 1)
    return F.next_day(before, "SUN")


def holiday_calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per public holiday; about 16 rows a year, so always a small dimension."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    y = F.col("year")
    fixed = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    moving = [easter_sunday(y), F.date_add(easter_sunday(y), 1), first_sunday(y, 5), first_sunday(y, 6)]
    return years.select(F.explode(F.array(*fixed, *moving)).alias("date")).distinct()
