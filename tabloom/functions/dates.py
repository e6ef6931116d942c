"""Column functions on dates. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# mean Gregorian month in days
DAYS_PER_MONTH = 30.436875


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(c, F.lit(fmt))


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def month(c: Column) -> Column:
    return F.month(c)


def year(c: Column) -> Column:
    return F.year(c)


def quarter(c: Column) -> Column:
    return F.quarter(c)


def semester(c: Column) -> Column:
    return F.when(F.quarter(c) <= 2, 1).when(F.quarter(c) >= 3, 2)


def weekday(c: Column) -> Column:
    """Monday = 0."""
    return F.weekday(c)


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def is_weekend(c: Column) -> Column:
    return (F.weekday(c) >= 5).cast("int")


def is_month_start(c: Column) -> Column:
    return (F.dayofmonth(c) == 1).cast("int")


def truncate(c: Column, period: str) -> Column:
    return F.date_trunc(period, c)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def months_on_book(as_of: Column, start: Column) -> Column:
    return F.datediff(as_of, start) / F.lit(DAYS_PER_MONTH)


def elapsed_years(later_year: Column, earlier_year: Column) -> Column:
    return later_year - earlier_year


def years_since(base_year: int, year_col: Column) -> Column:
    return F.lit(base_year) - year_col


def date_spine(df: DataFrame, col: str) -> DataFrame:
    """One row per calendar day between the first and last date of a column."""
    ends = df.agg(F.to_date(F.min(col)).alias("a"), F.to_date(F.max(col)).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
