"""Date expressions. The current day is always a parameter, `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall import fixed_values as fixed

# One- and two-digit months and days both parse.
DOTTED = "yyyy.M.d"
DASHED = "yyyy-M-d"


def first_token(text: Column, separator: str) -> Column:
    return F.split_part(text, F.lit(separator), F.lit(1))


def parse_date(text: Column, fmt: str, as_of: Column) -> Column:
    """Date of a listing row; a missing or unreadable one becomes `as_of`."""
    return F.coalesce(F.try_to_date(text, fmt), as_of)


def within_days(day: Column, as_of: Column, days: int) -> Column:
    """True when `day` is at most `days` before `as_of`; a missing day is false."""
    return F.coalesce(day >= F.date_sub(as_of, days), F.lit(False))


def recency_flags(day: Column, as_of: Column) -> list[Column]:
    return [
        within_days(day, as_of, fixed.WEEK_DAYS).alias("uploaded_in_a_week"),
        within_days(day, as_of, fixed.DAY_DAYS).alias("uploaded_in_a_day"),
    ]
