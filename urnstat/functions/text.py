"""Text of raw records: folding, tolerant numbers, spoken dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date texts carry a full English weekday and month name.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SPOKEN_DATE = r"(?i)^(" + "|".join(WEEKDAYS) + r") (\d{1,2} [a-z]+ \d{4})$"


def fold(text: Column) -> Column:
    """Embedded newlines and runs of blanks become one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def to_number(token: Column) -> Column:
    """Integer inside blanks and double quotes; null when it is no integer."""
    return F.trim(F.btrim(F.trim(F.regexp_replace(token, r"\s", " ")), F.lit('"'))).try_cast("int")


def parse_draw_date(text: Column) -> Column:
    """``Friday 25 April 2025`` → date; anything else → null."""
    day = F.regexp_extract(fold(text), SPOKEN_DATE, 2)
    return F.try_to_timestamp(day, F.lit("d MMMM yyyy")).cast("date")


def parse_day_and_year(day: Column, year: Column) -> Column:
    """``25 April`` + ``2025`` → date; weekday and short months are allowed."""
    text = fold(F.concat_ws(" ", day, year))
    bare = F.regexp_replace(text, r"(?i)^(" + "|".join(WEEKDAYS) + r"),? ", "")
    formats = ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats]).cast("date")


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
