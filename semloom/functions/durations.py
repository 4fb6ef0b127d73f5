"""Durations and partly redacted dates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed scale of the contract data: months of 30 and years of 365 days.
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")


def parse_duration(text: Column) -> Column:
    """``three (3) years`` or ``18 months`` as struct(length double, unit string); null where there is none."""
    low = F.lower(text)
    low = F.regexp_replace(low, r"[a-z-]+\s*\(\s*(\d+)\s*\)", "$1")
    for value, word in enumerate(_NUMBERS, 1):
        low = F.regexp_replace(low, rf"\b{word}\b", str(value))
    pattern = r"(\d+(?:\.\d+)?)\s*-?\s*(day|week|month|year)s?"
    length, unit = F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)
    return F.when(length != "", F.struct(length.cast("double").alias("length"), unit.alias("unit")))


def days(duration: Column) -> Column:
    scale = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
    return duration["length"] * scale[duration["unit"]]


def parse_date(text: Column, pivot: int = 50) -> Column:
    """``m/d/y`` with ``?`` for redacted digits as struct(month, day, year) of strings.

    A two-digit year below the pivot is of this century. A first part above 12 is a day.
    """
    parts = F.split(F.trim(text), r"[/.-]")
    month, day, year = (F.trim(F.element_at(parts, k)) for k in (1, 2, 3))
    swap = (month.try_cast("int") > 12) & (day.try_cast("int") <= 12)
    full = F.when((F.length(year) == 2) & year.try_cast("int").isNotNull(), F.when(year.cast("int") < pivot, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))).otherwise(year)
    pad = lambda x: F.when(F.length(x) == 1, F.concat(F.lit("0"), x)).otherwise(x)
    made = F.struct(pad(F.when(swap, day).otherwise(month)).alias("month"), pad(F.when(swap, month).otherwise(day)).alias("day"), full.alias("year"))
    return F.when(F.size(parts) == 3, made)
