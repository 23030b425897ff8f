"""Calendar dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new_date(year: Column | int, month: Column | int, day: Column | int) -> Column:
    return F.make_date(*(F.lit(x) for x in (year, month, day)))


def date_of(c: Column) -> Column:
    """The date of a moment; of text, of its first ten characters."""
    return c.cast("date")


def parse_date(c: Column) -> Column:
    """Strictly yyyy-MM-dd; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def date_from_text(c: Column) -> Column:
    """The date at the start of a stored text."""
    return parse_date(F.substring(c, 1, 10))


def year(c: Column) -> Column:
    return F.year(c).cast("long")


def month(c: Column) -> Column:
    return F.month(c).cast("long")


def day(c: Column) -> Column:
    return F.dayofmonth(c).cast("long")


def add_days(c: Column, n: int) -> Column:
    return F.date_add(c, n)


def to_time(c: Column) -> Column:
    """Midnight, UTC sessions assumed."""
    return c.cast("timestamp")


def to_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def is_zero(c: Column) -> Column:
    """The zero date stands for none; null is zero too."""
    return F.coalesce(c == F.lit("0001-01-01").cast("date"), F.lit(True))


def today() -> Column:
    return F.current_date()
