"""Dates that arrive as text in several spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def to_moment(text: Column) -> Column:
    """Text to TIMESTAMP_NTZ; null where it names no moment.

    Read are year-first spellings with ``-``, ``/`` or ``.``, the compact form of
    eight digits, and day-before-month wherever the year is last, each with an
    optional time after ``T`` or a space. Without a time it is midnight.
    """
    x = F.regexp_replace(text, _EDGE, "")
    x = F.regexp_replace(x, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?=$|[T ])", "$3-$2-$1")
    x = F.regexp_replace(x, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    x = F.regexp_replace(x, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})(?=$|[T ])", "$1-$2-$3")
    x = F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}($|[T ])"), x)
    return x.try_cast("timestamp_ntz")


def to_day(text: Column) -> Column:
    """The day of :func:`to_moment`."""
    return to_moment(text).cast("date")


def iso(day: Column) -> Column:
    """A date as yyyy-MM-dd, '' where it is null."""
    return F.coalesce(day.cast("string"), F.lit(""))
