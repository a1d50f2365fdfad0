"""Parsing and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the day number of 1970-01-01 in a count of days that begins in year 0.
DATENUM_1970 = 719529


def recorder_micros(raw: Column) -> Column:
    """Microseconds since 1970 of "YYY DDD:HH:MM:SS:mmm", the years since 1900; null if a part is no number."""
    p = F.split(raw, "[ :]")
    n = [F.element_at(p, i).try_cast("int") for i in range(1, 7)]
    day = F.date_add(F.make_date(n[0] + 1900, F.lit(1), F.lit(1)), n[1] - 1)
    return ((F.unix_date(day).cast("long") * 24 + n[2]) * 60 + n[3]) * 60_000_000 + n[4].cast("long") * 1_000_000 + n[5] * 1000


def compact_micros(raw: Column) -> Column:
    """Microseconds of YYYYDDDHHMMSSff; null if it is shorter than that or a part is no number."""

    def part(at: int, size: int) -> Column:
        return F.substring(raw, at, size).try_cast("int")

    day = F.date_add(F.make_date(part(1, 4), F.lit(1), F.lit(1)), part(5, 3) - 1)
    us = ((F.unix_date(day).cast("long") * 24 + part(8, 2)) * 60 + part(10, 2)) * 60_000_000 + part(12, 2).cast("long") * 1_000_000
    return F.when(F.length(raw) >= 14, us + part(14, 1 << 30) * 10_000)


def datenum(name: str) -> Column:
    """Days since year 0 with their fraction, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})").cast("double") / 86400000000 + DATENUM_1970


def from_datenum(days: Column) -> Column:
    """Microseconds since 1970."""
    return F.round((days - DATENUM_1970) * 86400 * 1e6).cast("long")


def sum_of(found: Column) -> Column:
    """Sum of an array of numerals."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def mentions(note: Column, *kinds: str) -> Column:
    """Sum of the numbers that stand before one of the kinds, as in "3 maybe EQs" or "2 EQ"."""
    return sum_of(F.regexp_extract_all(note, F.lit(rf"(?i)(\d+)\s+(?:maybe\s+)?(?:{'|'.join(kinds)})s?\b"), F.lit(1)))


def contains_any(value: Column, *words: str) -> Column:
    """Whether a value holds one of the words, in lower case, anywhere."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(value), F.lit(w))
    return hit


def source_level(received: Column, metres: Column) -> Column:
    return received + 15 * F.log10(F.greatest(metres, F.lit(100.0)))
