"""Scalar expressions of the star tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DAY = "1995-01-01"


def day_number(column: str) -> Column:
    """Days since FIRST_DAY."""
    return F.datediff(F.to_date(column), F.to_date(F.lit(FIRST_DAY))).cast("long")


def mfgr_of(brand: str) -> Column:
    """The manufacturer of a brand: five in turn."""
    return F.concat(F.lit("MFGR#"), ((F.substring(brand, 7, 10).cast("int") - 1) % 5 + 1).cast("string"))


def picked(values: Sequence[str], index: Column) -> Column:
    """values[index mod length]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def year_of_day(day: Column, first_year: int = 1992) -> Column:
    """Years of 365 days."""
    return (F.floor(day / 365) + first_year).cast("int")


def drawn(row: Column, seed: int, name: str, modulus: int) -> Column:
    """A number below ``modulus`` that seed, column and row number decide; other seeds and columns give independent ones.

    The first 48 bits of an MD5 digest, so that any engine agrees.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), row.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus).cast("long")
