"""Sums that no partitioning changes, and that lose nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 18


def split(column: str, kind: T.DataType, scale: int | None) -> tuple[Column | None, Column | None]:
    """A number as (exact decimal, double rest); their sum is the number. A part that is always 0 is None.

    Decimals and whole numbers are exact. Of a double the decimal part holds ``scale`` decimals, if it
    has no more than DIGITS digits, and the rest what that leaves (0 for amounts of money; all of a very
    large, infinite or NaN value). Both are null if the number is.
    """
    x = F.col(column)
    if isinstance(kind, T.DecimalType):
        return x.cast(T.DecimalType(min(38, max(kind.precision, kind.scale)), kind.scale)), None
    if isinstance(kind, T.IntegralType):
        return x.cast("decimal(20,0)"), None
    x = x.cast("double")
    if scale is None:
        return None, x
    exact = F.when(x.isNotNull(), F.coalesce(x.try_cast(f"decimal({DIGITS},{scale})"), F.lit(0).cast(f"decimal({DIGITS},{scale})")))
    return exact, x - exact.cast("double")


def total(exact: Column | None, rest: Column | None) -> Column:
    """The sum of both parts as a double; null if nothing is summed."""
    found = [F.sum(c).cast("double") for c in (exact, rest) if c is not None]
    return found[0] if len(found) == 1 else found[0] + found[1]
