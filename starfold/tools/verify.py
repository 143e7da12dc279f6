"""Equivalence of results: whole rows, not only their number and sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> tuple[int, int]:
    """How many rows of each the other lacks, repeats counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).count(), b.exceptAll(a).count()


def same(results: dict[str, DataFrame]) -> dict[str, bool]:
    """Whether each result has the rows of the first."""
    (_, first), *rest = results.items()
    return {name: difference(first, df) == (0, 0) for name, df in rest}


def groups_and_sum(df: DataFrame, measure: str = "total") -> tuple[int, float | None]:
    n, total = df.agg(F.count("*"), F.sum(F.col(measure).cast("decimal(38,2)")).cast("double")).first()
    return n, total
