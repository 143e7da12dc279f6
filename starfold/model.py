"""What a star query says, apart from how it runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

STRATEGIES = ("auto", "broadcast", "merge", "shuffle_hash", "onepass")


@dataclass(frozen=True)
class Dimension:
    """A dimension of a fact table.

    ``fact_key`` = ``dim_key`` joins it; ``attrs`` are what it contributes to the result (none: it only
    filters); ``predicate`` restricts its rows. ``unique``: whether dim_key is a key; None asks the data
    where the plan depends on it.
    """

    df: DataFrame
    fact_key: str
    dim_key: str
    attrs: Sequence[str] = ()
    predicate: Column | None = None
    unique: bool | None = None

    def rows(self) -> DataFrame:
        kept = self.df if self.predicate is None else self.df.filter(self.predicate)
        return kept.select(self.dim_key, *self.attrs)


@dataclass(frozen=True)
class StarQuery:
    """SUM(measure) over fact and dimensions, by group_keys.

    ``scale``: decimals of a double that are summed exactly; what a value has beyond them is summed as
    a double beside, so nothing is rounded away. None sums doubles only.
    """

    fact: DataFrame
    dims: Sequence[Dimension]
    group_keys: Sequence[str]
    measure: str
    alias: str = "total"
    fact_predicate: Column | None = None
    scale: int | None = 2

    def checked(self) -> StarQuery:
        """Raise ValueError for names and types that cannot work."""
        columns = set(self.fact.columns)
        for name in (self.measure, *(d.fact_key for d in self.dims)):
            if name not in columns:
                raise ValueError(f"fact has no column {name!r}; it has {sorted(columns)}")
        if not isinstance(self.fact.schema[self.measure].dataType, T.NumericType):
            raise ValueError(f"measure {self.measure!r} is not a number")
        offered: list[str] = []
        for d in self.dims:
            for name in (d.dim_key, *d.attrs):
                if name not in d.df.columns:
                    raise ValueError(f"dimension of {d.fact_key!r} has no column {name!r}")
            offered += d.attrs
        if twice := sorted({a for a in offered if offered.count(a) > 1}):
            raise ValueError(f"attributes of more than one dimension: {twice}")
        for key in self.group_keys:
            if key not in offered and key not in columns:
                raise ValueError(f"group key {key!r} is neither an attribute of a dimension nor a column of the fact")
        return self


@dataclass
class Prepared:
    """A planned query: its result, the strategy that was used, and why, if another was asked for."""

    df: DataFrame
    strategy: str
    setup_seconds: float = 0.0
    notes: list[str] = field(default_factory=list)


def strategy_name(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; one of {', '.join(STRATEGIES)}")
    return name
