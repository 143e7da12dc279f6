"""Star aggregation: one logical plan; the strategy only changes how its joins run."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.functions.sums import split, total
from starfold.model import Dimension, Prepared, StarQuery, strategy_name

#: A dimension is broadcast only if its values are found to have at most so many bytes.
BROADCAST_BYTES = 512 << 20
ROW_BYTES = 32  # of a hash relation, besides the values
HINTS = {"merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast"}


def sizes(sides: Sequence[DataFrame]) -> list[int]:
    """Bytes of the rows of each, uncompressed, found by one job of partial sums.

    The optimizer's size is not asked: for files it is that of their compressed columns.
    """
    every = None
    for k, df in enumerate(sides):
        wide = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]
        each = ROW_BYTES + 8 * sum(isinstance(f.dataType, T.NumericType) for f in df.schema.fields)
        one = df.agg(F.lit(k).alias("k"), F.sum(sum(wide, F.lit(each)).cast("long")).alias("n"))
        every = one if every is None else every.unionByName(one)
    found = {r["k"]: r["n"] or 0 for r in every.collect()} if every is not None else {}
    return [found[k] for k in range(len(sides))]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df`` have at most ``limit`` bytes."""
    return sizes([df])[0] <= limit


def has_key(dim: Dimension) -> bool:
    """Whether no key value repeats among the dimension's rows: as declared, else as found."""
    if dim.unique is not None:
        return dim.unique
    rows = dim.rows().filter(F.col(dim.dim_key).isNotNull())
    return not rows.groupBy(dim.dim_key).count().filter("count > 1").limit(1).count()


def ordered(dims: Sequence[Dimension]) -> list[Dimension]:
    """Restricted dimensions first, those that only filter before those that widen rows."""
    return sorted(dims, key=lambda d: (d.predicate is None, bool(d.attrs)))


def join_star(q: StarQuery, strategy: str, notes: list[str]) -> DataFrame:
    rows = q.fact if q.fact_predicate is None else q.fact.filter(q.fact_predicate)
    dims = ordered(q.dims)
    hint_of = HINTS.get(strategy)
    bytes_of = sizes([d.rows() for d in dims]) if hint_of == "broadcast" else [0] * len(dims)
    for k, dim in enumerate(dims):
        side = dim.rows().withColumnRenamed(dim.dim_key, f"__key{k}")
        hint = hint_of
        if hint == "broadcast" and bytes_of[k] > BROADCAST_BYTES:
            notes.append(f"dimension of {dim.fact_key} has more than {BROADCAST_BYTES} bytes; Spark chooses its join")
            hint = None
        side = side.hint(hint) if hint else side
        kind = "left_semi" if not dim.attrs and has_key(dim) else "inner"
        rows = rows.join(side, F.col(dim.fact_key) == F.col(f"__key{k}"), kind)
        rows = rows.drop(f"__key{k}") if kind == "inner" else rows
    return rows


def prepare(q: StarQuery, strategy: str = "auto", repartition: int | None = None) -> Prepared:
    """Plan a star query. Rows follow SQL's inner joins: no match or a null key drops a row, repeated dimension
    keys multiply, null attributes are a group, null measures don't count."""
    began, notes = time.perf_counter(), []
    q.checked()
    if repartition is not None:
        q = StarQuery(q.fact.repartition(repartition), q.dims, q.group_keys, q.measure, q.alias, q.fact_predicate, q.scale)
    if strategy_name(strategy) == "onepass":
        from starfold.operators.onepass import one_pass

        q = StarQuery(q.fact, ordered(q.dims), q.group_keys, q.measure, q.alias, q.fact_predicate, q.scale)
        df, reason = one_pass(q)
        if df is not None:
            return Prepared(df, "onepass", time.perf_counter() - began, notes)
        notes.append(f"onepass does not apply: {reason}")
        strategy = "broadcast"
    joined = join_star(q, strategy, notes)
    df = joined.groupBy(*q.group_keys).agg(total(*split(q.measure, q.fact.schema[q.measure].dataType, q.scale)).alias(q.alias))
    return Prepared(df, strategy, time.perf_counter() - began, notes)


def star_aggregate(fact: DataFrame, dims: Sequence[Dimension], group_keys: Sequence[str], measure: str, strategy: str = "auto", **more) -> DataFrame:
    """SUM of ``measure`` over ``fact`` and any number of dimensions, by any of their attributes."""
    repartition = more.pop("repartition", None)
    return prepare(StarQuery(fact, dims, group_keys, measure, **more), strategy, repartition).df


def eager(q: StarQuery, strategy: str = "auto") -> DataFrame:
    """The same result with the fact summed by its foreign keys before any join: fewer rows to join where keys repeat."""
    q.checked()
    own = [g for g in q.group_keys if g in q.fact.columns and not any(g in d.attrs for d in q.dims)]
    keys = list(dict.fromkeys([*(d.fact_key for d in q.dims), *own]))
    rows = q.fact if q.fact_predicate is None else q.fact.filter(q.fact_predicate)
    held = {n: c for n, c in zip(("__exact", "__rest"), split(q.measure, q.fact.schema[q.measure].dataType, q.scale), strict=True) if c is not None}
    rows = rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in held.items()])
    inner = StarQuery(rows, q.dims, q.group_keys, next(iter(held)), q.alias, None, q.scale)
    joined = join_star(inner, strategy_name(strategy), [])
    return joined.groupBy(*q.group_keys).agg(total(*[F.col(n) if n in held else None for n in ("__exact", "__rest")]).alias(q.alias))
