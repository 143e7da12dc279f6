"""The one-pass strategy: Arrow batches of the fact look their keys up and are summed before the only shuffle.

A dimension with dense, non-negative whole keys is an array by key; any other (sparse, negative or
text keys) is a hash table of its keys. Keys may repeat: the fact's row then counts for each of the
dimension's. Dictionaries of attributes stay inside: results are values, never codes. What is too
large to send to every executor is left to joins, with the reason.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starfold.functions.sums import split
from starfold.model import Dimension, StarQuery
from starfold.session import importable

#: Rows of a dimension at most, and array slots for each of them: the bounds of what is collected and broadcast.
MOST_ROWS = 8_000_000
SPARSEST = 8
#: Groups that are summed in arrays by their number; more are summed by their names.
DENSE_GROUPS = 1 << 20
MOST_GROUPS = 1 << 40
#: Rows that are summed at once: sums of 32-bit halves stay exact as doubles.
ROWS_AT_ONCE = 1 << 20


@dataclass
class Lookup:
    """Keys to codes; a code is the position of its attributes in ``values``.

    ``slots``: the place of each dense key among the distinct ones, -1 for none; else ``keys`` are the
    distinct keys. ``codes[begin[p] : begin[p + 1]]`` are those of place p.
    """

    fact_key: str
    attrs: tuple[str, ...]
    slots: np.ndarray | None
    keys: pa.Array
    begin: np.ndarray
    codes: np.ndarray
    values: list[tuple]

    @property
    def radix(self) -> int:
        return max(1, len(self.values)) if self.attrs else 1

    def places(self, column: pa.Array) -> np.ndarray:
        if self.slots is None:
            return pc.fill_null(pc.index_in(column, self.keys), -1).to_numpy(zero_copy_only=False)
        key = column.fill_null(-1).to_numpy()
        inside = (key >= 0) & (key < len(self.slots))
        return np.where(inside, self.slots[np.where(inside, key, 0)], -1)


def _kind(kind: T.DataType) -> str | None:
    return "long" if isinstance(kind, T.IntegralType) else "string" if isinstance(kind, T.StringType) else "date" if isinstance(kind, T.DateType) else None


def _coded(columns: list[pa.ChunkedArray], n: int) -> tuple[np.ndarray, list[tuple]]:
    """Distinct rows of some columns and the position of each row among them; null is a value."""
    code, parts = np.zeros(n, np.int64), []
    for column in columns:
        held = column.combine_chunks().dictionary_encode("encode")
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        parts.append(held.dictionary.to_pylist())
        code = code * max(1, len(parts[-1])) + held.indices.to_numpy()
    distinct, at = np.unique(code, return_inverse=True)
    values = [() for _ in distinct]
    for part in reversed(parts):
        distinct, k = np.divmod(distinct, max(1, len(part)))
        values = [(part[i], *v) for i, v in zip(k.tolist(), values, strict=True)]
    return at, values


def lookup(dim: Dimension, kind: str) -> tuple[Lookup | None, str]:
    rows = dim.rows().filter(F.col(dim.dim_key).isNotNull())
    # one action gives rows, keys and attributes
    table = rows.select(F.col(dim.dim_key).cast(kind), *[F.col(a) for a in dim.attrs]).limit(MOST_ROWS + 1).toArrow()
    if table.num_rows > MOST_ROWS:
        return None, f"dimension of {dim.fact_key} has more than {MOST_ROWS} rows"
    key = table.column(0).combine_chunks()
    key = key if isinstance(key, pa.Array) else pa.concat_arrays(key.chunks)
    code, values = _coded(table.columns[1:], table.num_rows)
    held = key.dictionary_encode()
    by = np.argsort(held.indices.to_numpy(), kind="stable")
    begin = np.searchsorted(held.indices.to_numpy()[by], np.arange(len(held.dictionary) + 1))
    slots = None
    if kind == "long":
        keys = held.dictionary.to_numpy()
        if not len(keys) or (keys.min() >= 0 and keys.max() < max(1024, SPARSEST * len(keys))):
            slots = np.full(int(keys.max(initial=0)) + 1, -1, np.int32)
            slots[keys] = np.arange(len(keys))
    return Lookup(dim.fact_key, tuple(dim.attrs), slots, held.dictionary, begin.astype(np.int32), code[by].astype(np.int32), values), ""


class Sums:
    """Exact and double sums by group."""

    def __init__(self, groups: int):
        self.dense, self.groups, self.total = groups <= DENSE_GROUPS, groups, {}
        if self.dense:
            self.parts = [np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros(groups), np.zeros(groups, np.int64), np.zeros(groups, bool)]

    def add(self, group: np.ndarray, exact: np.ndarray, rest: np.ndarray, known: np.ndarray) -> None:
        for k in range(0, len(group), ROWS_AT_ONCE):
            self._add(*(x[k : k + ROWS_AT_ONCE] for x in (group, exact, rest, known)))

    def _add(self, group: np.ndarray, exact: np.ndarray, rest: np.ndarray, known: np.ndarray) -> None:
        names = None
        if not self.dense:
            names, group = np.unique(group, return_inverse=True)
        n = self.groups if names is None else len(names)
        high, low = exact >> 32, exact & 0xFFFFFFFF
        new = [np.bincount(group, high, n).astype(np.int64), np.bincount(group, low, n).astype(np.int64), np.bincount(group, rest, n), np.bincount(group, known, n).astype(np.int64)]
        if names is None:
            for had, more in zip(self.parts, new, strict=False):
                had += more
            self.parts[4][group] = True
        else:
            for k, h, w, r, c in zip(names.tolist(), *(x.tolist() for x in new), strict=True):
                had = self.total.setdefault(k, [0, 0.0, 0])
                had[0] += (h << 32) + w
                had[1] += r
                had[2] += c

    def batch(self) -> pa.RecordBatch:
        if self.dense:
            at = np.flatnonzero(self.parts[4])
            high, low, rest, known = (x[at].tolist() for x in self.parts[:4])
            rows = [(k, (h << 32) + w, r, c) for k, h, w, r, c in zip(at.tolist(), high, low, rest, known, strict=True)]
        else:
            rows = [(k, *v) for k, v in self.total.items()]
        exact = pa.array([Decimal(e) if c else None for _, e, _, c in rows], pa.decimal128(38, 0))
        rest = pa.array([r if c else None for _, _, r, c in rows], pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), exact, rest], names=["group", "exact", "rest"])


def one_pass(q: StarQuery) -> tuple[DataFrame | None, str]:
    """The aggregate, or None and the reason."""
    spark = q.fact.sparkSession
    offered = [a for d in q.dims for a in d.attrs]
    if other := [g for g in q.group_keys if g not in offered]:
        return None, f"group keys of the fact itself: {other}"
    measure = q.fact.schema[q.measure].dataType
    exact, rest = split(q.measure, measure, q.scale)
    scale = measure.scale if isinstance(measure, T.DecimalType) else q.scale or 0 if not isinstance(measure, T.IntegralType) else 0
    if isinstance(measure, T.DecimalType) and measure.precision > 18:
        return None, f"measure {q.measure} has more than 18 digits"
    lookups = []
    for d in q.dims:
        kinds = {_kind(q.fact.schema[d.fact_key].dataType), _kind(d.df.schema[d.dim_key].dataType)}
        if len(kinds) > 1 or None in kinds:
            return None, f"keys {d.fact_key} and {d.dim_key} are not of one kind (whole numbers, text or dates)"
        found, reason = lookup(d, kinds.pop())
        if found is None:
            return None, reason
        lookups.append(found)
    groups = 1
    for x in lookups:
        groups *= x.radix
    if groups > MOST_GROUPS:
        return None, f"{groups} groups"
    rows = q.fact if q.fact_predicate is None else q.fact.filter(q.fact_predicate)
    whole = F.lit(0).cast("long") if exact is None else (exact * F.lit(10**scale).cast("decimal(19,0)")).cast("long")
    if isinstance(measure, T.LongType):
        whole = F.col(q.measure)
    keys = [F.col(x.fact_key).cast(_kind(q.fact.schema[x.fact_key].dataType)).alias(f"k{i}") for i, x in enumerate(lookups)]
    importable(spark)
    shared = spark.sparkContext.broadcast(lookups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = shared.value, Sums(groups)
        for batch in batches:
            row, packed = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, x in enumerate(held):  # rows without a match go at once
                column = batch.column(i)
                place = x.places(column if len(row) == batch.num_rows else column.take(pa.array(row)))
                alive = place >= 0
                row, packed, place = row[alive], packed[alive], place[alive]
                begin = x.begin[place]
                times = x.begin[place + 1] - begin
                if (times > 1).any():  # repeated keys
                    begin = np.repeat(begin - (np.cumsum(times) - times), times) + np.arange(times.sum())
                    row, packed = np.repeat(row, times), np.repeat(packed, times)
                if x.attrs:
                    packed = packed * x.radix + x.codes[begin]
            value = batch.column(len(held))
            known = value.is_valid().to_numpy(zero_copy_only=False)[row]
            more = batch.column(len(held) + 1).fill_null(0.0).to_numpy()[row]
            sums.add(packed, value.fill_null(0).to_numpy()[row], more, known)
        yield sums.batch()

    more = F.lit(0.0) if rest is None else F.coalesce(rest, F.lit(0.0))
    known = F.when(F.col(q.measure).isNotNull(), whole).alias("whole")
    partial = rows.select(*keys, known, more.alias("more")).mapInArrow(run, "group long, exact decimal(38,0), rest double")
    value = (F.sum("exact") * F.lit(Decimal(1).scaleb(-scale))).cast("double") + F.sum("rest")
    if not q.group_keys:
        return partial.agg(value.alias(q.alias)), ""
    sums = partial.groupBy("group").agg(value.alias(q.alias)) if len(q.group_keys) == len(offered) else partial
    left = F.col("group")
    for i, x in reversed(list(enumerate(lookups))):  # unpack the group, last dimension first
        if x.attrs:
            sums = sums.withColumn(f"__c{i}", F.pmod(left, F.lit(x.radix))).withColumn(f"__r{i}", left)
            left = F.expr(f"__r{i} div {x.radix}")
    for i, (x, d) in enumerate(zip(lookups, q.dims, strict=True)):
        if x.attrs:
            fields = [T.StructField(f"__i{i}", T.LongType()), *(T.StructField(a, d.df.schema[a].dataType) for a in x.attrs)]
            names = spark.createDataFrame([(k, *v) for k, v in enumerate(x.values)], T.StructType(fields))
            sums = sums.join(F.broadcast(names), F.col(f"__c{i}") == F.col(f"__i{i}"))  # MOST_ROWS at most
    if len(q.group_keys) < len(offered):  # attributes that are not grouped by
        return sums.groupBy(*q.group_keys).agg(value.alias(q.alias)), ""
    return sums.select(*q.group_keys, q.alias), ""
