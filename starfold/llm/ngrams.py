"""Hashed character n-grams of blocks of texts, and samples of labelled rows to learn from."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.llm._common import stored
from starfold.llm.blocks import texts
from starfold.llm.tokens import LETTER, classes

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(1)
def lower() -> np.ndarray:
    """Lower case of every code point that has one of a single code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        small = chr(c).lower()
        if len(small) == 1:
            out[c] = ord(small)
    return out


#: A longer text is looked at in windows of about so many bytes.
WINDOW = 1_000_000


def grams(points: np.ndarray, doc: np.ndarray, orders: tuple[int, ...], bits: int, seen: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (slot, document) of all n-grams that lie within one document. Lower-cased.

    ``seen``: so many code points at the start belong to the window before; n-grams inside them are left out.
    """
    x = lower()[points].astype(np.uint64) + np.uint64(1)
    key = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, max(orders) + 1):
        if len(x) < n:
            return
        key = key[: len(x) - n + 1] * _STEP + x[n - 1 :]
        if n in orders:
            whole = doc[: len(key)] == doc[n - 1 :]
            whole[: max(0, seen - n + 1)] = False
            mixed = key[whole] + np.uint64(n)
            mixed ^= mixed >> np.uint64(29)
            yield ((mixed * _MIX) >> np.uint64(64 - bits)).astype(np.int64), doc[: len(key)][whole]


def _points(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        stops = ends
    else:
        stops = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[ends]
    return points, np.repeat(np.arange(len(ends)), np.diff(stops, prepend=0))


def _windows(data: bytes, ends: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(code points, row of each, how many of them the window before had too)."""
    if len(ends) > 1 or len(data) <= 2 * WINDOW:
        yield *_points(data, ends), 0
        return
    a, before = 0, np.zeros(0, np.uint32)  # one long text
    while a < len(data):
        b = min(len(data), a + WINDOW)
        while b < len(data) and data[b] & 0xC0 == 0x80:
            b += 1
        own = np.concatenate([before, _points(data[a:b], np.array([b - a]))[0]])
        yield own, np.zeros(len(own), np.int64), len(before)
        a, before = b, own[len(own) - min(overlap, len(own)) :]


def parts(batch: pa.RecordBatch, overlap: int, size: int = 250_000) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray, int]]]]:
    """(rows, windows over their texts: code points, the row of each, how many the window before had too).

    Short texts are one window together; a long one has windows of its own that overlap, so memory does
    not grow with its n-grams.
    """
    for rows, data, ends in texts(batch, "text", size):
        yield rows, _windows(data, ends, overlap)


def letters(points: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n documents has a letter."""
    return np.bincount(doc[classes()[points] == LETTER], minlength=n) > 0


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def held_out() -> Column:
    return F.coalesce(remainder() == 1, F.lit(False))


def sample(docs: DataFrame, rows: DataFrame, label: str, most: int, tasks: int = 6) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows of ``docs``, in a stored table of few partitions.

    ``rows``: (doc_id, label); null ids and labels and rows held out are left out, an id's label is its
    largest and its text the least of its texts, so repeated rows count once. Up to ``most`` ids all
    are learnt from. Beyond, every label has the same quota, and what a rare label leaves free goes to
    the others (labels beyond the ``most`` commonest are not learnt). A hash of the id decides, so the
    number of rows is ``most`` but for chance. An empty table gives none.
    """
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).alias("label"))
    # only ids that have a text here; counted copies, so that repeated rows do not meet
    here = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    rows = stored(rows.join(here, "id", "left_semi"), "labelled")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most).collect()
    share, left = [], most
    for k, (name, n) in enumerate(reversed([(r["label"], r["n"]) for r in sizes])):
        quota = left // (len(sizes) - k)
        share.append((name, min(1.0, quota / n)))
        left -= min(n, quota)
    kind = rows.schema["label"].dataType.simpleString()
    parts_of = docs.sparkSession.createDataFrame(share, f"name {kind}, part double")
    chosen = rows.join(F.broadcast(parts_of), F.col("label") == F.col("name"))  # one row for each label, ``most`` at most
    chosen = chosen.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < F.col("part") * 1_000_000).select("id", "label")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")  # about ``most`` rows
    named = named.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return stored(named.repartition(tasks, "id").select("text", "label"), "sample")
