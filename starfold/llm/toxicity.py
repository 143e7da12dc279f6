"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams. With p and q the smoothed counts of toxic and other
documents that hold a feature, its scale is r = log((p/|p|) / (q/|q|)). A logistic regression is
fitted on the scaled features, both labels weighing the same; features whose counts do not differ by
MIN_Z standard errors have scale 0. Learning uses about SAMPLE labelled rows at most, each label's
share of them as even as its rows allow; scoring uses every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents
from starfold.llm.ngrams import grams, held_out, parts, sample

ORDERS = (3, 4, 5)
BITS = 20
SAMPLE = 8_000
MIN_Z = 4.0
MIN_TOXIC = 3
THRESHOLD = 0.7


def _present(points: np.ndarray, doc: np.ndarray, keep: np.ndarray | None = None, seen: int = 0) -> np.ndarray:
    """Distinct document << BITS | slot of all orders, sorted; ``keep``: only slots that are marked."""
    found = []
    for slot, row in grams(points, doc, ORDERS, BITS, seen):
        if keep is not None:
            of = keep[slot]
            slot, row = slot[of], row[of]
        found.append((row << BITS) | slot)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def features(windows: Iterator[tuple[np.ndarray, np.ndarray, int]], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, slot) over all windows of some rows."""
    both = np.zeros(0, np.int64)
    for points, doc, seen in windows:
        found = _present(points, doc, keep, seen)
        both = np.union1d(both, found) if len(both) else found
    return both >> BITS, both & ((1 << BITS) - 1)


def counts(rows: DataFrame) -> DataFrame:
    """(slot, toxic documents, other documents) over ``rows`` (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for own, windows in parts(batch, max(ORDERS) - 1):
                label = np.asarray(own.column(own.schema.get_field_index("label"))).astype(int)
                row, slot = features(windows)
                for k in (0, 1):
                    seen[k] += np.bincount(slot[label[row] == k], minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], names=["slot", "toxic", "other"])

    made = by_arrow(rows.select("text", "label"), run, "slot long, toxic long, other long")
    return made.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit(rows: DataFrame, steps: int = 400, l2: float = 2e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from ``rows`` (text, label 0/1): (slots, their weights times their scales, intercept)."""
    n = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.int64), np.zeros(0), 20.0 if n1 else -20.0
    rate = (F.col("toxic") + F.col("other")) / (n1 + n0)
    z = (F.col("toxic") / n1 - F.col("other") / n0) / F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = counts(rows).filter((F.abs(z) >= MIN_Z) & (F.col("toxic") + F.col("other") >= MIN_TOXIC)).orderBy("slot").collect()  # at most 2 ** BITS
    slots = np.array([r["slot"] for r in chosen], np.int64)
    p, q = (np.array([r[k] for r in chosen], float) for k in ("toxic", "other"))
    scale = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    keep = np.zeros(1 << BITS, bool)
    keep[slots] = True
    shared = rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, windows in parts(batch, max(ORDERS) - 1):
                row, slot = features(windows, shared.value)
                held = np.split(slot, np.searchsorted(row, np.arange(1, own.num_rows)))
                yield pa.RecordBatch.from_arrays([own.column(own.schema.get_field_index("label")).cast(pa.int32()), pa.array([h.astype("<i4").tobytes() for h in held], pa.binary())], names=["label", "slots"])

    made = by_arrow(rows.select("text", "label"), run, "label int, slots binary").collect()  # the sample, without its texts
    y = np.array([r["label"] for r in made], float)
    held = [np.frombuffer(r["slots"], "<i4") for r in made]
    order = sorted(range(len(held)), key=lambda i: (made[i]["slots"], y[i]))  # whatever the order of partitions
    y, held = y[order], [held[i] for i in order]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    column = np.searchsorted(slots, np.concatenate(held)) if len(slots) else np.zeros(0, np.int64)
    x = scale[column]
    even = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    w, b = np.zeros(len(slots)), 0.0
    m, v = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for step in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[column], len(y)) + b, -30, 30)))
        off = (score - y) * even
        slope = np.append(np.bincount(column, x * off[row], len(slots)) / len(y) + l2 * w, off.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    shared.destroy()
    return slots, w * scale, float(b)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "toxic_score") -> DataFrame:
    """Adds a score (0 to 1) to every row of ``docs``, as column ``name``, which must be new.

    Null and empty texts get the intercept's score; null ids and repeated rows are rows like others;
    long texts are looked at in windows; an empty table gives no rows.
    """
    slots, weights, intercept = model
    if name in docs.columns:
        raise ValueError(f"there is a column {name!r} already")
    shared = docs.sparkSession.sparkContext.broadcast((slots, weights, intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, base = shared.value
        weight, keep = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[slots], keep[slots] = weights, True
        for batch in batches:
            for own, windows in parts(batch, max(ORDERS) - 1):
                row, slot = features(windows, keep)
                raw = np.bincount(row, weight[slot], own.num_rows) + base
                got = np.round(1 / (1 + np.exp(-np.clip(raw, -40, 40))), 9)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(got)], names=[*own.schema.names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_arrow(docs, run, f"{kinds}, `{name}` double")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from the labelled rows of ``docs`` that are not held out.

    Rows with a null id or label are left out; null texts are empty; repeated ids count once, with
    their largest label. Without rows of both labels every score is near that of the one there is
    (0, if there is none).
    """
    return fit(sample(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic", most))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, documents(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
