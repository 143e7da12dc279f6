"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Term frequency is relative to the document's n-grams, inverse document frequency comes from the
sample. Weights are learnt by follow-the-regularised-leader with elastic-net penalties, and one
temperature is then fitted on a part of the sample that the weights have not seen. Learning uses
about SAMPLE rows at most, each language's share of them as even as its rows allow; prediction uses
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents
from starfold.llm.ngrams import grams, held_out, letters, parts, sample

ORDERS = (1, 2, 3)
BITS = 16
SAMPLE = 6_000
UNKNOWN = "und"
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3


def _features(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, slots, relative frequencies) of the sample's rows, in an order that only their values decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, windows in parts(batch, max(ORDERS) - 1):
                both, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for points, doc, seen in windows:
                    got = [(row << BITS) | slot for slot, row in grams(points, doc, ORDERS, BITS, seen)]
                    found, times = np.unique(np.concatenate(got), return_counts=True) if got else (both[:0], n[:0])
                    both, at = np.unique(np.concatenate([both, found]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n, times]), len(both)).astype(np.int64)
                at = np.searchsorted(both >> BITS, np.arange(1, own.num_rows))
                slots = [x.astype("<i4").tobytes() for x in np.split(both & ((1 << BITS) - 1), at)]
                counts = [x.astype("<i4").tobytes() for x in np.split(n, at)]
                yield pa.RecordBatch.from_arrays([own.column(own.schema.get_field_index("label")), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names=["label", "slots", "counts"])

    out = []
    for r in sorted(by_arrow(rows.select("text", "label"), run, "label string, slots binary, counts binary").collect()):  # the bounded sample
        slots, n = np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["counts"], "<i4")
        if len(slots):
            out.append((r["label"], slots, n / n.sum()))
    return out


class Model:
    """``rows``: the n-grams that have weights, ``weights``: theirs for each language (they hold the idf)."""

    def __init__(self, names: list[str], rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.names, self.rows, self.weights, self.bias, self.temperature = names, rows, weights, bias, temperature

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << BITS, max(len(self.names), 1)))
        out[self.rows] = self.weights
        return out

    def chances(self, raw: np.ndarray) -> np.ndarray:
        z = (raw + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(made: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model:
    names = sorted({x[0] for x in made})
    k, size = len(names), 1 << BITS
    if k < 2:
        return Model(names, np.zeros(0, np.int64), np.zeros((0, max(k, 1))), np.zeros(max(k, 1)))
    df = np.zeros(size)
    for _, slots, _ in made:
        df[slots] += 1
    idf = np.log((1 + len(made)) / (1 + df)) + 1
    order = np.random.default_rng(seed).permutation(len(made))
    cut = max(1, len(made) // 5)
    kept, seen = order[:cut], order[cut:] if len(made) > 10 else order
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(rows: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in np.random.default_rng(seed).permutation(seen):
            name, slots, share = made[i]
            rows, x = np.append(slots, size), np.append(share * idf[slots] * 10, 1.0)
            w = weights(rows)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[names.index(name)] -= 1
            slope = x[:, None] * p[None]
            step = (np.sqrt(n[rows] + slope**2) - np.sqrt(n[rows])) / ALPHA
            z[rows] += slope - step * w
            n[rows] += slope**2
    w = weights(np.arange(size + 1))
    full = w[:-1] * idf[:, None] * 10
    held = np.flatnonzero((full != 0).any(1))
    model = Model(names, held, full[held], w[-1])
    raw = np.array([made[i][2] @ full[made[i][1]] for i in kept])
    right = np.array([names.index(made[i][0]) for i in kept])

    def loss(t: float) -> float:
        return -np.log(Model(names, held, full[held], model.bias, t).chances(raw)[np.arange(len(right)), right] + 1e-12).mean()

    model.temperature = min((float(t) for t in np.geomspace(0.1, 10, 81)), key=loss)
    return model


def predict(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Adds the language and its chance to every row of ``docs``, as columns of these names, which must be new.

    Null and empty texts, those without a letter, and all if nothing was learnt: `und` and 0. Null ids
    and repeated rows are rows like others; ties go to the first language by name; long texts are
    looked at in windows; an empty table gives no rows.
    """
    if taken := {name, score} & set(docs.columns):
        raise ValueError(f"there are columns {sorted(taken)} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weights = np.ascontiguousarray(m.dense().T)
        names = np.array([*m.names, UNKNOWN], object)
        for batch in batches:
            for own, windows in parts(batch, max(ORDERS) - 1):
                n = own.num_rows
                raw, total, known = np.zeros((n, len(weights))), np.zeros(n), np.zeros(n, bool)
                for points, doc, seen in windows:
                    for slot, row in grams(points, doc, ORDERS, BITS, seen):
                        total += np.bincount(row, minlength=n)
                        for c, w in enumerate(weights):
                            raw[:, c] += np.bincount(row, w[slot], n)
                    known |= letters(points, doc, n)
                chance = m.chances(raw / np.maximum(total, 1)[:, None])
                known &= len(m.names) > 0
                best = np.where(known, chance.argmax(1), len(m.names))
                got = np.round(np.where(known, chance.max(1), 0.0), 9)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(names[best], pa.string()), pa.array(got)], names=[*own.schema.names, name, score])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_arrow(docs, run, f"{kinds}, `{name}` string, `{score}` double")


def learn(docs: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from rows of ``docs`` (doc_id, text, lang) that are not held out and have a language.

    Null ids are left out; null texts are empty; repeated ids count once, with the last of their
    languages by name. An empty table teaches nothing.
    """
    return fit(_features(sample(docs, docs.select("doc_id", "lang"), "lang", most)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
