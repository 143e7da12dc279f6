"""Best-fit packing of token pieces into fixed-length sequences.

1. Every document is tokenized and cut into pieces of at most ``capacity`` ids (executors, Arrow
   blocks). Only (doc_id, piece, start, length, crc) is kept.
2. The histogram of piece lengths, at most ``capacity`` rows, goes to the driver.
3. A configuration linear program over the histogram (choose how often each filling of a sequence
   is used, so that every length is covered) is solved by multiplicative weights: a length's price
   rises while it is covered less than the others, and the filling that is worth most under the
   prices is found by a bounded knapsack recurrence, among those that leave no room if there are any.
   Multiplicities are rounded down to whole numbers as they are chosen, until every length is
   covered. Where best fit packs what the last fillings hold in fewer sequences, it does so: on a
   large table that is under a hundredth of the pieces. Prices also give a lower bound (``bound``).
4. The plan, bounded by the capacity and not by the data, is broadcast; pieces find their place by
   their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents, stored
from starfold.llm.blocks import texts
from starfold.llm.tokens import encoder

CAPACITY = 2048
CHUNK = 64
#: Of the prices: how strongly they follow what is not covered yet, and how much more long pieces weigh.
STRENGTH, LONG = 4.0, 2.0
#: Lengths that one recurrence looks at, drawn by price, and copies of each.
PRICED, COPIES = 384, 3
#: Shares of the fillings that plans keep; the rest is best fit.
SHARES = (1.0, 0.95, 0.9, 0.75, 0.5, 0.0)


# --- tokenizing ---------------------------------------------------------------


def _cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with so many ids: (document, piece, start, length). The first takes the remainder."""
    n = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    head = lengths - (n - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids_crc32); every text ends with id 0, null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for batch in batches:
            for rows, data, ends in texts(batch, "text"):
                ids, stops = codec.encode(data, ends)
                begins = np.concatenate([[0], stops[:-1]])
                doc, piece, start, length = _cut(stops - begins, capacity)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                at = begins[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


# --- planning on the histogram ------------------------------------------------


@dataclass
class Plan:
    """How often each filling is used. A filling: lengths, largest first.

    ``covered``, ``fitted``: pieces shorter than a sequence that the program's fillings and best fit
    hold; ``bound``: no packing has fewer sequences.
    """

    fillings: dict[tuple[int, ...], int] = field(default_factory=dict)
    covered: int = 0
    fitted: int = 0
    bound: int = 0

    def use(self, filling: tuple[int, ...], times: int) -> None:
        if times:
            self.fillings[filling] = self.fillings.get(filling, 0) + times

    @property
    def sequences(self) -> int:
        return sum(self.fillings.values())

    def places(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, rank after the last, first sequence, in each sequence, offset of the first)."""
        out, seen, base = [], {}, 0
        for filling, times in sorted(self.fillings.items(), reverse=True):
            at = 0
            for length in sorted(set(filling), reverse=True):
                k, lo = filling.count(length), seen.get(length, 0)
                out.append((length, lo, lo + k * times, base, k, at))
                seen[length] = lo + k * times
                at += k * length
            base += times
        return out


def price(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The filling of the largest value with at most ``left`` of each size, and the room it leaves.

    Fillings that leave no room come before others; among others value decides. Copies are taken in
    powers of two.
    """
    items = []
    for k in range(len(sizes) - 1, -1, -1):
        n, times = int(min(left[k], capacity // sizes[k])), 1
        while n > 0:
            times = min(times, n)
            items.append((k, times, int(sizes[k]) * times, float(values[k]) * times))
            n, times = n - times, 2 * times
    best = np.full(capacity + 1, -np.inf)  # of the fillings of exactly so many ids
    best[0] = 0
    taken = np.zeros((len(items), capacity + 1), bool)
    room = np.empty(capacity + 1)
    for row, (_, _, size, value) in enumerate(items):
        got = np.add(best[: capacity + 1 - size], value, out=room[size:])
        np.greater(got, best[size:], out=taken[row, size:])
        np.maximum(got, best[size:], out=best[size:])
    c = capacity if np.isfinite(best[capacity]) else int(np.argmax(best))
    filling, gap = {}, capacity - c
    for row in range(len(items) - 1, -1, -1):
        if taken[row, c]:
            k, times, size, _ = items[row]
            filling[k] = filling.get(k, 0) + times
            c -= size
    return filling, gap


def lower_bound(counts: dict[int, int], capacity: int, prices: dict[int, float] | None = None) -> int:
    """Sequences that any packing needs: the dual of the program under these prices, the lengths themselves, and one for each piece beyond half."""
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[s] for s in sizes.tolist()], np.int64)
    bound = max(-(-int(sizes @ need) // capacity), int(need[2 * sizes > capacity].sum()))
    if prices and len(sizes):
        value = np.array([prices.get(s, 0.0) for s in sizes.tolist()])
        best = np.zeros(capacity + 1)
        for c in range(1, capacity + 1):  # any number of copies: at least the value of the best filling
            k = int(np.searchsorted(sizes, c, "right"))
            best[c] = max(best[c - 1], (best[c - sizes[:k]] + value[:k]).max(initial=0.0))
        if best[capacity] > 0:
            bound = max(bound, int(np.ceil(float(value @ need) / best[capacity] - 1e-6)))
    return bound


def cover(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, float]]:
    """(fillings with how often they are used, in order; mean prices), by multiplicative weights.

    A filling is used as often as what is left of its lengths allows, so each step uses up a length
    or nearly so, and their number depends on the capacity, not on the counts. A filling leaves room
    only if none that is left doesn't.
    """
    sizes = np.array(sorted(counts), np.int64)
    need = np.array([counts[s] for s in sizes.tolist()], np.int64)
    left, rng, misses, out = need.copy(), np.random.default_rng(7), 0, []
    total, long = float(sizes @ need), LONG * sizes / capacity
    prices = np.zeros(len(sizes))
    while left.any():
        alive = np.flatnonzero(left)
        lag = left / need - float(sizes @ left) / total
        weight = np.exp(STRENGTH * lag + long)
        prices += weight / weight.sum()
        most = min(PRICED * (1 + misses), len(alive))
        at, copies = alive, capacity
        if most < len(alive):
            draw = rng.exponential(size=len(alive)) / weight[alive]
            at, copies = alive[np.sort(np.argpartition(draw, most)[:most])], COPIES
        found, gap = price(sizes[at] * weight[at], sizes[at], np.minimum(left[at], copies), capacity)
        if gap and len(at) < len(alive):
            misses += 1
            continue
        misses = max(0, misses - 1)
        filling = {int(at[k]): n for k, n in found.items()}
        times = int(min(left[k] // n for k, n in filling.items()))
        for k, n in filling.items():
            left[k] -= n * times
        out.append((tuple(sorted((int(sizes[k]) for k, n in filling.items() for _ in range(n)), reverse=True)), times))
    return out, dict(zip(sizes.tolist(), (sizes * prices).tolist(), strict=True))


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A plan that covers the histogram ``counts`` exactly.

    One plan is the whole cover; others keep one of SHARES of its fillings that leave no room, the first
    ones, and pack the rest best fit. The plan with the fewest sequences is chosen, among equals the
    one with the larger share.
    """
    short = {k: v for k, v in counts.items() if v > 0 and k < capacity}
    found, prices = cover(short, capacity)
    whole = [f for f in found if sum(f[0]) == capacity]
    plans = []
    for own in (found, *(whole[: round(share * len(whole))] for share in SHARES)):
        plan, rest = Plan(), dict(short)
        plan.use((capacity,), counts.get(capacity, 0))
        for filling, times in own:
            plan.use(filling, times)
            plan.covered += len(filling) * times
            for s in filling:
                rest[s] -= times
        plan.fitted = sum(rest.values())
        best_fit({k: v for k, v in rest.items() if v}, capacity, plan)
        plans.append(plan)
    best = min(plans, key=lambda p: p.sequences)
    best.bound = lower_bound(short, capacity, prices) + counts.get(capacity, 0)
    return best


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit, largest first, on a histogram: sequences of one filling are filled together."""
    gaps: dict[int, dict[tuple[int, ...], int]] = {}

    def put(filling: tuple[int, ...], gap: int, times: int) -> None:
        if times:
            at = gaps.setdefault(gap, {})
            at[filling] = at.get(filling, 0) + times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        for gap in sorted(g for g in gaps if g >= length):
            if not n:
                break
            for filling, times in sorted(gaps.pop(gap).items()):
                k = min(gap // length, max(n, 1))
                full = min(times, n // k)
                put(filling + (length,) * k, gap - k * length, full)
                n -= full * k
                times -= full
                if times and n and n < gap // length:
                    put(filling + (length,) * n, gap - n * length, 1)
                    times, n = times - 1, 0
                put(filling, gap, times)
        k = capacity // length
        put((length,) * k, capacity - k * length, n // k)
        if n % k:
            put((length,) * (n % k), capacity - (n % k) * length, 1)
    for at in gaps.values():
        for filling, times in at.items():
            plan.use(tuple(sorted(filling, reverse=True)), times)


# --- placing ------------------------------------------------------------------


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32, maybe more): adds sequence_id and offset.

    Repeated rows are counted first and spread again, so that copies of one document don't meet in a
    task. Ties within a length are broken by the row's values; an empty table gives no rows.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = solve(counts, capacity).places()
    blocks = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], "length long, lo long, hi long, base long, k long, at long")
    blocks = blocks.groupBy("length").agg(F.collect_list(F.struct("lo", "hi", "base", "k", "at")).alias("blocks"))
    cells = max(16, -(-max(counts.values(), default=0) // 50_000))
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = cut.groupBy(*own).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / CHUNK).cast("int"))))
    rows = rows.withColumn("n", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).cast("int"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*own, "chunk"), F.lit(cells)))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "cell").agg(F.sum("n").alias("rows")).withColumn("begin", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows")
    rows = rows.join(starts, ["length", "cell"]).join(F.broadcast(blocks), "length")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("rank", F.col("begin") + F.col("inside") + F.col("copy"))
    rows = rows.withColumn("b", F.filter("blocks", lambda b: (F.col("rank") >= b["lo"]) & (F.col("rank") < b["hi"]))[0])
    index = F.col("rank") - F.col("b.lo")
    return rows.select(*own, (F.col("b.base") + F.expr("(rank - b.lo) div b.k")).alias("sequence_id"), (F.col("b.at") + index % F.col("b.k") * F.col("length")).alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack every document; one row per piece."""
    return pack(stored(pieces(docs, tokenizer, capacity), "pieces"), capacity)
