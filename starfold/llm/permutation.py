"""Approximate nearest neighbours with a permutation index.

Vectors are represented by their nearest pivots in order. The index is kept in blocks of rows; each
block has an inverted file: for every pivot, the vectors that have it among their nearest PREFIX,
and at which place. A query adds up the footrule distance of the two orders over the postings of its
own pivots; the vectors that come first in footrule order, about ``candidates(n)`` of n rows over all
blocks, are reranked by true distance. What lies beyond is not looked at: results are approximate,
with a recall that tests measure (0.9 is asked for). ``exact`` adds a second pass instead: distances
to pivots bound the true distance from below (triangle inequality), and every vector whose bound does
not exceed the last distance found is reranked too.

Queries are cut into chunks and meet each block once, so a task holds one block and one chunk; what a
query costs in a block is its postings, not the vectors. Vectors of each length have their own
pivots and blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm._common import documents, importable, stored

PIVOTS = 256
PREFIX = 64
NEAREST = 10
#: Rows that a query reranks: FACTOR * rows ** POWER, LEAST at least.
FACTOR, POWER, LEAST = 2.0, 2 / 3, 1024
BLOCK_ROWS = 16_384
CHUNK_ROWS = 8_192


def candidates(n: int, least: int = LEAST) -> int:
    """How many of n rows a query reranks."""
    return min(n, max(least, int(FACTOR * n**POWER)))


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, embedding, n) that take part: not null, not zero, all components finite numbers; n is the length.

    Repeats of a row count once.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & v.isNotNull())
    return rows.filter(finite & F.exists(v, lambda x: x != 0)).dropDuplicates(["vec_id", "embedding"]).withColumn("n", F.size("embedding"))


def pivots(rows: DataFrame, counts: dict[int, int], n: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each length ``n`` vectors, chosen by a hash of the vector: a sample that the number of rows does not change."""
    if not counts:
        return {}
    share = rows.sparkSession.createDataFrame([(k, min(1.0, 4 * n / c)) for k, c in counts.items()], "n int, share double")
    some = rows.join(F.broadcast(share), "n").withColumn("h", F.xxhash64("embedding"))  # one row for each length
    some = some.filter(F.pmod("h", F.lit(1 << 30)) <= F.col("share") * (1 << 30)).select("n", "h", "embedding").distinct()
    first = F.row_number().over(Window.partitionBy("n").orderBy("h", "embedding"))
    got = some.withColumn("k", first).filter(F.col("k") <= n).orderBy("n", "k").select("n", "embedding").collect()  # n for each length
    return {k: np.array([r["embedding"] for r in got if r["n"] == k], float) for k in {r["n"] for r in got}}


def orders(x: np.ndarray, pivot: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances to pivots, the nearest ``prefix`` pivots in order; ties to the smaller)."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivot.T + (pivot**2).sum(1)[None], 0))
    return d, np.argsort(d, axis=1, kind="stable")[:, :prefix]


class Block:
    """The inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, prefix: int):
        self.ids, self.x, self.pivot, self.prefix = ids, x, pivot, min(prefix, len(pivot))
        self.to_pivot, near = orders(x, pivot, self.prefix)
        row = np.repeat(np.arange(len(x)), self.prefix)
        place = np.tile(np.arange(self.prefix), len(x))
        by = np.argsort(near.ravel(), kind="stable")
        self.row, self.place = row[by], place[by]
        self.begin = np.searchsorted(near.ravel()[by], np.arange(len(pivot) + 1))

    def footrules(self, near: np.ndarray) -> np.ndarray:
        """Footrule distances of a query's pivot order to all vectors; a missing pivot stands at place ``prefix``."""
        m = self.prefix
        total = np.full(len(self.x), m * (m + 1), np.int64)
        for place, p in enumerate(near.tolist()):
            own = slice(self.begin[p], self.begin[p + 1])
            total[self.row[own]] += np.abs(self.place[own] - place) - (m - self.place[own]) - (m - place)
        return total

    def search(self, qid: int, q: np.ndarray, d: np.ndarray, near: np.ndarray, k: int, most: int, exact: bool) -> list[tuple[int, float]]:
        score = self.footrules(near)
        own = np.flatnonzero(self.ids != qid)
        order = own
        if most < len(own):
            order = own[np.sort(np.argpartition(score[own] * len(score) + own, most)[:most])]  # ties to the row that comes first
        best = self._nearest(q, order, np.zeros(0, np.int64), np.zeros(0), k)
        if exact and most < len(own):
            rest = np.setdiff1d(own, order, assume_unique=True)
            reach = best[1][-1] if len(best[1]) >= k else np.inf
            bound = np.abs(self.to_pivot[rest] - d[None]).max(1)
            best = self._nearest(q, rest[bound <= reach + 1e-6 * (1 + d.max())], *best, k)
        return list(zip(self.ids[best[0]].tolist(), best[1].tolist(), strict=True))

    def _nearest(self, q: np.ndarray, rows: np.ndarray, had: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rough = ((self.x[rows] - q) ** 2).sum(1)
        most, every = 4 * k, rows
        while most < len(every):  # exact order only where it can matter
            rows = every[rough <= np.partition(rough, most)[most] * (1 + 1e-9)]
            if len(np.unique(self.ids[rows])) >= k:
                break
            most, rows = 4 * most, every
        score = np.concatenate([scores, np.sqrt(np.cumsum((self.x[rows] - q) ** 2, axis=1)[:, -1])])  # added in order, as a plain loop would
        rows = np.concatenate([had, rows])
        by = np.lexsort((score, self.ids[rows]))
        first = np.ones(len(by), bool)
        first[1:] = self.ids[rows[by[1:]]] != self.ids[rows[by[:-1]]]
        by = by[first]  # of an id's vectors the nearest
        by = by[np.lexsort((self.ids[rows[by]], score[by]))][:k]
        return rows[by], score[by]


def nearest(df: DataFrame, queries: DataFrame, k: int = NEAREST, n_pivots: int = PIVOTS, prefix: int = PREFIX, least: int = LEAST, exact: bool = False) -> DataFrame:
    """For each vec_id of ``queries`` (vec_id, embedding) the k nearest vec_ids of ``df`` other than itself.

    Returns query_id, rank, vec_id, score. Fewer than k candidates: all of them. Ties go to the
    smaller vec_id. Rows that take no part (see ``taking_part``) are neither queries nor candidates;
    vectors of different lengths are never compared. Rows equal in both columns count once; different
    vectors of one vec_id are one query and one candidate, their distance the smallest. An empty
    table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    importable(spark)
    rows, asked = stored(taking_part(df), "vectors"), stored(taking_part(queries), "asked")
    counts = {r["n"]: r["rows"] for r in rows.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # one for each length
    wanted = {r["n"]: r["rows"] for r in asked.groupBy("n").agg(F.count("*").alias("rows")).collect()}
    shared = spark.sparkContext.broadcast(pivots(rows, counts, n_pivots))
    dealt = [(n, max(1, -(-c // BLOCK_ROWS)), max(1, -(-wanted[n] // CHUNK_ROWS)), candidates(c, least) / c) for n, c in counts.items() if n in wanted]
    dealt = F.broadcast(spark.createDataFrame(dealt, "n int, blocks int, chunks int, share double"))  # one row for each length
    own = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).cast("int").alias("block")
    left = rows.join(dealt, "n").select("n", "share", "vec_id", "embedding", own, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.col("chunks")).cast("int").alias("chunk")
    right = asked.join(dealt, "n").select("n", "vec_id", "embedding", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        column = t.column("embedding").combine_chunks()
        flat = (column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)).flatten().to_numpy()
        x = flat.reshape(len(ids), -1)
        by = np.lexsort((*x.T[::-1], ids))
        return ids[by], x[by]

    def run(block: pa.Table, chunk: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if block.num_rows and chunk.num_rows:
            ids, x = matrix(block)
            pivot = shared.value[x.shape[1]]
            index = Block(ids, x, pivot, prefix)
            most = max(4 * k, int(np.ceil(block.column("share")[0].as_py() * len(ids))))
            qids, q = matrix(chunk)
            for first in range(0, len(q), 512):
                d, near = orders(q[first : first + 512], pivot, index.prefix)
                for i in range(len(d)):
                    qid = int(qids[first + i])
                    out += [(qid, v, s) for v, s in index.search(qid, q[first + i], d[i], near[i], k, most, exact)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    keys = ["n", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


#: Whole tables of LEAST rows or fewer are reranked, so there the exact answer is the index's.
ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
m AS (SELECT query_id, vec_id, min(score) AS score FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM m)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
