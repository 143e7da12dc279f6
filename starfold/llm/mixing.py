"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Within a source every document is expected ``rate`` times. Documents stand in order of size, the
expected copies are prefix-summed, one random offset per source is added, and a document is taken
once for each integer boundary that its interval crosses: floor(rate) or ceil(rate) times. In size
order the sample is stratified by size, so the words taken come near the target.

The prefix sum of a source is never one task's work: equal rows are counted and dealt in chunks to
cells (source, size bin, residue), offsets of cells come from the counts, and only ranks inside a cell
need its rows. The offset of a source is the one of TRIES random numbers with which the words taken
come nearest its target: one sum per number, so that sources of few documents come near, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm._common import documents, stored, whole_row, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
TRIES = 16
#: Equal rows in a chunk, residues of a size bin at least, and rows of the table for each further residue.
CHUNK, RESIDUES, RESIDUE_ROWS = 64, 16, 1_000_000


def size_bin(size: Column) -> Column:
    """Exact below 64, then 32 bins for each doubling; integers only, so that any engine agrees."""
    bits = F.length(F.bin(size))
    return F.when(size < 64, size).otherwise(bits * 64 + F.expr("shiftright(size, greatest(length(bin(size)) - 6, 0))")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    target = min(most * source_size, level * weight), at the one level where targets add up to the
    whole: what the excess above the limits, reshared by weight again and again, comes to.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("k", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") - 1) % n + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    steps = ranked.withColumn("level", (whole - before) / rest).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    return steps.select("source", "source_size", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def offset(source: Column, seed: int, k: int) -> Column:
    """A number in [0, 1) that only the source, the seed and k decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.coalesce(source, F.lit("\x00null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def _taken(start: Column, n: Column, rate: Column, u: Column) -> Column:
    """Integer boundaries that so many rows from ``start`` on cross."""
    return (F.floor((start + n) * rate + u) - F.floor(start * rate + u)).cast("long")


def placed(rows: DataFrame, seed: int = SEED, tries: int = TRIES, **rule) -> DataFrame:
    """(source, size, doc_id, n, maybe more columns that tell rows apart), n equal rows each, to chunks with their place.

    Adds chunk; n is the chunk's. Adds source_size, target, rate, u (the source's offset) and start
    (rows of the source before the chunk).
    """
    own = [c for c in rows.columns if c not in ("source", "size", "doc_id", "n")]
    total = rows.agg(F.sum("n")).first()[0] or 0
    residues = max(RESIDUES, total // RESIDUE_ROWS)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / CHUNK).cast("int"))))
    rows = rows.withColumn("n", F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).cast("long"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("chunk").cast("string")).cast("binary"))
    rows = rows.withColumn("bin", size_bin(F.col("size"))).withColumn("sub", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % residues)
    inside = Window.partitionBy("source", "bin", "sub").orderBy("size", "doc_id", *own, "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))), "mix-rows")
    cells = rows.groupBy("source", "bin", "sub").agg(F.sum("n").alias("cell_n"), F.sum(F.col("size") * F.col("n")).alias("cell_size"))
    cells = stored(cells, "mix-cells")
    goals = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), **rule)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.select(F.col("source").alias("g"), "source_size", "target", rate.alias("rate"))
    up_to = Window.partitionBy("source").orderBy("bin", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("sub").alias("r"), F.coalesce(F.sum("cell_n").over(up_to), F.lit(0)).alias("before"))
    starts = starts.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")) & (F.col("sub") == F.col("r")))
    rows = rows.withColumn("start", F.col("before") + F.col("inside")).select("source", "size", "doc_id", "n", *own, "chunk", "source_size", "target", "rate", "start")
    words = [F.sum(_taken(F.col("start"), F.col("n"), F.col("rate"), offset(F.col("source"), seed, k)) * F.col("size")).alias(f"w{k}") for k in range(tries)]
    off = [F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), offset(F.col("source"), seed, k).alias("u")) for k in range(tries)]
    best = rows.groupBy("source", "target").agg(*words).select(F.col("source").alias("g"), F.array_min(F.array(*off))["u"].alias("u"))
    return rows.join(best, F.col("source").eqNullSafe(F.col("g"))).drop("g")


def mix(docs: DataFrame, size: Column | None = None, seed: int = SEED, **rule) -> DataFrame:
    """Take documents (doc_id, text, source) so that the sources have their target sizes.

    Returns doc_id, source, size, source_size, target, copies, taken. Null text has size 0; null
    source is a source of its own, the last; null doc_ids and repeated rows are rows like others;
    an empty table or one without words takes nothing. Reruns agree: order and offset come from
    values alone. Rows equal in source, size and doc_id are interchangeable.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (word_count(F.col("text")) if size is None else size).alias("size"))
    rows = stored(rows.groupBy("source", "size", "doc_id").agg(F.count("*").alias("n")), "mix-sizes")
    rows = placed(rows, seed, **rule).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    rows = rows.withColumn("copies", _taken(F.col("start") + F.col("copy"), F.lit(1), F.col("rate"), F.col("u")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, seed: int = SEED, **rule) -> DataFrame:
    """``docs`` (doc_id, text, source, maybe more columns) with every row as often as the mix takes it.

    Rows equal in all columns are counted and kept once; chunks of their copies meet a copy of the row
    each, so that a row that is a third of the table is written by many tasks. Nulls, empty texts and
    empty tables as in ``mix``.
    """
    row = whole_row(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), row.alias("row"))
    rows = rows.select("*", F.xxhash64(F.to_json("row"), F.lit(1)).alias("h1"), F.xxhash64(F.to_json("row"), F.lit(2)).alias("h2"))
    firsts = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "row")]
    once = stored(rows.groupBy("h1", "h2").agg(*firsts, F.count("*").alias("n")), "mix-distinct")
    taken = placed(once.select("source", "size", "doc_id", "n", "h1", "h2"), seed, **rule)
    taken = taken.select("h1", "h2", F.expr(f"chunk div {CHUNK}").alias("salt"), _taken(F.col("start"), F.col("n"), F.col("rate"), F.col("u")).alias("copies")).filter("copies > 0")
    spread = once.select("h1", "h2", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK * CHUNK}"))).alias("salt"))
    out = taken.join(spread, ["h1", "h2", "salt"])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH rows AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
chunks AS (SELECT *, (row_number() OVER (PARTITION BY source, size, doc_id) - 1) // 64 AS chunk FROM rows),
cells AS (
  SELECT *, CASE WHEN size < 64 THEN size ELSE length(bin(size)) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) END AS b,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || chunk), 1, 8) AS BIGINT) % greatest(16, (SELECT count(*) FROM rows) // 1000000) AS s FROM chunks),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS k FROM sources),
weighed AS (SELECT *, CAST([3.0, 1.0, 2.0][(k - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM ranked),
steps AS (
  SELECT *, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT max(level) FROM steps WHERE level <= ratio), 0.0) * weight) AS target FROM steps),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, s, size, doc_id NULLS FIRST, chunk) AS j FROM cells),
tries AS (
  SELECT source, k, CAST(CAST('0x' || substr(md5('17:' || k || ':' || coalesce(source, chr(0) || 'null')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS u
  FROM sources, range(16) t(k)),
rates AS (
  SELECT o.source, o.doc_id, o.size, g.source_size, g.target, o.j, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate
  FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source),
sums AS (
  SELECT t.source, t.k, t.u, abs(CAST(sum(CAST(floor(j * rate + u) - floor((j - 1) * rate + u) AS BIGINT) * size) AS BIGINT) - target) AS off
  FROM rates r JOIN tries t ON r.source IS NOT DISTINCT FROM t.source GROUP BY t.source, t.k, t.u, target),
best AS (SELECT source, u FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, k) AS i FROM sums) WHERE i = 1)
SELECT doc_id, size, source_size, target,
       CAST(floor(j * rate + u) - floor((j - 1) * rate + u) AS BIGINT) * size AS taken,
       CAST(floor(j * rate + u) - floor((j - 1) * rate + u) AS BIGINT) AS copies
FROM rates r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
"""
