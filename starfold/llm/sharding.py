"""Fixed virtual slots: records hash into thousands of slots; a versioned map sends slots to shards.

The slot of a record never changes. Only the map does, and it has one row per slot, so it is
bounded whatever the input. It is kept under a path, a folder for each version: balancing anew and
growing load the last version, edit a few thousand rows, and store the next one.
DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.llm._common import documents, shared_dir, stored

SLOTS = 4096
#: Repeats of one row are dealt to slots in chunks of so many.
CHUNK = 64
#: Rows of a slot that are numbered together, about.
CELL_ROWS = 50_000
#: How far a shard may be above the mean bytes before the map is balanced.
SLACK = 0.05


def grouped(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows by (doc_id, size, text_crc32), with their slot.

    Equal rows are counted before the shuffle; the copies of one row go to slots in chunks of
    CHUNK, so a row that is a third of the table spreads over all slots.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    chunk = F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / CHUNK).cast("int")))
    rows = rows.withColumn("chunk", chunk).withColumn("n", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK).cast("int"))
    key = F.xxhash64("doc_id", "text_crc32", "size", "chunk")
    return rows.select("doc_id", "size", "text_crc32", "chunk", "n", F.pmod(key, F.lit(slots)).cast("int").alias("vslot"), F.xxhash64(key, F.lit(7)).alias("mix"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones too."""
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    sums = rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    return every.join(sums, "vslot", "left").na.fill(0, ["bytes", "rows"])


def _dealt(pool: DataFrame, loads: DataFrame) -> DataFrame:
    """(vslot, shard) for the slots of ``pool`` (vslot, bytes): largest first, each to the shard that is lightest by then.

    ``loads``: (shard, load) to begin with. One row holds all slots and one all shards (fixed
    numbers), so the greedy pass is one ``aggregate``.
    """
    slot, load = "struct<bytes:long,vslot:int>", "struct<load:long,shard:int>"
    every = pool.select(F.struct(F.col("bytes").cast("long"), "vslot").cast(slot).alias("slot"), F.lit(None).cast(load).alias("load"))
    every = every.unionByName(loads.select(F.lit(None).cast(slot).alias("slot"), F.struct("load", "shard").cast(load).alias("load")))
    held = every.agg(F.sort_array(F.collect_list("slot"), asc=False).alias("slots"), F.sort_array(F.collect_list("load")).alias("loads"))
    lightest = "a.loads[0]"
    greedy = f"""aggregate(slots,
        named_struct('loads', loads, 'map', cast(array() as array<struct<vslot:int,shard:int>>)),
        (a, x) -> named_struct(
            'loads', array_sort(concat(slice(a.loads, 2, greatest(size(a.loads), 1)), array(named_struct('load', {lightest}.load + x.bytes + 1, 'shard', {lightest}.shard)))),
            'map', concat(a.map, array(named_struct('vslot', x.vslot, 'shard', {lightest}.shard)))),
        a -> a.map)"""
    return held.select(F.inline(F.expr(greedy)))


def _shards(spark: SparkSession, shards: int) -> DataFrame:
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map, for slots (vslot, bytes, rows): vslot, bytes, rows, shard, version."""
    return sizes.join(_dealt(sizes, _shards(sizes.sparkSession, shards)), "vslot").select(F.lit(1).alias("version"), "vslot", "shard", "bytes", "rows")


def balanced_map(last: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, for new sizes: shards above the mean give their small slots, up to their excess, to the lightest."""
    last = last.select("version", "vslot", "shard").join(sizes, "vslot")
    inside = Window.partitionBy("shard")
    so_far = F.sum("bytes").over(inside.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    excess = F.sum("bytes").over(inside) - F.sum("bytes").over(Window.partitionBy("version")) / shards
    marked = last.withColumn("goes", so_far <= excess)
    kept = marked.filter("NOT goes").groupBy("shard").agg(F.sum("bytes").alias("had"))
    loads = _shards(sizes.sparkSession, shards).join(kept, "shard", "left").select("shard", F.coalesce("had", "load").alias("load"))
    moved = _dealt(marked.filter("goes"), loads).withColumnRenamed("shard", "to")
    return marked.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows")


def store_map(version: DataFrame, path: str) -> DataFrame:
    """Add a version of the map under ``path``; one that is there already is never overwritten."""
    k = version.select("version").first()[0]
    version.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={k}")
    return load_map(version.sparkSession, path, k)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the map under ``path``, the last if none is named; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    found = [int(f.getPath().getName().split("=")[1]) for f in store.listStatus(at) if f.getPath().getName().startswith("version=")]
    if not found:
        return None
    kinds = "version int, vslot int, shard int, bytes long, rows long"
    return spark.read.schema(kinds).parquet(f"{path.rstrip('/')}/version={version or max(found)}").withColumn("version", F.lit(version or max(found)))


def grow(spark: SparkSession, path: str) -> DataFrame:
    """Store and return the next version of the map under ``path``: one shard more, which alone takes slots."""
    last = load_map(spark, path)
    return store_map(grown_map(last, last.agg(F.max("shard")).first()[0] + 1), path)


def grown_map(last: DataFrame, shards: int) -> DataFrame:
    """The next version, for one more shard: every shard gives its small slots, up to its excess, to the new one only."""
    total = F.sum("bytes").over(Window.partitionBy("version")) / (shards + 1)
    inside = Window.partitionBy("version", "shard")
    load = F.sum("bytes").over(inside)
    so_far = F.sum("bytes").over(inside.orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    moves = so_far <= load - total
    return last.select((F.col("version") + 1).alias("version"), "vslot", F.when(moves, shards).otherwise(F.col("shard")).cast("int").alias("shard"), "bytes", "rows")


def current_map(sizes: DataFrame, shards: int, path: str, slack: float = SLACK) -> DataFrame:
    """The map to use for slots of these sizes: the last one under ``path``, edited and stored anew where it must be.

    Without a map, the first; with fewer shards than asked for, grown shard by shard; with a shard of
    more than 1 + ``slack`` times the mean bytes, balanced.
    """
    spark = sizes.sparkSession
    last = load_map(spark, path)
    if last is None:
        return store_map(first_map(sizes, shards), path)
    while (had := last.agg(F.max("shard")).first()[0] + 1) < shards:
        last = grow(spark, path)
    if had > shards:
        raise ValueError(f"the map has {had} shards, more than {shards}")
    loads = last.select("vslot", "shard").join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes").alias("load"))
    most, total = loads.agg(F.max("load"), F.sum("load")).first()
    if most > (1 + slack) * total / shards:
        last = store_map(balanced_map(last, sizes, shards), path)
    return last


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None, slack: float = SLACK) -> tuple[DataFrame, str]:
    """Place every row of ``docs`` (doc_id, text); returns (placed rows, the path of the map).

    Placed rows: doc_id, size, text_crc32, vslot, shard, slot (place in the shard, gapless from 0).
    The map under ``path`` is used and edited as ``current_map`` says; without a path a new one is
    kept in the shared folder. Shards have nearly equal bytes, as far as single rows allow. Null text
    counts as empty; null doc_ids and repeated rows are rows like others; an empty table gives no
    rows; other columns are ignored.
    """
    path = path or f"{shared_dir(docs.sparkSession).rstrip('/')}/slot-map-{uuid.uuid4().hex}"
    rows = stored(grouped(docs, slots), "shard-rows")
    sizes = stored(slot_sizes(rows, slots), "slot-sizes")
    used = current_map(sizes, shards, path, slack).select("vslot", "shard")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    cells = max(1, -(-total // (slots * CELL_ROWS)))
    rows = rows.withColumn("cell", F.pmod("mix", F.lit(cells)))
    at = Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_crc32", "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(at), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("vslot", "cell").agg(F.sum("n").alias("n")).join(F.broadcast(used), "vslot")  # one row for each slot
    counts = counts.select("vslot", "cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = rows.join(counts, ["vslot", "cell"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("inside") + F.col("copy")).cast("long").alias("slot")), path


def lit_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, path = shard(documents(spark, sf_dir))
    grown = grow(spark, path).select("vslot", F.col("shard").alias("next_shard"))
    placed = placed.join(F.broadcast(grown), "vslot")  # one row for each slot
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", lit_null("int").alias("grown_shard"), "vslot", "next_shard")
