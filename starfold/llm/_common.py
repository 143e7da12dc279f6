"""What the operators of this subpackage share: durable intermediate tables and small expressions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of one Arrow batch on its way to a Python worker, about.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (tests) gets a folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="starfold-")
        spark.conf.set("spark.checkpoint.dir", found)
        _made.append((spark, found))
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    """Intermediate tables live as long as the driver: a lazy result may still read them."""
    for spark, path in _made:
        try:
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, PERF203  the session may be over
            pass


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package also where PYTHONPATH doesn't name it, and get small batches unless the session says otherwise."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def by_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers give back what a task needed when it ends.

    Workers are reused by later tasks and stages; without this they would keep the most that any
    task of theirs ever took.
    """
    importable(df.sparkSession)

    def bounded(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it clash with none of them."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``df`` has it (case aside)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
