"""How fast storage delivers Parquet files: their size, one stream, and several at once."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.session import importable
from starfold.sources.tables import collection

MOST_FILES = 16
PIECE = 1 << 20


def files(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) of the Parquet files under ``base``; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(base)
    return found.select("path", "length")


def _stream(spark: SparkSession, path: str) -> tuple[int, float]:
    """Bytes and seconds of one stream of PIECE reads in the driver, through the store's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    began, store = time.perf_counter(), at.getFileSystem(conf)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(store.open(at), jvm.java.io.OutputStream.nullOutputStream(), PIECE, True)
    return int(store.getFileStatus(at).getLen()), time.perf_counter() - began


def _streams(spark: SparkSession, paths: list[str]) -> tuple[int, float]:
    """The same for several files at once, each a task of its own on the executors (stores that Arrow's file systems open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                uri = path.replace("s3a://", "s3://")
                store, name = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
                n = 0
                with store.open_input_stream(name, buffer_size=0) as stream:
                    while piece := stream.read(PIECE):
                        n += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    importable(spark)
    began = time.perf_counter()
    named = spark.range(0, len(paths), 1, len(paths)).select(F.element_at(F.array(*map(F.lit, paths)), (F.col("id") + 1).cast("int")).alias("path"))
    return int(named.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0), time.perf_counter() - began


def probe(spark: SparkSession, base: str) -> dict:
    found = files(spark, base)
    n, size = found.agg(F.count("*"), F.sum("length")).first()
    if not n:
        raise ValueError(f"no Parquet file under {base}")
    sample = [r["path"] for r in found.orderBy("path").limit(MOST_FILES).collect()]
    one, one_s = _stream(spark, sample[0])
    many, many_s = _streams(spark, sample)
    rate = lambda b, s: {"bytes": b, "seconds": s, "mb_s": b / 1e6 / s, "mbit_s": 8 * b / 1e6 / s}
    return {"files": n, "bytes": int(size), "one": rate(one, one_s), "parallel": rate(many, many_s) | {"files": len(sample)}}


def stat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes) of local files, looked up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([os.stat(p).st_size for p in names], pa.int64())], names=["path", "bytes"])

    importable(spark)
    return collection(spark, paths).mapInArrow(run, "path string, bytes long")
