"""Rewrite the fact partitioned by year, for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.operators.star import small
from starfold.sources import sinks, tables


def rewrite(spark: SparkSession, base: str, out_name: str = "lineorder_by_year") -> DataFrame:
    """Write ``base``/lineorder by lo_year; returns rows per partition. Raises if rows were lost."""
    fact, days = tables.read(spark, base, "lineorder"), tables.read(spark, base, "date")
    days = days.hint("broadcast") if small(days) else days
    by_year = fact.join(days, F.col("lo_orderdate") == F.col("d_datekey"), "left").withColumnRenamed("d_year", "lo_year").drop("d_datekey")
    sinks.partition_fact(by_year, f"{base}/{out_name}")
    made = tables.partition_counts(spark.read.parquet(f"{base}/{out_name}"), "lo_year")
    before, after = fact.count(), made.agg(F.sum("n_rows")).first()[0] or 0
    if before != after:
        raise RuntimeError(f"{after} of {before} rows written")
    return made.orderBy("lo_year")
