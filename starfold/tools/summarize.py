"""Medians of benchmark records: JSON lines, grouped by the whole configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIGURATION = ("query", "strategy", "repartition", "cores", "sf")


def summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    s = F.col("seconds")
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), F.expr("percentile(seconds, 0.5)").alias("median_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"))


def summarize(spark: SparkSession, path: str, drop_first: bool = True) -> DataFrame:
    """Read records (CONFIGURATION, run, seconds) and compare strategies with the fastest of their query."""
    runs = spark.read.schema("query string, strategy string, repartition int, cores int, sf string, run int, seconds double").json(path)
    made = summary(runs.filter(F.col("run") > 0) if drop_first else runs, CONFIGURATION)
    best = made.groupBy("query", "sf").agg(F.min("median_s").alias("best_s"))
    return made.join(F.broadcast(best), ["query", "sf"]).withColumn("ratio", F.col("median_s") / F.col("best_s")).drop("best_s")
