"""Sinks: Parquet in several layouts, catalog tables, the no-op sink and JSON records."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, files: int | None = None, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), max_rows: int | None = None) -> None:
    """Overwrite ``path``. ``files``: how many; ``sort_by``: order within files, so that readers skip row groups."""
    df = df.repartition(files) if files else df
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    out = df.write.mode("overwrite")
    out = out.option("maxRecordsPerFile", max_rows) if max_rows else out
    out = out.partitionBy(*partition_by) if partition_by else out
    out.parquet(path)


def partition_fact(fact: DataFrame, path: str, key: str = "lo_year", tasks: int | None = None, max_rows: int = 50_000_000) -> DataFrame:
    """Rewrite a fact by ``key``.

    Each value of the key is dealt to several tasks, so one of them is no bottleneck; a task writes the
    few values it has, and files have at most ``max_rows`` rows.
    """
    spark = fact.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(*fact.columns), F.lit(max(1, tasks // 4)))
    write(fact.repartition(tasks, F.col(key), spread), path, partition_by=[key], max_rows=max_rows)
    return spark.read.schema(fact.schema).parquet(path)


def save_table(df: DataFrame, name: str, sort_by: Sequence[str] = ()) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def run_only(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def record(path: str, **values) -> None:
    """Append one JSON line."""
    with open(path, "a") as f:
        f.write(json.dumps(values) + "\n")
