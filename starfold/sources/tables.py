"""Sources: star tables with declared schemas, partitioned tables, views and collections."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = {
    "customer": "c_custkey long, c_nation string, c_region string",
    "supplier": "s_suppkey long, s_region string",
    "part": "p_partkey long, p_mfgr string",
    "date": "d_datekey long, d_year int",
    "lineorder": "lo_custkey long, lo_suppkey long, lo_partkey long, lo_orderdate long, amount double",
    "lineorder_by_year": "lo_custkey long, lo_suppkey long, lo_partkey long, lo_orderdate long, amount double, lo_year int",
}
#: SQL names of tables whose names are words of SQL.
VIEWS = {"date": "date_dim"}


def read(spark: SparkSession, base: str, name: str, pattern: str | None = None) -> DataFrame:
    """A star table under ``base`` (local or object store), its schema declared: opening it runs no job."""
    reader = spark.read.schema(STAR[name])
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(f"{base.rstrip('/')}/{name}")


def read_star(spark: SparkSession, base: str, by_year: bool = False) -> dict[str, DataFrame]:
    names = [n for n in STAR if n != "lineorder_by_year" or by_year]
    return {n: read(spark, base, n) for n in names}


def checked(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``df`` that fails when it is read, if a null is among ``columns`` (all, if none are named)."""
    held = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in column {c}"))).otherwise(F.col(c)) for c in columns or df.columns}
    return df.select(*[held[c].alias(c) if c in held else F.col(c) for c in df.columns])


def file_counts(df: DataFrame, suffix: str = "") -> DataFrame:
    """(n_files, n_rows) of the files that ``df`` reads and whose names end with ``suffix``."""
    return df.select(F.col("_metadata.file_name").alias("f")).filter(F.col("f").endswith(suffix)).agg(F.count_distinct("f").alias("n_files"), F.count("*").alias("n_rows"))


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views for SQL text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(VIEWS.get(name, name))


def collection(spark: SparkSession, values: Iterable[str], name: str = "path") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def count_of(spark: SparkSession, view: str) -> DataFrame:
    """The row count of a view as an uncorrelated scalar subquery."""
    return spark.sql(f"SELECT (SELECT count(*) FROM {view}) AS n_rows")


def partition_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"))
