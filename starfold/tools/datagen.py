"""A seeded star generator. Foreign keys are drawn independently of each other: one digest per seed, column and row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions.scalar import drawn, picked, year_of_day
from starfold.sources import sinks

# The names that queries and results use.
REGIONS = ("AMERICA", "ASIA", "EUROPE", "AFRICA", "MIDDLE EAST")
MFGRS = ("MFGR#1", "MFGR#2", "MFGR#3", "MFGR#4", "MFGR#5")
NATIONS = (
    "ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "CHINA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ",
    "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "ROMANIA", "RUSSIA", "SAUDI ARABIA", "UNITED KINGDOM", "UNITED STATES", "VIETNAM",
)


@dataclass(frozen=True)
class Sizes:
    customers: int = 3_000_000
    suppliers: int = 200_000
    parts: int = 1_400_000
    days: int = 2_556
    rows: int = 600_000_000
    seed: int = 1


def keys(n: Sizes) -> list[tuple[str, int]]:
    """(column of the fact, its domain)."""
    return [("lo_custkey", n.customers), ("lo_suppkey", n.suppliers), ("lo_partkey", n.parts), ("lo_orderdate", n.days)]


def fact(spark: SparkSession, n: Sizes, files: int | None = None) -> DataFrame:
    """range makes as many even partitions as asked for: no shuffle is needed for even files."""
    ids = spark.range(0, n.rows, 1, files) if files else spark.range(n.rows)
    row = F.col("id")
    return ids.select(*[drawn(row, n.seed, c, k).alias(c) for c, k in keys(n)], (drawn(row, n.seed, "amount", 10_000) + 1).cast("double").alias("amount"))


def tables(spark: SparkSession, n: Sizes, files: int | None = None) -> dict[str, DataFrame]:
    """All five tables, lazily."""
    row = F.col("id")
    return {
        "customer": spark.range(n.customers).select(row.alias("c_custkey"), picked(NATIONS, row).alias("c_nation"), picked(REGIONS, row).alias("c_region")),
        "supplier": spark.range(n.suppliers).select(row.alias("s_suppkey"), picked(REGIONS, row).alias("s_region")),
        "part": spark.range(n.parts).select(row.alias("p_partkey"), picked(MFGRS, row).alias("p_mfgr")),
        "date": spark.range(n.days).select(row.alias("d_datekey"), year_of_day(row).alias("d_year")),
        "lineorder": fact(spark, n, files),
    }


def generate(spark: SparkSession, out: str, n: Sizes, files: int = 96, dims_only: bool = False) -> None:
    """Write the star under ``out``. ``dims_only`` leaves the fact as it is."""
    for name, df in tables(spark, n, files).items():
        if name != "lineorder" or not dims_only:
            sinks.write(df, f"{out}/{name}")
