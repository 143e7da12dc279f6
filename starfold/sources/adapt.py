"""The driver's TPC-H-like tables as a star: lineitem and orders are the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.functions.scalar import day_number, mfgr_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """customer, supplier, part, date and lineorder (with lo_year), as lazy projections and joins."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    places = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by definition
    customer = t["customer"].join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("c_nation"), F.col("r_name").alias("c_region"))
    supplier = t["supplier"].join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("s_region"))
    part = t["part"].select("p_partkey", mfgr_of("p_brand").alias("p_mfgr"))
    days = t["orders"].select(day_number("o_orderdate").alias("d_datekey"), F.year("o_orderdate").alias("d_year")).distinct()
    orders = t["orders"].select("o_orderkey", "o_custkey", day_number("o_orderdate").alias("lo_orderdate"), F.year("o_orderdate").alias("lo_year"))
    fact = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("lo_custkey"), F.col("l_suppkey").alias("lo_suppkey"), F.col("l_partkey").alias("lo_partkey"),
        "lo_orderdate", F.col("l_extendedprice").alias("amount"), "lo_year",
    )
    return {"customer": customer, "supplier": supplier, "part": part, "date": days, "lineorder": fact}
