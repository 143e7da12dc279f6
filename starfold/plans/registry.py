"""Queries of the star engine for the driver, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starfold.model import STRATEGIES
from starfold.operators.star import eager, prepare, star_aggregate
from starfold.plans import queries as Q
from starfold.session import scratch
from starfold.sources import adapt, sinks, tables
from starfold.tools import datagen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The adapted star as views for DuckDB; put before a query's SQL.
STAR_SQL = r"""WITH places AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
customer AS (SELECT c.c_custkey, n_name AS c_nation, r_name AS c_region FROM main.customer c JOIN places ON c.c_nationkey = n_nationkey),
supplier AS (SELECT s.s_suppkey, r_name AS s_region FROM main.supplier s JOIN places ON s.s_nationkey = n_nationkey),
part AS (SELECT p.p_partkey, 'MFGR#' || ((CAST(substr(p.p_brand, 7) AS INTEGER) - 1) % 5 + 1) AS p_mfgr FROM main.part p),
date_dim AS (SELECT DISTINCT CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d_datekey, CAST(year(o_orderdate) AS INTEGER) AS d_year FROM orders),
lineorder AS (SELECT o_custkey AS lo_custkey, l_suppkey AS lo_suppkey, l_partkey AS lo_partkey,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS lo_orderdate,
  l_extendedprice AS amount, CAST(year(o_orderdate) AS INTEGER) AS lo_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
lineorder_by_year AS (SELECT * FROM lineorder)
"""


def _add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


#: The fact by year is written once for a session and its input, when a query first asks for it.
_by_year: dict[tuple[str, str], str] = {}


def _tables(spark: SparkSession, sf_dir: str, by_year: bool = False) -> dict[str, DataFrame]:
    t = adapt.star(spark, sf_dir)
    if by_year:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _by_year:
            path = scratch(spark, "lineorder_by_year")
            sinks.partition_fact(t["lineorder"], path)
            _by_year[key] = path
        t["lineorder_by_year"] = spark.read.schema(t["lineorder"].schema).parquet(_by_year[key])
    return t


def _star(name: str, strategy: str, spark: SparkSession, sf_dir: str, repartition: int | None = None) -> DataFrame:
    return prepare(Q.query(name, _tables(spark, sf_dir, name == "q5")), strategy, repartition).df


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(_tables(spark, sf_dir, "lineorder_by_year" in text))
    return spark.sql(text)


for _q in Q.NAMES:
    for _s in STRATEGIES:
        _add(f"{_q}_{_s}", partial(_star, _q, _s), STAR_SQL + Q.SQL[_q])
for _q in Q.NAMES:
    _add(f"{_q}_sql", partial(_sql, Q.SQL[_q]), STAR_SQL + Q.SQL[_q])
for _q in Q.NAMES:
    _keys = ["d_year", "c_nation", *(["p_mfgr"] if _q == "q3" else [])]
    _add(f"{_q}_ordered", lambda s, d, q=_q, k=tuple(_keys): _star(q, "auto", s, d).orderBy(*k), STAR_SQL + Q.SQL[_q] + " ORDER BY " + ", ".join(_keys))
_add("q1_repartitioned", partial(_star, "q1", "broadcast", repartition=16), STAR_SQL + Q.SQL["q1"])
_add("q1_eager", lambda s, d: eager(Q.query("q1", _tables(s, d))), STAR_SQL + Q.SQL["q1"])
_add("verify_summary", partial(_sql, Q.VERIFY), STAR_SQL + Q.VERIFY)
_add("verification_sum", partial(_sql, Q.VERIFICATION_SUM), STAR_SQL + Q.VERIFICATION_SUM)


def _partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.partition_counts(_tables(spark, sf_dir, True)["lineorder_by_year"], "lo_year")


_add("partition_counts", _partition_counts, STAR_SQL + "SELECT lo_year, count(*) AS n_rows FROM lineorder_by_year GROUP BY lo_year")


def _scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(_tables(spark, sf_dir))
    return tables.count_of(spark, "lineorder")


_add("scalar_subquery_count", _scalar_subquery, STAR_SQL + "SELECT (SELECT count(*) FROM lineorder) AS n_rows")


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _tables(spark, sf_dir)["customer"].select("c_nation").distinct()
    return values.select("c_nation", (F.row_number().over(Window.orderBy("c_nation")) - 1).cast("long").alias("code"))


_add("dim_dictionary", _dictionary, STAR_SQL + "SELECT c_nation, CAST(row_number() OVER (ORDER BY c_nation) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT c_nation FROM customer)")


def _key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _tables(spark, sf_dir)["customer"].agg(F.max(key).alias("max_key"), F.count("*").alias("n_rows"), (F.count("*") / (F.max(key) + 1)).alias("density"))


_add("dim_key_stats", _key_stats, STAR_SQL + "SELECT max(c_custkey) AS max_key, count(*) AS n_rows, count(*) / CAST(max(c_custkey) + 1 AS DOUBLE) AS density FROM customer")


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    only = t["supplier"].filter(F.col("s_region") == Q.REGION)
    return t["lineorder"].join(only, F.col("lo_suppkey") == F.col("s_suppkey"), "left_semi").agg(F.count("*").alias("n_rows"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


_add("dim_semi_presence", _presence, STAR_SQL + "SELECT count(*) AS n_rows, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineorder WHERE lo_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_region = 'AMERICA')")


def _all_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    digits = lambda df, c: df.agg(F.bool_and(F.col(c).cast("string").rlike("^[0-9]+$")).alias("all_digits")).select(F.lit(c).alias("attribute"), "all_digits")
    return digits(t["date"], "d_year").unionByName(digits(t["customer"], "c_nation"))


_add("attribute_digits", _all_digits, STAR_SQL + "SELECT 'd_year' AS attribute, bool_and(regexp_matches(CAST(d_year AS VARCHAR), '^[0-9]+$')) AS all_digits FROM date_dim UNION ALL SELECT 'c_nation', bool_and(regexp_matches(c_nation, '^[0-9]+$')) FROM customer")


def _in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["part"].filter(F.col("p_mfgr").isin(*Q.MFGRS)).groupBy("p_mfgr").agg(F.count("*").alias("n_rows"))


_add("dim_in_list", _in_list, STAR_SQL + "SELECT p_mfgr, count(*) AS n_rows FROM part WHERE p_mfgr IN ('MFGR#1', 'MFGR#2') GROUP BY p_mfgr")


def _generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any dimensions, attributes and measure: here customer segment and supplier region over quantity."""
    from starfold.model import Dimension

    t = adapt.star(spark, sf_dir)
    items = adapt.table(spark, sf_dir, "lineitem")
    orders = adapt.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    dims = [Dimension(orders, "l_orderkey", "o_orderkey", ["o_orderpriority"], unique=True), Dimension(t["supplier"], "l_suppkey", "s_suppkey", ["s_region"], unique=True)]
    return star_aggregate(items, dims, ["o_orderpriority", "s_region", "l_returnflag"], "l_quantity", alias="quantity")


_add("star_generic", _generic, STAR_SQL + "SELECT o_orderpriority, s_region, l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")



def _measured(column: str, strategy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with four decimals, beyond 18 digits, whole and wide decimal ones: nothing is rounded away."""
    from starfold.model import Dimension

    items = adapt.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", f"{MEASURES[column][0]} AS {column}")
    dims = [Dimension(adapt.star(spark, sf_dir)["supplier"], "l_suppkey", "s_suppkey", ["s_region"], unique=True)]
    return star_aggregate(items, dims, ["s_region"], column, strategy)


_UNITS = "CAST(l_quantity AS BIGINT)"  # sums of these are exact in doubles, in any order
MEASURES = {
    "four_decimals": (f"CAST({_UNITS} AS DOUBLE) / 1024", f"SUM(CAST({_UNITS} AS DOUBLE) / 1024)"),
    "very_large": (f"CAST({_UNITS} AS DOUBLE) * 1099511627776 * 1048576", f"SUM(CAST({_UNITS} AS DOUBLE) * 1099511627776 * 1048576)"),
    "whole": (f"{_UNITS} * 1000000000000000", f"CAST(SUM(CAST({_UNITS} AS HUGEINT) * 1000000000000000) AS DOUBLE)"),
    "wide_decimal": (f"CAST({_UNITS} AS DECIMAL(20,0)) * CAST('1000.0001' AS DECIMAL(8,4))", f"CAST(SUM({_UNITS} * CAST('1000.0001' AS DECIMAL(18,4))) AS DOUBLE)"),
}
for _m, (_, _s) in MEASURES.items():
    for _x in STRATEGIES:
        _add(f"sum_{_m}_{_x}", partial(_measured, _m, _x), STAR_SQL + f"SELECT s_region, {_s} AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_region")


def _any_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over text, negative and repeated keys."""
    from starfold.model import Dimension

    items = adapt.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), (-1 - F.col("l_partkey")).alias("below"), "l_linenumber", "l_quantity")
    suppliers = adapt.star(spark, sf_dir)["supplier"].select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("s_name"), "s_region")
    parts_ = adapt.star(spark, sf_dir)["part"].select((-1 - F.col("p_partkey")).alias("p_below"), "p_mfgr")
    twice = spark.range(1, 6).select(F.col("id").alias("line"), F.explode(F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b").otherwise("a"))).alias("half"))
    dims = [Dimension(suppliers, "name", "s_name", ["s_region"]), Dimension(parts_, "below", "p_below", ["p_mfgr"]), Dimension(twice, "l_linenumber", "line", ["half"])]
    return star_aggregate(items, dims, ["s_region", "p_mfgr", "half"], "l_quantity", "onepass", alias="quantity")


_add("onepass_any_keys", _any_keys, STAR_SQL + """SELECT s_region, p_mfgr, half, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN (SELECT id AS line, unnest(['a', CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END]) AS half FROM range(1, 6) t(id)) ON l_linenumber = line GROUP BY ALL""")


def _written(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write and read back, in several layouts."""
    part = _tables(spark, sf_dir)["part"]
    path = scratch(spark, f"sink-{kind}")
    if kind == "files":
        sinks.write(part, path, files=3)
        return tables.file_counts(spark.read.parquet(path), ".parquet")
    if kind == "table":
        name = "starfold_" + path.rsplit("-", 1)[-1]
        sinks.save_table(part, name, sort_by=["p_mfgr"])
        made = spark.table(name).groupBy("p_mfgr").agg(F.count("*").alias("n_rows"))
        rows = made.collect()  # five groups; the table goes again
        sinks.drop_table(spark, name)
        return spark.createDataFrame(rows, made.schema)
    if kind == "dims":
        datagen.generate(spark, path, _SIZES, files=2)
        datagen.generate(spark, path, replace(_SIZES, rows=5, suppliers=7), dims_only=True)
        read = lambda n: tables.read(spark, path, n).select(F.lit(n).alias("name"))
        return read("supplier").unionByName(read("lineorder")).groupBy("name").agg(F.count("*").alias("n_rows"))
    sinks.write(part, path, sort_by=["p_mfgr"], partition_by=["p_mfgr"] if kind == "partitioned" else ())
    sinks.run_only(part)
    return tables.partition_counts(tables.checked(spark.read.parquet(path)), "p_mfgr")


_BY_MFGR = STAR_SQL + "SELECT p_mfgr, count(*) AS n_rows FROM part GROUP BY p_mfgr"
_add("sink_clustered", partial(_written, "clustered"), _BY_MFGR)
_add("sink_partitioned", partial(_written, "partitioned"), _BY_MFGR)
_add("sink_table", partial(_written, "table"), _BY_MFGR)
_add("sink_files", partial(_written, "files"), "SELECT CAST(3 AS BIGINT) AS n_files, count(*) AS n_rows FROM part")
_add("sink_dims_only", partial(_written, "dims"), "SELECT 'supplier' AS name, CAST(7 AS BIGINT) AS n_rows UNION ALL SELECT 'lineorder', 2000")
_add("collection_source", lambda s, d: tables.collection(s, ["a", "b", "b"]).groupBy("path").agg(F.count("*").alias("n_rows")), "SELECT path, count(*) AS n_rows FROM (VALUES ('a'), ('b'), ('b')) t(path) GROUP BY path")
_add("fact_partitions", lambda s, d: s.createDataFrame([(_star_fact(s, d).rdd.getNumPartitions(),)], "n long"), "SELECT CAST(7 AS BIGINT) AS n")


def _star_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)["lineorder"].repartition(7)


_ROWS = 2_000
_SIZES = datagen.Sizes(customers=300, suppliers=100, parts=200, days=2556, rows=_ROWS)


def _generated(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.tables(spark, _SIZES)[name]


def _drawn_sql(name: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('{_SIZES.seed}:{name}:' || id), 1, 12) AS BIGINT) % {n} AS BIGINT)"


def _list_sql(values, index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} % {len(values)} + 1]"


_add("generated_customer", partial(_generated, "customer"), f"SELECT id AS c_custkey, {_list_sql(datagen.NATIONS, 'id')} AS c_nation, {_list_sql(datagen.REGIONS, 'id')} AS c_region FROM range({_SIZES.customers}) t(id)")
_add("generated_supplier", partial(_generated, "supplier"), f"SELECT id AS s_suppkey, {_list_sql(datagen.REGIONS, 'id')} AS s_region FROM range({_SIZES.suppliers}) t(id)")
_add("generated_part", partial(_generated, "part"), f"SELECT id AS p_partkey, {_list_sql(datagen.MFGRS, 'id')} AS p_mfgr FROM range({_SIZES.parts}) t(id)")
_add("generated_date", partial(_generated, "date"), f"SELECT id AS d_datekey, CAST(id // 365 + 1992 AS INTEGER) AS d_year FROM range({_SIZES.days}) t(id)")
_add(
    "generated_fact",
    partial(_generated, "lineorder"),
    "SELECT " + ", ".join(f"{_drawn_sql(c, n)} AS {c}" for c, n in datagen.keys(_SIZES)) + f", CAST({_drawn_sql('amount', 10_000)} + 1 AS DOUBLE) AS amount FROM range({_ROWS}) t(id)",
)

_TIMES = (("broadcast", 1.5), ("broadcast", 1.0), ("broadcast", 1.25), ("merge", 3.0), ("merge", 2.5), ("merge", 2.75), ("merge", 2.0))


def _bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starfold.tools.summarize import summary

    return summary(spark.createDataFrame(list(_TIMES), "strategy string, seconds double"), ["strategy"])


_add("bench_summary", _bench_summary, "SELECT strategy, count(*) AS n_runs, median(seconds) AS median_s, min(seconds) AS min_s, max(seconds) AS max_s FROM (VALUES " + ", ".join(f"('{a}', CAST({b} AS DOUBLE))" for a, b in _TIMES) + ") t(strategy, seconds) GROUP BY strategy")

