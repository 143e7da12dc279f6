"""The five benchmark queries, as specifications and as SQL text over the star's views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starfold.model import Dimension, StarQuery

NAMES = ("q1", "q2", "q3", "q4", "q5")
PRUNE_YEAR = 1997
REGION = "AMERICA"
MFGRS = ("MFGR#1", "MFGR#2")


def query(name: str, t: dict[str, DataFrame]) -> StarQuery:
    """Q1: four dimensions. Q2: two region predicates. Q3: an IN-list and a third key. Q4: two dimensions. Q5: one year of a fact partitioned by year."""
    if name not in NAMES:
        raise ValueError(f"unknown query {name!r}; one of {', '.join(NAMES)}")
    region = lambda c: F.col(c) == REGION if name == "q2" else None
    dims = [
        Dimension(t["customer"], "lo_custkey", "c_custkey", ["c_nation"], region("c_region"), unique=True),
        Dimension(t["date"], "lo_orderdate", "d_datekey", ["d_year"], unique=True),
    ]
    keys = ["d_year", "c_nation"]
    if name != "q4":
        dims.append(Dimension(t["supplier"], "lo_suppkey", "s_suppkey", [], region("s_region"), unique=True))
        only = F.col("p_mfgr").isin(*MFGRS) if name == "q3" else None
        dims.append(Dimension(t["part"], "lo_partkey", "p_partkey", ["p_mfgr"] if name == "q3" else [], only, unique=True))
    if name == "q3":
        keys.append("p_mfgr")
    fact = t["lineorder_by_year"] if name == "q5" else t["lineorder"]
    return StarQuery(fact, dims, keys, "amount", fact_predicate=F.col("lo_year") == PRUNE_YEAR if name == "q5" else None)


_SUM = "CAST(SUM(CAST(lo.amount AS DECIMAL(18,2))) AS DOUBLE) AS total"
_FOUR = """JOIN customer c ON lo.lo_custkey = c.c_custkey
JOIN supplier s ON lo.lo_suppkey = s.s_suppkey
JOIN part p ON lo.lo_partkey = p.p_partkey
JOIN date_dim d ON lo.lo_orderdate = d.d_datekey"""

SQL = {
    "q1": f"SELECT d.d_year, c.c_nation, {_SUM} FROM lineorder lo {_FOUR} GROUP BY d.d_year, c.c_nation",
    "q2": f"SELECT d.d_year, c.c_nation, {_SUM} FROM lineorder lo {_FOUR} WHERE c.c_region = '{REGION}' AND s.s_region = '{REGION}' GROUP BY d.d_year, c.c_nation",
    "q3": f"SELECT d.d_year, c.c_nation, p.p_mfgr, {_SUM} FROM lineorder lo {_FOUR} WHERE p.p_mfgr IN ('MFGR#1', 'MFGR#2') GROUP BY d.d_year, c.c_nation, p.p_mfgr",
    "q4": f"SELECT d.d_year, c.c_nation, {_SUM} FROM lineorder lo JOIN customer c ON lo.lo_custkey = c.c_custkey JOIN date_dim d ON lo.lo_orderdate = d.d_datekey GROUP BY d.d_year, c.c_nation",
    "q5": f"SELECT d.d_year, c.c_nation, {_SUM} FROM lineorder_by_year lo {_FOUR} WHERE lo.lo_year = {PRUNE_YEAR} GROUP BY d.d_year, c.c_nation",
}

#: Groups and sums of the first four, one row each.
VERIFY = " UNION ALL ".join(f"SELECT '{q}' AS q, count(*) AS n_groups, CAST(sum(CAST(total AS DECIMAL(38,2))) AS DOUBLE) AS check_sum FROM ({SQL[q]})" for q in NAMES[:4])

#: The measure over all joins, without groups.
VERIFICATION_SUM = f"SELECT CAST(SUM(CAST(lo.amount AS DECIMAL(18,2))) AS DOUBLE) AS verification_sum FROM lineorder lo {_FOUR}"
