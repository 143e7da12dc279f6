"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The star is written once, outside the timing, as a star schema is loaded once. Every timed run plans
anew (Spark would reuse the shuffle files of an executed DataFrame) and counts planning, the building
of dimensions and the scan; strategies take turns; the first of RUNS is dropped; a query's figure is
the median, and ``setup`` the part of it before the scan. Results are compared row by row first. With
$BENCH_RECORDS every run is appended to that file, for `python -m starfold summarize`.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from starfold.operators.star import prepare
from starfold.plans import queries as Q
from starfold.session import make_session, scratch
from starfold.sources import adapt, sinks, tables
from starfold.tools.verify import same

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "4"))
STRATEGIES = ("broadcast", "auto", "shuffle_hash", "merge", "onepass")


def load(spark) -> dict:
    """The star of SF_DIR as Parquet, the fact also by year."""
    base = scratch(spark, "bench-star")
    for name, df in adapt.star(spark, SF_DIR).items():
        if name == "lineorder":
            sinks.partition_fact(df, f"{base}/lineorder_by_year")
            df = df.drop("lo_year").repartition(int(CPUS))
        sinks.write(df, f"{base}/{name}")
    return tables.read_star(spark, base, by_year=True)


def main() -> None:
    spark = make_session("bench", f"local[{CPUS}]", shuffle_partitions=int(CPUS), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    star, sf = load(spark), SF_DIR.rstrip("/").rsplit("sf", 1)[-1]
    names = [(q, s) for q in Q.NAMES for s in STRATEGIES]
    equal = all(all(same({s: prepare(Q.query(q, star), s).df for s in STRATEGIES}).values()) for q in Q.NAMES)
    times: dict[str, list[float]] = {f"{q}_{s}": [] for q, s in names}
    setups: dict[str, list[float]] = {n: [] for n in times}
    for run in range(RUNS):
        for q, s in names:
            began = time.perf_counter()
            made = prepare(Q.query(q, star), s)
            sinks.run_only(made.df)
            times[f"{q}_{s}"].append(time.perf_counter() - began)
            setups[f"{q}_{s}"].append(made.setup_seconds)
            if records := os.environ.get("BENCH_RECORDS"):
                sinks.record(records, query=q, strategy=made.strategy, repartition=None, cores=int(CPUS), sf=sf, run=run, seconds=times[f"{q}_{s}"][-1])
    kept = lambda t: t[1:] or t
    medians = {n: round(statistics.median(kept(t)), 3) for n, t in times.items()}
    setup = {n: round(statistics.median(kept(t)), 3) for n, t in setups.items()}
    spread = {n: [round(min(kept(t)), 3), round(max(kept(t)), 3)] for n, t in times.items()}
    value = round(sum(medians[f"{q}_broadcast"] for q in Q.NAMES), 3)
    print(json.dumps({"metric": "star queries q1-q5, broadcast", "value": value, "unit": "sec", "queries": medians, "sf": sf, "setup": setup, "min_max": spread, "identical_rows": equal, "runs": RUNS, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
