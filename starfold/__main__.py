"""python -m starfold generate|partition|probe|query|summarize ...; the master comes from the submit command or --master."""

from __future__ import annotations

import argparse
import json
import time

from starfold.model import STRATEGIES
from starfold.operators.star import prepare
from starfold.plans import queries as Q
from starfold.session import make_session
from starfold.sources import sinks, tables
from starfold.tools import datagen, partition, probe, summarize


def report(spark, a: argparse.Namespace) -> dict:
    """Run a query, show its rows in order, and say how it went."""
    began = time.perf_counter()
    tables_of = tables.read_star(spark, a.base, a.query == "q5")
    star = Q.query(a.query, tables_of)
    made = prepare(star, a.strategy, a.repartition)
    fact = star.fact if a.repartition is None else star.fact.repartition(a.repartition)
    scan = time.perf_counter()
    rows = made.df.orderBy(*made.df.columns[:-1]).collect()  # one row for each group
    ended = time.perf_counter()
    for r in rows[:200]:
        print(*r, sep="\t")
    out = {"query": a.query, "strategy": made.strategy, "repartition": a.repartition, "setup_seconds": made.setup_seconds, "scan_seconds": ended - scan, "seconds": ended - began, "groups": len(rows), "total": sum(r[-1] or 0 for r in rows), "fact_partitions": fact.rdd.getNumPartitions(), "cores": spark.sparkContext.defaultParallelism, "notes": made.notes}
    if a.record:
        sinks.record(a.record, sf=a.base, run=1, **{k: out[k] for k in ("query", "strategy", "repartition", "cores", "seconds")})
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="starfold")
    p.add_argument("--master")
    p.add_argument("--shuffle-partitions", type=int)
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("generate")
    g.add_argument("out")
    for name in ("rows", "customers", "suppliers", "parts", "days", "seed"):
        g.add_argument(f"--{name}", type=int, default=getattr(datagen.Sizes, name))
    g.add_argument("--files", type=int, default=96)
    g.add_argument("--dims-only", action="store_true")
    r = sub.add_parser("partition")
    r.add_argument("base")
    r.add_argument("--out-name", default="lineorder_by_year")
    b = sub.add_parser("probe")
    b.add_argument("base")
    q = sub.add_parser("query")
    q.add_argument("base")
    q.add_argument("--query", choices=Q.NAMES, default="q1")
    q.add_argument("--strategy", choices=STRATEGIES, default="auto")
    q.add_argument("--repartition", type=int)
    q.add_argument("--record", help="append the report to this file, for summarize")
    s = sub.add_parser("summarize")
    s.add_argument("path")
    a = p.parse_args(args)
    spark = make_session(master=a.master, shuffle_partitions=a.shuffle_partitions)
    if a.what == "generate":
        datagen.generate(spark, a.out, datagen.Sizes(a.customers, a.suppliers, a.parts, a.days, a.rows, a.seed), a.files, a.dims_only)
    elif a.what == "partition":
        partition.rewrite(spark, a.base, a.out_name).show()
    elif a.what == "probe":
        print(json.dumps(probe.probe(spark, a.base)))
    elif a.what == "query":
        print(json.dumps(report(spark, a)))
    else:
        summarize.summarize(spark, a.path).orderBy("query", "median_s").show(200)


if __name__ == "__main__":
    main()
