import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from starfold.operators.star import prepare
from starfold.plans import queries as Q
from starfold.session import object_store_conf
from starfold.sources import sinks, tables
from starfold.tools import datagen, partition, probe, summarize, verify

SIZES = datagen.Sizes(customers=400, suppliers=100, parts=200, days=2556, rows=20_000)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("star"))
    datagen.generate(spark, out, SIZES, files=3)
    partition.rewrite(spark, out)
    return out


def test_strategies_agree_on_generated_data(spark, base):
    t = tables.read_star(spark, base, by_year=True)
    for name, groups in (("q1", 200), ("q2", 40), ("q3", 400), ("q4", 200), ("q5", 25)):
        results = {s: prepare(Q.query(name, t), s).df for s in ("broadcast", "merge", "onepass")}
        assert all(verify.same(results).values())
        n, _ = verify.groups_and_sum(results["broadcast"])
        assert n <= groups and n > groups * 0.8  # keys are drawn independently


def test_keys_are_independent(spark, base):
    f = tables.read(spark, base, "lineorder")
    both = f.filter((F.col("lo_custkey") % 5 == 0) & (F.col("lo_suppkey") % 5 == 0)).count()
    assert 0.03 < both / SIZES.rows < 0.05


def test_dims_only_leaves_the_fact(spark, base):
    before = tables.read(spark, base, "lineorder").count()
    datagen.generate(spark, base, datagen.Sizes(customers=400, suppliers=100, parts=200, rows=5), dims_only=True)
    assert tables.read(spark, base, "lineorder").count() == before


def test_partitions_keep_all_rows(spark, base):
    assert spark.read.parquet(f"{base}/lineorder_by_year").count() == SIZES.rows


def test_probe(spark, base):
    got = probe.probe(spark, f"{base}/lineorder")
    assert got["files"] == 3 and got["parallel"]["files"] == 3 and got["one"]["mb_s"] > 0
    spark.range(1).write.mode("overwrite").json(f"{base}/none")
    with pytest.raises(ValueError):
        probe.probe(spark, f"{base}/none")


def test_sinks_and_summary(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    sinks.write(df, str(tmp_path / "a"), files=2, sort_by=["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 100
    sinks.run_only(df)
    path = str(tmp_path / "runs.json")
    for run, s in enumerate((9.0, 1.0, 3.0, 2.0)):
        sinks.record(path, query="q1", strategy="merge", repartition=None, cores=4, sf="1", run=run, seconds=s)
    row = summarize.summarize(spark, path).first()
    assert (row["n_runs"], row["median_s"], row["min_s"], row["max_s"], row["ratio"]) == (3, 2.0, 1.0, 3.0, 1.0)
    assert json.loads(open(path).readline())["run"] == 0


def test_nulls_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k long, name string")
    assert tables.checked(df, ["name"]).count() == 2
    with pytest.raises(Exception, match="null in column k"):
        tables.checked(df).collect()


def test_command_line(spark, base, tmp_path, monkeypatch, capsys):
    from starfold import __main__ as cli

    monkeypatch.setattr(cli, "make_session", lambda **_: spark)
    log = str(tmp_path / "runs.json")
    for strategy in ("auto", "onepass"):
        cli.main(["query", base, "--query", "q4", "--strategy", strategy, "--record", log])
        got = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
        assert got["strategy"] == strategy and got["groups"] > 150 and got["fact_partitions"] >= 1 and got["seconds"] >= got["scan_seconds"] > 0
    cli.main(["summarize", log])
    cli.main(["generate", str(tmp_path / "star"), "--rows", "50", "--customers", "10", "--suppliers", "3", "--parts", "4", "--files", "2"])
    assert tables.read(spark, str(tmp_path / "star"), "customer").count() == 10
    cli.main(["probe", str(tmp_path / "star")])
    assert json.loads(capsys.readouterr().out.strip().split("\n")[-1])["files"] >= 2


def test_settings_from_the_environment():
    from starfold.session import launch_conf

    assert launch_conf({}) == {} and launch_conf({"STARFOLD_DRIVER_MEMORY": "4g"}) == {"spark.driver.memory": "4g"}


def test_no_default_credentials():
    assert object_store_conf({}) == {}
    assert object_store_conf({"S3_ENDPOINT": "http://x"}) == {"spark.hadoop.fs.s3a.endpoint": "http://x"}


def test_verify_sees_swapped_values(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "g string, total double")
    b = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "g string, total double")
    assert verify.groups_and_sum(a) == verify.groups_and_sum(b) and not verify.same({"a": a, "b": b})["b"]


def test_workers_find_the_package_without_pythonpath(tmp_path):
    """A driver that only has the package on sys.path, started elsewhere: one pass and storage probe still run."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from starfold.model import Dimension
from starfold.operators.star import star_aggregate
from starfold.session import make_session
from starfold.tools import probe
s = make_session("elsewhere", "local[2]", shuffle_partitions=2, **{{"spark.ui.enabled": "false"}})
fact = s.createDataFrame([(0, 1.0), (1, 2.0), (1, 4.0)], "k long, amount double")
fact.write.parquet({str(tmp_path / "fact")!r})
dim = s.createDataFrame([(0, "a"), (1, "b")], "id long, name string")
out = star_aggregate(fact, [Dimension(dim, "k", "id", ["name"])], ["name"], "amount", "onepass")
print(sorted(map(tuple, out.collect())), probe.probe(s, {str(tmp_path / "fact")!r})["files"] > 0)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[('a', 1.0), ('b', 6.0)] True"), done.stderr[-2000:]
