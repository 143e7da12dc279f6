"""The edge matrix, strategies against each other and DuckDB, and plan shapes."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starfold.model import STRATEGIES, Dimension, StarQuery
from starfold.operators.star import eager, prepare, small, star_aggregate

FACT = "k long, j long, amount double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def fact(spark, data):
    return spark.createDataFrame(data, FACT)


def dim(spark, data, kind="id long, name string"):
    return spark.createDataFrame(data, kind)


@pytest.mark.parametrize("strategy", STRATEGIES)
class TestEdges:
    def run(self, spark, strategy, facts, dims, **more):
        return rows(star_aggregate(fact(spark, facts), [Dimension(dim(spark, dims), "k", "id", ["name"], **more)], ["name"], "amount", strategy))

    def test_orphans_and_null_keys_are_dropped(self, spark, strategy):
        assert self.run(spark, strategy, [(0, 0, 1.0), (9, 0, 2.0), (None, 0, 4.0)], [(0, "a"), (1, "b")]) == [("a", 1.0)]

    def test_null_and_empty_attributes_are_two_groups(self, spark, strategy):
        assert self.run(spark, strategy, [(0, 0, 1.0), (1, 0, 2.0)], [(0, None), (1, "")]) == [("", 2.0), (None, 1.0)]

    def test_null_measures_do_not_count(self, spark, strategy):
        assert self.run(spark, strategy, [(0, 0, None), (1, 0, 2.0), (1, 0, None)], [(0, "a"), (1, "b")]) == [("a", None), ("b", 2.0)]

    def test_repeated_dimension_keys_multiply(self, spark, strategy):
        assert self.run(spark, strategy, [(0, 0, 1.5)], [(0, "a"), (0, "a"), (0, "b")]) == [("a", 3.0), ("b", 1.5)]

    def test_repeated_keys_of_a_filter_multiply_too(self, spark, strategy):
        dims = [Dimension(dim(spark, [(0, "a")]), "k", "id", ["name"]), Dimension(dim(spark, [(5, "x"), (5, "y")]), "j", "id")]
        assert rows(star_aggregate(fact(spark, [(0, 5, 1.0)]), dims, ["name"], "amount", strategy)) == [("a", 2.0)]

    def test_sparse_wide_and_negative_keys(self, spark, strategy):
        wide = 2**32
        assert self.run(spark, strategy, [(10**9, 0, 1.0), (wide, 0, 2.0), (-1, 0, 4.0)], [(0, "zero"), (10**9, "far"), (-1, "minus")]) == [("far", 1.0), ("minus", 4.0)]

    def test_predicate_that_keeps_nothing(self, spark, strategy):
        assert self.run(spark, strategy, [(0, 0, 1.0)], [(0, "a")], predicate=F.col("name") == "z") == []

    def test_empty_fact_and_empty_dimension(self, spark, strategy):
        assert self.run(spark, strategy, [], [(0, "a")]) == []
        assert self.run(spark, strategy, [(0, 0, 1.0)], []) == []

    def test_many_values(self, spark, strategy):
        n = 1500
        got = self.run(spark, strategy, [(i, 0, 1.0) for i in range(n)], [(i, f"v{i}") for i in range(n)])
        assert len(got) == n

    def test_narrow_keys_and_number_of_dimensions(self, spark, strategy):
        f = spark.createDataFrame([(1, 2, 3.25), (1, 0, 1.0)], "k int, j int, amount double")
        for n in (0, 1, 2, 4, 6):
            dims = [Dimension(dim(spark, [(1, "a"), (2, "b"), (0, "c")]).withColumnRenamed("name", f"n{i}"), "k" if i % 2 else "j", "id", [f"n{i}"]) for i in range(n)]
            keys = [f"n{i}" for i in range(n)]
            got = rows(star_aggregate(f, dims, keys, "amount", strategy))
            assert sum(r[-1] for r in got) == 4.25
            assert len(got) == (2 if n else 1)


def test_random_stars_agree_with_sql(spark):
    rng = random.Random(7)
    for _ in range(3):
        f = [(rng.choice([None, *range(12)]), rng.choice([None, *range(8)]), rng.choice([None, round(rng.random() * 100, 2)])) for _ in range(200)]
        d1 = [(rng.choice([None, *range(10)]), rng.choice([None, "", "x", "y"])) for _ in range(8)]
        d2 = [(i, rng.choice(["p", "q"])) for i in rng.sample(range(8), 6)]
        con = duckdb.connect()
        for name, data, cols in (("f", f, ["k", "j", "amount"]), ("d1", d1, ["id", "name"]), ("d2", d2, ["id", "name"])):
            con.register(name, pd.DataFrame(data, columns=cols).astype(object))
        want = sorted(con.execute("SELECT d1.name, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM f JOIN d1 ON CAST(f.k AS BIGINT) = CAST(d1.id AS BIGINT) JOIN d2 ON CAST(f.j AS BIGINT) = d2.id WHERE d2.name = 'p' GROUP BY 1").fetchall(), key=str)
        for strategy in STRATEGIES:
            dims = [Dimension(dim(spark, d1), "k", "id", ["name"]), Dimension(dim(spark, d2), "j", "id", [], F.col("name") == "p")]
            assert rows(star_aggregate(fact(spark, f), dims, ["name"], "amount", strategy)) == want, strategy


def test_repartitioning_never_changes_a_sum(spark):
    f = fact(spark, [(i % 3, 0, i * 0.01 + 1e9) for i in range(1000)])
    q = StarQuery(f, [Dimension(dim(spark, [(0, "a"), (1, "b"), (2, "c")]), "k", "id", ["name"])], ["name"], "amount")
    first = rows(prepare(q, "broadcast").df)
    assert all(rows(prepare(q, "broadcast", n).df) == first for n in (1, 3, 7))
    assert rows(eager(q)) == first


def test_names_are_checked(spark):
    f, d = fact(spark, [(0, 0, 1.0)]), dim(spark, [(0, "a")])
    with pytest.raises(ValueError, match="unknown strategy"):
        star_aggregate(f, [Dimension(d, "k", "id", ["name"])], ["name"], "amount", "smj")
    for dims, keys, measure in (([Dimension(d, "x", "id")], [], "amount"), ([Dimension(d, "k", "no")], [], "amount"), ([Dimension(d, "k", "id", ["name"])], ["other"], "amount"), ([], [], "nope")):
        with pytest.raises(ValueError):
            star_aggregate(f, dims, keys, measure)


def test_one_pass_says_why_it_does_not_apply(spark, monkeypatch):
    from starfold.operators import onepass

    d = Dimension(dim(spark, [(10**9, "a"), (-5, "b")]), "k", "id", ["name"])
    q = StarQuery(fact(spark, [(10**9, 0, 1.0), (-5, 0, 2.0)]), [d], ["name"], "amount")
    made = prepare(q, "onepass")
    assert made.strategy == "onepass" and rows(made.df) == [("a", 1.0), ("b", 2.0)]
    monkeypatch.setattr(onepass, "MOST_ROWS", 1)
    made = prepare(q, "onepass")
    assert made.strategy == "broadcast" and "more than 1 rows" in made.notes[0] and rows(made.df) == [("a", 1.0), ("b", 2.0)]
    f = spark.createDataFrame([(1.0, 0, 1.0)], "k double, j long, amount double")
    assert "one kind" in prepare(StarQuery(f, [d], ["name"], "amount"), "onepass").notes[0]


def test_one_pass_by_names_of_groups(spark, monkeypatch):
    from starfold.operators import onepass

    monkeypatch.setattr(onepass, "DENSE_GROUPS", 0)
    d = Dimension(dim(spark, [(0, "a"), (1, "b")]), "k", "id", ["name"])
    assert rows(prepare(StarQuery(fact(spark, [(0, 0, 9e15)] * 20 + [(1, 0, None)]), [d], ["name"], "amount"), "onepass").df) == [("a", 1.8e17), ("b", None)]


@pytest.mark.parametrize("strategy", [*STRATEGIES, "eager"])
@pytest.mark.parametrize("values,want", [([0.004] * 1000, 4.0), ([1e17, 1.0], 1e17 + 1), ([9e15] * 20, 1.8e17), ([0.1] * 10, 1.0), ([float("inf"), 1.0], float("inf")), ([None, 2.5], 2.5)])
def test_no_sum_rounds_wraps_or_fails(spark, strategy, values, want):
    q = StarQuery(fact(spark, [(0, 0, v) for v in values]), [Dimension(dim(spark, [(0, "a")]), "k", "id", ["name"])], ["name"], "amount")
    got = rows(eager(q) if strategy == "eager" else prepare(q, strategy).df)
    assert got == [("a", pytest.approx(want, rel=1e-12))]


def test_scale_none_sums_doubles(spark):
    q = StarQuery(fact(spark, [(0, 0, 0.125), (0, 0, 1e300)]), [Dimension(dim(spark, [(0, "a")]), "k", "id", ["name"])], ["name"], "amount", scale=None)
    assert {s: rows(prepare(q, s).df) for s in STRATEGIES} == {s: [("a", 1e300)] for s in STRATEGIES}


def test_size_is_checked_before_broadcast(spark):
    big = spark.range(1000).selectExpr("id", "cast(id as string) name").repartition(2)
    assert small(big.limit(10)) and not small(spark.range(10**7).selectExpr("id", "uuid() name"), 1 << 20)
    assert not small(spark.range(10).selectExpr("id", "repeat('x', 1000) name"), 9000)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    from starfold.plans import queries as Q
    from starfold.sources import adapt, sinks

    t = adapt.star(spark, "/root/testdata/sf0.001")
    t["lineorder_by_year"] = sinks.partition_fact(t["lineorder"], str(tmp_path / "by_year"))
    p = plan(prepare(Q.query("q5", t), "broadcast").df)
    assert "PartitionFilters: [isnotnull(lo_year" in p and p.count("BroadcastHashJoin") >= 4
    p = plan(prepare(Q.query("q1", t), "merge").df)
    assert p.count("SortMergeJoin") >= 4
    p = plan(prepare(Q.query("q1", t), "shuffle_hash").df)
    assert p.count("ShuffledHashJoin") >= 4
    p = plan(prepare(Q.query("q2", t), "broadcast").df)
    assert "LeftSemi" in p
