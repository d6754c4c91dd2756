"""Run analytics helpers: exact distributed median, positions, histogram."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from capgraph.operators import runs as R
from capgraph.operators.ordered import at_ranks, exact_median, positions


def test_exact_median_skewed_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.exponential(10, 3001)]
    rows += [("small", float(v)) for v in rng.normal(0, 1, 10)]
    rows += [("one", 4.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v", digit=4).collect()}
    for k in ("hot", "small", "one"):
        want = float(np.median([v for kk, v in rows if kk == k]))
        assert got[k] == pytest.approx(want, rel=1e-12)


def test_global_median_and_positions(spark):
    df = spark.range(0, 1001).withColumn("v", (F.col("id") * 7919 % 1001).cast("double"))
    assert exact_median(df, [], "v").first()["median"] == 500.0
    pos = positions(df, [], "id")
    assert [r["_pos"] - r["id"] for r in pos.collect()] == [1] * 1001
    sample = R.systematic_sample(df.withColumnRenamed("id", "run_id"), every=100)
    assert sorted(r["run_id"] for r in sample.collect()) == list(range(0, 1001, 100))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "x double")
    h = {r["bin"]: r["count"] for r in R.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 4: 1}  # last edge inclusive
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert R.histogram(const, "x", 5).first()["count"] == 2


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 3.0)],
                               "algorithm_type string, total_memory_gb double, simulated_time double")
    df = df.withColumn("total_cores", F.col("total_memory_gb"))
    got = {r["algorithm_type"]: r["memory_corr"] for r in R.resource_correlation(df).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_median_keeps_null_groups_and_splits_equal_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0)] + [("hot", 7.0)] * 900 + [("hot", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "k string, v double")
    for digit in (16, 8):
        got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v", digit=digit).collect()}
        assert got == {None: 2.0, "b": 2.0, "hot": 7.0}
    counts = df.groupBy("k", "v").count()
    assert counts.where("k = 'hot'").count() == 100  # 90 % equal rows are one counted value


def test_positions_keep_nulls_and_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), (None, 5), ("b", 2), ("b", 2)], "k string, v int")
    got = sorted(((r["k"], r["v"], r["_pos"]) for r in positions(df, ["k"], "v").collect()), key=repr)
    assert got == sorted([("a", 1, 1), ("a", 3, 2), ("a", None, 3), (None, 5, 1), ("b", 2, 1), ("b", 2, 2)], key=repr)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "run_id int")
    assert R.systematic_sample(ids, every=1).count() == 3


def test_profile_and_histogram_keep_a_null_algorithm(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 5.0), ("a", 2.0)], "algorithm_type string, simulated_time double")
    got = {r["algorithm_type"]: r["median_time"] for r in R.algorithm_profile(df).collect()}
    assert got == {None: 3.0, "a": 2.0}
    h = R.histogram(df, "simulated_time", 2, ["algorithm_type"]).groupBy("algorithm_type").agg(F.sum("count").alias("n"))
    assert {r["algorithm_type"]: r["n"] for r in h.collect()} == {None: 2, "a": 1}


def _plan(spark, make):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_plans_without_products_or_fact_shuffles(spark):
    from conftest import SF_SMALL

    from capgraph.sources import tables as T
    runs = T.runs(spark, SF_SMALL)
    for make in (lambda: R.median_success_rate(runs), lambda: R.systematic_sample(runs), lambda: R.algorithm_profile(runs)):
        assert "CartesianProduct" not in _plan(spark, make)
    features = ("num_nodes", "total_cores", "total_memory_gb")
    for make in (lambda: R.correlation_matrix(runs, features), lambda: R.runtime_correlation_ranking(runs, features)):
        assert "hashpartitioning(algorithm_type" not in _plan(spark, make)


def test_values_at_ranks_of_odd_columns(spark):
    inf, nan = float("inf"), float("nan")
    values = [0.0, -0.0, -1.5, 1e-300, -1e300, inf, -inf, nan, 2.0, 2.0, 3.25]
    df = spark.createDataFrame([("x", i % 2, v) for i, v in enumerate(values)] + [("y", None, -7.0)], "k string, j int, v double")
    n = len(values)
    got = at_ranks(df, ["k"], "v", lambda c: [F.lit(i + 1) for i in range(n)], digit=8).where("k = 'x'").collect()
    assert [r["value"] for r in sorted(got, key=lambda r: r["which"])][:-1] == [-inf, -1e300, -1.5, 0.0, 0.0, 1e-300, 2.0, 2.0, 3.25, inf]
    assert exact_median(df.where("v = v"), ["k", "j"], "v").count() == 3
    whole = spark.createDataFrame([(v,) for v in (5, -(1 << 62), 1 << 62, None)], "v bigint")
    assert [r["value"] for r in at_ranks(whole, [], "v", lambda c: [c, F.lit(1)]).orderBy("which").collect()] == [1 << 62, -(1 << 62)]


def test_median_has_no_window_over_values(spark):
    df = spark.range(0, 2000).select(F.lit("hot").alias("k"), (F.col("id") * 0.37).alias("v"))
    plan = exact_median(df, ["k"], "v")._jdf.queryExecution().toString()
    assert "Window" not in plan  # running sums are over counts, written before
    assert exact_median(df, ["k"], "v").first()["median"] == pytest.approx(0.37 * 999.5)
