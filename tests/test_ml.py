"""Spark ML pipeline: training, reload equality, optimiser and metrics."""
import tempfile

import pytest
from pyspark.sql import functions as F

from capgraph.ml import metrics as MM
from capgraph.ml import optimizer as OPT
from capgraph.ml import runtime_model as RM
from capgraph.sources import tables as T
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def runs(spark):
    r = T.runs(spark, SF_SMALL)
    # small synthetic graph columns so the model sees every feature
    return r.withColumns({"nodes": F.col("num_nodes") * 10 + 5, "edges": F.col("num_nodes") * 30,
                          "density": F.lit(0.01), "avg_clustering": F.lit(None).cast("double")})


def test_split_is_repeatable(spark, runs):
    tr1, te1 = RM.split_train_test(runs)
    tr2, _ = RM.split_train_test(runs.repartition(7))
    assert tr1.count() + te1.count() == runs.count()
    assert tr1.select("run_id").exceptAll(tr2.select("run_id")).count() == 0


def test_gbt_train_save_load(spark, runs):
    tm = RM.train(runs, "gbt", maxIter=3, maxDepth=3)
    m = {r["split"]: r for r in tm.metrics.collect()}
    assert set(m) == {"train", "test"} and m["train"]["rmse"] >= 0
    d = tempfile.mkdtemp(prefix="capgraph-model-")
    RM.save_model(tm.model, d)
    back = RM.load_model(d)
    data = RM._cast_numeric(runs, tm.features)
    a = RM.predict(tm.model, data).select("run_id", "prediction")
    b = RM.predict(back, data).select("run_id", "prediction")
    assert a.exceptAll(b).count() == 0
    imp = RM.feature_importance(tm).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6
    assert all(r["prediction"] >= RM.MIN_TIME for r in a.collect())


def test_unseen_algorithm_predicts(spark, runs):
    tm = RM.train(runs, "rf", numTrees=5, maxDepth=3)
    new = RM._cast_numeric(runs.limit(3).withColumn("algorithm_type", F.lit("never_seen")), tm.features)
    assert RM.predict(tm.model, new).filter(F.col("prediction").isNull()).count() == 0


def test_optimiser_picks_fewest_passing_nodes(spark):
    runs = spark.createDataFrame(
        [(i, "g", "a", t, n) for i, (n, t) in enumerate([(1, 90.0), (2, 50.0), (3, 25.0), (4, 10.0)])],
        "run_id long, graph_name string, algorithm_type string, simulated_time double, num_nodes int")
    wl = spark.createDataFrame([("g", "a")], "workload string, algorithm_type string")
    dl = spark.createDataFrame([(20.0,), (60.0,), (5.0,)], "deadline double")
    got = {r["deadline"]: r for r in
           OPT.optimise_deadlines(wl, dl, OPT.lookup_predictor(runs), max_nodes=4).collect()}
    assert got[60.0]["num_nodes"] == 2 and got[60.0]["deadline_margin"] == 10.0
    assert got[20.0]["num_nodes"] == 4
    assert got[5.0]["num_nodes"] is None
    pol = {r["deadline"]: r for r in OPT.model_policy(
        OPT.optimise_deadlines(wl, dl, OPT.lookup_predictor(runs), max_nodes=4)).collect()}
    assert pol[5.0]["fallback"] and pol[5.0]["nodes"] == 8
    assert pol[5.0]["est_time"] == 10.0  # the prediction for the most nodes


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    m = MM.regression_metrics(df, "y", "p").first()
    assert m["mae"] == pytest.approx(1 / 3)
    assert m["r2"] == pytest.approx(1 - 0.5 / 2.0)


def test_cross_deadline(spark, runs):
    x = runs.withColumn("deadline_constraint", F.when(F.col("run_id") % 2 == 0, 30.0).otherwise(60.0))
    pairs = RM.cross_deadline(x, kind="rf", numTrees=3, maxDepth=2)
    assert pairs.count() == 2
    n = {r["deadline_constraint"]: r["count"] for r in x.groupBy("deadline_constraint").count().collect()}
    assert all(r["train_samples"] == n[r["train_deadline"]] and r["test_samples"] == n[r["test_deadline"]]
               for r in pairs.collect())
    s = RM.generalisation_summary(pairs).first()
    assert s["best_pair"] is not None and s["mean_mae"] > 0 and s["std_mae"] is not None
    many = runs.withColumn("deadline_constraint", F.col("run_id").cast("double"))
    with pytest.raises(ValueError):
        RM.cross_deadline(many)


def test_derived_deadlines_are_repeatable(spark, runs):
    a = RM.derived_deadline(runs, (20.0, 30.0, 45.0, 60.0)).select("run_id", "deadline_constraint")
    b = RM.derived_deadline(runs.repartition(5), (20.0, 30.0, 45.0, 60.0)).select("run_id", "deadline_constraint")
    assert a.exceptAll(b).count() == 0 and a.select("deadline_constraint").distinct().count() == 4
