"""Registered modelling queries.

Model-free parts (features, split, scaler statistics, optimiser, validation,
residuals, model-as-policy) are checked against SQL by plugging in the
deterministic lookup predictor.  Single trees of the learners (M6, M7), their
predictions and importances are checked against SQL that grows the same trees;
whole ensembles are rows-only there and held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StringIndexer
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..ml import metrics as MM
from ..ml import optimizer as OPT
from ..ml import runtime_model as RM
from ..ml import trees as TT
from ..operators import policies as P
from ..operators import runs as R
from ..sources import tables as T
from .policy_queries import _SCORED, scored_policies
from .registry import query, round_stable, rounded
from ..session import shared_path, written
from .run_queries import _runs_features as _assembled
from .sql_views import RUNS, features_sql

def _runs_features(spark, sf):
    """The assembled runs, written once: every fitted stage reads them."""
    return written(_assembled(spark, sf))


NUMERIC = [c for c in RM.FEATURE_COLUMNS if c != "algorithm_type"]
DL = "(VALUES (20.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE), (60.0::DOUBLE)) d(deadline)"


# ---------------------------------------------------------------- M1-M5

def _imputed_sql(src: str) -> str:
    cols = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()), 6) AS {c}_imp"
                     for c in NUMERIC)
    return f"""SELECT run_id, CAST(dense_rank() OVER (ORDER BY algorithm_type) - 1 AS DOUBLE) AS algorithm_type_encoded,
       {cols} FROM {src}"""


@query("ml_feature_table", features_sql() + "\n" + _imputed_sql("rf"))
def q_ml_feature_table(spark, sf):
    df = _runs_features(spark, sf)
    feats = RM.select_features(df)
    data = RM._cast_numeric(df, feats)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol="algorithm_type", outputCol="algorithm_type_encoded",
                      stringOrderType="alphabetAsc", handleInvalid="keep"),
        Imputer(strategy="mean", inputCols=NUMERIC, outputCols=[f"{c}_imp" for c in NUMERIC])])
    out = pipe.fit(data).transform(data)
    return rounded(out.select("run_id", "algorithm_type_encoded", *[f"{c}_imp" for c in NUMERIC]))


_BUCKET = "CAST(('0x' || substr(md5(CAST(run_id AS VARCHAR)), 1, 4)) AS BIGINT) % 100"


@query("ml_split", f"""WITH {RUNS}
SELECT CASE WHEN {_BUCKET} < 75 THEN 'train' ELSE 'test' END AS split, count(*) AS rows,
       round(avg(simulated_time), 6) AS mean_time
FROM runs1 GROUP BY 1""")
def q_ml_split(spark, sf):
    tr, te = RM.split_train_test(T.runs(spark, sf))
    agg = [F.count(F.lit(1)).alias("rows"), F.avg("simulated_time").alias("mean_time")]
    return rounded(tr.agg(*agg).withColumn("split", F.lit("train"))
                   .unionByName(te.agg(*agg).withColumn("split", F.lit("test"))))


def _scaler_sql() -> str:
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), avg(CAST({c} AS DOUBLE)) OVER ()) AS {c}" for c in NUMERIC)
    stats = ", ".join(f"avg({c}) AS \"{c}|mean\", stddev_samp({c}) AS \"{c}|std\""
                      for c in NUMERIC + ["algorithm_type_encoded"])
    return features_sql() + f""",
tr AS (SELECT * FROM rf WHERE {_BUCKET} < 75),
ti AS (SELECT {imp}, CAST(dense_rank() OVER (ORDER BY algorithm_type) - 1 AS DOUBLE) AS algorithm_type_encoded
       FROM tr),
st AS (SELECT {stats} FROM ti),
u AS (FROM st UNPIVOT INCLUDE NULLS (v FOR k IN (COLUMNS(*))))
SELECT split_part(k, '|', 1) AS feature, round(max(CASE WHEN split_part(k, '|', 2) = 'mean' THEN v END), 6) AS mean,
       round(max(CASE WHEN split_part(k, '|', 2) = 'std' THEN v END), 6) AS std
FROM u GROUP BY 1"""


@query("ml_scaler_stats", _scaler_sql())
def q_ml_scaler_stats(spark, sf):
    df = _runs_features(spark, sf)
    feats = RM.select_features(df)
    tr, _ = RM.split_train_test(RM._cast_numeric(df, feats))
    model = RM.preparation(feats).fit(tr)
    scaler = model.stages[-1]
    names = NUMERIC + ["algorithm_type_encoded"]
    rows = [(n, float(m), float(s)) for n, m, s in
            zip(names, scaler.mean.toArray(), scaler.std.toArray())]
    return rounded(spark.createDataFrame(rows, "feature string, mean double, std double"))


# ---------------------------------------------------------------- M6-M11 (rows only)

#: Fitted forests of a session, by application and table: four queries read the same one.
_FORESTS: dict[tuple, tuple] = {}


def _forest(spark, sf):
    """The assembled runs and the forest fitted on them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FORESTS:
        _FORESTS.clear()
        runs = _runs_features(spark, sf)
        _FORESTS[key] = (runs, RM.train(runs, "rf"))
    return _FORESTS[key]


@query("runtime_model_rf")
def q_runtime_model_rf(spark, sf):
    _, tm = _forest(spark, sf)
    return rounded(tm.metrics.withColumn("model", F.lit("RandomForest")))


@query("feature_importance")
def q_feature_importance(spark, sf):
    _, tm = _forest(spark, sf)
    return rounded(RM.feature_importance(tm))


@query("model_predictions")
def q_model_predictions(spark, sf):
    rf, tm = _forest(spark, sf)
    wl = written(rf.groupBy("graph_name", "algorithm_type")
                 .agg(*[F.first(c).alias(c) for c in ("nodes", "edges", "density", "avg_clustering")]))
    grid = RM._cast_numeric(RM.what_if_rows(RM.dealt(wl, wl.count() * RM.MOST_NODES)), tm.features)
    return rounded(RM.predict(tm.model, grid).select(
        "graph_name", "algorithm_type", "num_nodes", "total_cores", "total_memory_gb", "prediction"))


# One tree of two levels of each learner over four features of the runs.

_TREE_FEATURES = ("num_nodes", "total_cores", "total_memory_gb", "algorithm_code")
_ONE_BOOSTED = TT.Settings(True, trees=1, depth=2, rate=0.1, l1=0.5, l2=1.0)
_ONE_FOREST = TT.Settings(False, trees=1, depth=2, bootstrap=True, min_split=5, min_leaf=2)


def _tree_rows(spark, sf):
    runs = T.runs(spark, sf)
    names = F.broadcast(runs.select("algorithm_type").distinct().orderBy("algorithm_type").limit(1000)
                        .withColumn("algorithm_code", F.row_number().over(Window.orderBy("algorithm_type")) - 1))
    return runs.join(names, "algorithm_type").withColumn("x", F.array(*[F.col(c).cast("double") for c in _TREE_FEATURES]))


def _one_tree(spark, sf, s):
    rows = _tree_rows(spark, sf).select(F.col("run_id").cast("bigint").alias("key"), F.lit(0).alias("lane"),
                                        F.col("simulated_time").alias("y"), "x")
    return TT.fit(written(rows), len(_TREE_FEATURES), s)


def _mixed_sql(x: str) -> str:
    """``trees.mixed`` on an unsigned column."""
    step = x
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        step = f"((xor({step}, {step} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT)"
    return f"xor({step}, {step} >> 16)"


def _tree_sql(s: TT.Settings) -> str:
    """WITH prefix ending in ``node`` (node, f, cut, value, gain, n) of the first tree."""
    if s.bootstrap:
        draw = "[" + ", ".join(str(int(x)) for x in TT.POISSON) + "]"
        weight = f"CAST(len(list_filter({draw}, lambda t: t <= h2)) AS DOUBLE)"
    else:
        weight = "1.0::DOUBLE"
    base = "(SELECT avg(y) FROM x0)" if s.boosted else "0.0"
    shrink = lambda g: f"(sign({g}) * greatest(0.0, abs({g}) - {s.l1}))"
    score = lambda g, h: f"pow({shrink(g)}, 2) / greatest({h} + {s.l2}, 1e-12)"
    leaf = lambda g, h: f"-{shrink(g)} / greatest({h} + {s.l2}, 1e-12) * {s.rate}"
    cols = ", ".join(f"CAST({c} AS DOUBLE)" for c in _TREE_FEATURES)

    def level(k: int, rows: str) -> str:
        return f"""
c{k} AS (SELECT node, c.f, cut, sum(g) AS g, sum(w) AS h, count(*) AS n, coalesce(sum(g) FILTER (x[c.f + 1] <= cut), 0) AS lg,
         coalesce(sum(w) FILTER (x[c.f + 1] <= cut), 0) AS lh, count(*) FILTER (x[c.f + 1] <= cut) AS ln
         FROM {rows}, cuts c GROUP BY node, c.f, cut),
b{k} AS (SELECT *, round(0.5 * ({score('lg', 'lh')} + {score('(g - lg)', '(h - lh)')} - {score('g', 'h')}), 6) AS gain FROM c{k}
         WHERE ln >= {s.min_leaf} AND n - ln >= {s.min_leaf} AND n >= {s.min_split}
         QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) = 1),
s{k} AS (SELECT * FROM b{k} WHERE gain > 0)"""

    return f"""WITH {RUNS},
x0 AS (SELECT run_id, simulated_time AS y, [{cols}] AS x, xor(run_id::UBIGINT, run_id::UBIGINT >> 32) & 4294967295::UBIGINT AS h0
       FROM (SELECT *, dense_rank() OVER (ORDER BY algorithm_type) - 1 AS algorithm_code FROM runs1)),
x1 AS (SELECT *, {_mixed_sql('h0')} AS h1 FROM x0),
x2 AS (SELECT *, (h1 + {s.seed}::UBIGINT) & 4294967295::UBIGINT AS h1s FROM x1),
x3 AS (SELECT *, {_mixed_sql('h1s')} AS h2 FROM x2),
v AS (SELECT f, x[f + 1] AS v, row_number() OVER (PARTITION BY f ORDER BY x[f + 1]) AS p, count(*) OVER (PARTITION BY f) AS n FROM x0, range(4) t(f)),
cuts AS (SELECT DISTINCT f, v AS cut FROM v JOIN range(1, {s.bins}) t(k) ON p = CAST(ceil(n * k / {float(s.bins)}) AS BIGINT)),
r1 AS (SELECT 1 AS node, x, w, -w * (y - {base}) AS g FROM (SELECT *, {weight} AS w FROM x3) WHERE w > 0),{level(1, 'r1')},
r2 AS (SELECT CASE WHEN x[f + 1] <= cut THEN 2 ELSE 3 END AS node, x, w, r1.g FROM r1, s1),{level(2, 'r2')},
cut AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
sums AS (SELECT 1 AS node, sum(g) AS g, sum(w) AS h, count(*) AS n FROM r1
         UNION ALL SELECT 2 * node, lg, lh, ln FROM cut UNION ALL SELECT 2 * node + 1, g - lg, h - lh, n - ln FROM cut),
node AS (SELECT node, coalesce(f, -1) AS f, cut, {leaf('sums.g', 'sums.h')} AS value, coalesce(gain, 0) AS gain, sums.n, sums.h
         FROM sums LEFT JOIN cut USING (node))"""


_NODES = """
SELECT CAST(node AS INTEGER) AS node, CAST(f AS INTEGER) AS feature, cut, round(value, 6) AS value, round(gain, 3) AS gain,
       n AS rows FROM node"""


def _nodes(spark, sf, s):
    found = _one_tree(spark, sf, s).nodes(spark).select("node", "feature", "cut", "value", "gain", "rows")
    return found.withColumns({"value": round_stable(F.col("value"), 6), "gain": round_stable(F.col("gain"), 3)})


@query("boosted_tree", _tree_sql(_ONE_BOOSTED) + _NODES)
def q_boosted_tree(spark, sf):
    """M6: the first tree of regularised boosting."""
    return _nodes(spark, sf, _ONE_BOOSTED)


@query("forest_tree", _tree_sql(_ONE_FOREST) + _NODES)
def q_forest_tree(spark, sf):
    """M7: the first tree of a forest, on its bootstrap."""
    return _nodes(spark, sf, _ONE_FOREST)


@query("tree_importance", _tree_sql(_ONE_FOREST) + f"""
SELECT name AS feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM node), 6) AS importance
FROM (SELECT unnest({list(_TREE_FEATURES)}) AS name, unnest(range(4)) AS f) LEFT JOIN node USING (f) GROUP BY name""")
def q_tree_importance(spark, sf):
    """M10 on the tree of ``forest_tree``."""
    found = _one_tree(spark, sf, _ONE_FOREST).importance()
    return rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(_TREE_FEATURES, found)], "feature string, importance double"))


@query("tree_predictions", _tree_sql(_ONE_FOREST) + f""",
grid AS (SELECT algorithm_type, num_nodes, [CAST(num_nodes AS DOUBLE), CAST(num_nodes * {RM.CORES_PER_NODE} AS DOUBLE),
                CAST(num_nodes * {RM.MEMORY_PER_NODE_GB} AS DOUBLE), CAST(dense_rank() OVER (ORDER BY algorithm_type) - 1 AS DOUBLE)] AS x
         FROM (SELECT DISTINCT algorithm_type FROM runs1), range(1, 9) t(num_nodes)),
step AS (SELECT grid.*, CASE WHEN f < 0 THEN 1 WHEN x[f + 1] <= cut THEN 2 ELSE 3 END AS place FROM grid, node WHERE node = 1),
leaf AS (SELECT algorithm_type, num_nodes, CASE WHEN f < 0 THEN place WHEN x[f + 1] <= cut THEN 2 * place ELSE 2 * place + 1 END AS place
         FROM step JOIN node ON node = place)
SELECT algorithm_type, CAST(num_nodes AS INTEGER) AS num_nodes, round(greatest(value, {RM.MIN_TIME}), 6) AS prediction
FROM leaf JOIN node ON node = place""")
def q_tree_predictions(spark, sf):
    """M11 on the tree of ``forest_tree``: every algorithm on 1 to 8 nodes."""
    model = _one_tree(spark, sf, _ONE_FOREST)
    codes = _tree_rows(spark, sf).select("algorithm_type", "algorithm_code").distinct()
    grid = RM.what_if_rows(codes).withColumn("x", F.array(*[F.col(c).cast("double") for c in _TREE_FEATURES]))
    out = TT.predict(grid.select("algorithm_type", F.col("num_nodes").cast("int").alias("num_nodes"), "x"), model, F.col("x"))
    return rounded(out.select("algorithm_type", "num_nodes", F.greatest("prediction", F.lit(RM.MIN_TIME)).alias("prediction")))


# ---------------------------------------------------------------- M12-M17 (lookup predictor)

def _workloads(spark, sf):
    return (T.runs(spark, sf).select(F.col("graph_name").alias("workload"), "algorithm_type")
            .distinct())


_LOOKUP = f"""WITH {RUNS},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS prediction FROM runs1 GROUP BY ALL),
wk AS (SELECT DISTINCT graph_name AS workload, algorithm_type FROM runs1),
grid AS (SELECT wk.workload, wk.algorithm_type, n.num_nodes, CASE WHEN lk.prediction IS NOT NULL THEN greatest(lk.prediction, 0.1) END AS prediction
         FROM wk CROSS JOIN (SELECT unnest(range(1, 9)) AS num_nodes) n
         LEFT JOIN lk ON lk.algorithm_type = wk.algorithm_type AND lk.num_nodes = n.num_nodes),
opt AS (SELECT workload, algorithm_type, deadline,
               min(CASE WHEN prediction <= deadline THEN num_nodes END) AS n
        FROM grid CROSS JOIN {DL} GROUP BY ALL),
optp AS (SELECT o.*, g.prediction FROM opt o LEFT JOIN grid g
         ON g.workload = o.workload AND g.algorithm_type = o.algorithm_type AND g.num_nodes = o.n)"""


@query("deadline_optimizer", f"""{_LOOKUP}
SELECT workload, algorithm_type, deadline, CAST(n AS INTEGER) AS num_nodes,
       round(prediction, 6) AS predicted_time, round(deadline - prediction, 6) AS deadline_margin,
       CAST(n AS INTEGER) AS cost, CAST(n * 4 AS INTEGER) AS total_cores, CAST(n * 8 AS INTEGER) AS total_memory_gb
FROM optp""")
def q_deadline_optimizer(spark, sf):
    runs = T.runs(spark, sf)
    out = OPT.optimise_deadlines(_workloads(spark, sf), T.deadlines(spark),
                                 OPT.lookup_predictor(runs)).drop("last_prediction")
    return rounded(out.withColumn("num_nodes", F.col("num_nodes").cast("int")))


def _validation(spark, sf):
    runs = T.runs(spark, sf)
    pred = OPT.lookup_predictor(runs)(runs)
    x = (pred.crossJoin(F.broadcast(T.deadlines(spark)))
         .withColumnRenamed("simulated_time", "actual_time")
         .withColumnRenamed("prediction", "predicted_time"))
    return MM.validation_rows(x)


_VAL = f"""WITH {RUNS},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS prediction FROM runs1 GROUP BY ALL),
v0 AS (SELECT r.run_id, r.algorithm_type, r.num_nodes, d.deadline, r.simulated_time AS actual_time,
              CASE WHEN lk.prediction IS NOT NULL THEN greatest(lk.prediction, 0.1) END AS predicted_time
       FROM runs1 r JOIN lk USING (algorithm_type, num_nodes) CROSS JOIN {DL}),
v AS (SELECT *, abs(predicted_time - actual_time) AS error,
             CASE WHEN actual_time <> 0 THEN 100.0 * abs(predicted_time - actual_time) / actual_time END AS error_pct,
             actual_time <= deadline AS meets_deadline_actual, predicted_time <= deadline AS meets_deadline_predicted
      FROM v0)"""


@query("validation_rows", f"""{_VAL}
SELECT run_id, algorithm_type, num_nodes, deadline, round(actual_time, 6) AS actual_time,
       round(predicted_time, 6) AS predicted_time, round(error, 6) AS error, round(error_pct, 6) AS error_pct,
       meets_deadline_actual, meets_deadline_predicted FROM v""")
def q_validation_rows(spark, sf):
    return rounded(_validation(spark, sf).select(
        "run_id", "algorithm_type", "num_nodes", "deadline", "actual_time", "predicted_time",
        "error", "error_pct", "meets_deadline_actual", "meets_deadline_predicted"))


@query("validation_summary", f"""{_VAL}
SELECT algorithm_type, deadline, round(avg(error), 6) AS mae, round(avg(error_pct), 6) AS mape,
       round(max(error_pct), 6) AS max_error_pct,
       round(100.0 * avg(CAST(error_pct <= 20 AS DOUBLE)), 6) AS within_20_pct, count(*) AS rows,
       count_if(meets_deadline_actual = meets_deadline_predicted) AS hit_agreement
FROM v GROUP BY GROUPING SETS ((), (algorithm_type), (deadline))""")
def q_validation_summary(spark, sf):
    return rounded(MM.validation_summary(_validation(spark, sf)))


def _residuals(spark, sf):
    runs = T.runs(spark, sf)
    pred = OPT.lookup_predictor(runs)(runs)
    return pred.withColumn("residual", F.col("simulated_time") - F.col("prediction"))


_RES = f"""WITH {RUNS},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS prediction FROM runs1 GROUP BY ALL),
res AS (SELECT r.*, r.simulated_time - CASE WHEN lk.prediction IS NOT NULL THEN greatest(lk.prediction, 0.1) END AS residual
        FROM runs1 r JOIN lk USING (algorithm_type, num_nodes))"""


@query("residual_summary", f"""{_RES}
SELECT algorithm_type, round(avg(abs(residual)), 6) AS mae, round(avg(residual), 6) AS mean_residual,
       count(*) AS rows FROM res GROUP BY algorithm_type""")
def q_residual_summary(spark, sf):
    return rounded(MM.residual_summary(_residuals(spark, sf)))


@query("residual_histogram", f"""{_RES},
x AS (SELECT residual AS x FROM res WHERE residual IS NOT NULL),
rg AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / 15)), 14) AS INTEGER) END AS bin,
             lo, hi FROM x CROSS JOIN rg)
SELECT bin, count(*) AS count, round(lo + bin * (hi - lo) / 15, 6) AS lo,
       round(lo + (bin + 1) * (hi - lo) / 15, 6) AS hi FROM b GROUP BY bin, lo, hi""")
def q_residual_histogram(spark, sf):
    return rounded(R.histogram(_residuals(spark, sf), "residual", 15))


@query("model_policy", f"""{_SCORED},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS prediction FROM runs1 GROUP BY ALL),
grid AS (SELECT wk.workload, wk.algorithm AS algorithm_type, n.num_nodes, CASE WHEN lk.prediction IS NOT NULL THEN greatest(lk.prediction, 0.1) END AS prediction
         FROM wk CROSS JOIN (SELECT unnest(range(1, 9)) AS num_nodes) n
         LEFT JOIN lk ON lk.algorithm_type = wk.algorithm AND lk.num_nodes = n.num_nodes),
opt AS (SELECT workload, algorithm_type, min(CASE WHEN prediction <= 60 THEN num_nodes END) AS n
        FROM grid GROUP BY ALL),
optp AS (SELECT o.*, g.prediction FROM opt o LEFT JOIN grid g
         ON g.workload = o.workload AND g.algorithm_type = o.algorithm_type AND g.num_nodes = coalesce(o.n, 8))
SELECT workload, algorithm_type AS algorithm, 'model' AS policy, CAST(coalesce(n, 8) AS INTEGER) AS nodes,
       CAST(coalesce(n, 8) AS INTEGER) AS cost, round(prediction, 6) AS est_time, n IS NULL AS fallback
FROM optp
UNION ALL
SELECT workload, algorithm, policy, nodes, cost, round(est_time, 6), fallback FROM scored""")
def q_model_policy(spark, sf):
    runs = T.runs(spark, sf)
    opt = OPT.optimise_deadlines(_workloads(spark, sf),
                                 spark.createDataFrame([(60.0,)], "deadline double"),
                                 OPT.lookup_predictor(runs))
    model = OPT.model_policy(opt).drop("deadline")
    rules = scored_policies(spark, sf).select("workload", "algorithm", "policy", "nodes", "cost",
                                              "est_time", "fallback")
    return rounded(model.select(rules.columns).unionByName(rules))


@query("model_policy_metrics", f"""{_SCORED},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS prediction FROM runs1 GROUP BY ALL),
grid AS (SELECT wk.workload, wk.algorithm AS algorithm_type, n.num_nodes, CASE WHEN lk.prediction IS NOT NULL THEN greatest(lk.prediction, 0.1) END AS prediction
         FROM wk CROSS JOIN (SELECT unnest(range(1, 9)) AS num_nodes) n
         LEFT JOIN lk ON lk.algorithm_type = wk.algorithm AND lk.num_nodes = n.num_nodes),
opt AS (SELECT workload, algorithm_type, min(CASE WHEN prediction <= 60 THEN num_nodes END) AS n
        FROM grid GROUP BY ALL),
optp AS (SELECT o.*, g.prediction FROM opt o LEFT JOIN grid g
         ON g.workload = o.workload AND g.algorithm_type = o.algorithm_type AND g.num_nodes = coalesce(o.n, 8)),
allp AS (SELECT 'model' AS policy, coalesce(n, 8) AS nodes, coalesce(n, 8) AS cost, prediction AS est_time,
                60.0::DOUBLE AS deadline, n IS NULL AS fallback FROM optp
         UNION ALL SELECT policy, nodes, cost, est_time, deadline, fallback FROM scored),
m AS (SELECT policy, avg(nodes) AS mean_nodes, avg(cost) AS mean_cost,
             100.0 * avg(CAST(coalesce(est_time <= deadline, false) AND NOT fallback AS DOUBLE)) AS hit_pct,
             count_if(fallback) AS fallbacks, count_if(est_time IS NULL) AS unscored, count(*) AS workloads FROM allp GROUP BY policy)
SELECT policy, round(mean_nodes, 6) AS mean_nodes, round(mean_cost, 6) AS mean_cost, round(hit_pct, 6) AS hit_pct,
       fallbacks, unscored, workloads,
       round(CASE WHEN mean_cost > 0 THEN 100.0 * (SELECT mean_cost FROM m WHERE policy = 'tiered') / mean_cost
                  ELSE 0.0 END, 6) AS cost_efficiency
FROM m""")
def q_model_policy_metrics(spark, sf):
    runs = T.runs(spark, sf)
    opt = OPT.optimise_deadlines(_workloads(spark, sf),
                                 spark.createDataFrame([(60.0,)], "deadline double"),
                                 OPT.lookup_predictor(runs))
    model = OPT.model_policy(opt)
    rules = scored_policies(spark, sf)
    cols = ["policy", "nodes", "cost", "est_time", "deadline", "fallback"]
    both = model.select(cols).unionByName(rules.select(cols))
    return rounded(P.policy_metrics(both))


@query("model_selection")
def q_model_selection(spark, sf):
    """M6 + M7 + M9: boosted trees and random forest with the reference's
    settings, train/test metrics of both, and the pick by test R^2."""
    rf, forest = _forest(spark, sf)
    models = [RM.train(rf, "gbt"), forest]
    best = RM.select_best(models)
    out = None
    for tm in models:
        m = tm.metrics.withColumns({"model": F.lit(tm.kind), "selected": F.lit(tm is best)})
        out = m if out is None else out.unionByName(m)
    return rounded(out)


# ---------------------------------------------------------------- M8, M15, S7, M12 + M17 with a model

@query("regression_scores", f"""WITH {RUNS},
lk AS (SELECT algorithm_type, num_nodes, avg(simulated_time) AS p FROM runs1 WHERE {_BUCKET} < 75 GROUP BY ALL),
x AS (SELECT CASE WHEN {_BUCKET} < 75 THEN 'train' ELSE 'test' END AS split, simulated_time AS y,
             greatest(p, 0.1) AS p FROM runs1 JOIN lk USING (algorithm_type, num_nodes))
SELECT split, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
       round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS rows
FROM x GROUP BY split""")
def q_regression_scores(spark, sf):
    """M8 on both splits, for the lookup predictor learned on the training split."""
    tr, te = RM.split_train_test(T.runs(spark, sf))
    predict = OPT.lookup_predictor(tr)
    x = (predict(tr).withColumn("split", F.lit("train")).unionByName(predict(te).withColumn("split", F.lit("test")))
         .where("prediction IS NOT NULL"))
    return rounded(MM.regression_metrics(x, "simulated_time", "prediction", ["split"]))


@query("cross_deadline")
def q_cross_deadline(spark, sf):
    """M15 with the reference's learner; each run's deadline is derived from
    its id."""
    return rounded(RM.cross_deadline(RM.derived_deadline(_runs_features(spark, sf), T.DEADLINES)))


@query("cross_deadline_summary")
def q_cross_deadline_summary(spark, sf):
    """Mean and sample deviation of the pairs' scores, best and worst pair."""
    pairs = written(RM.cross_deadline(RM.derived_deadline(_runs_features(spark, sf), T.DEADLINES)))
    out = RM.generalisation_summary(pairs)
    return rounded(out.select(
        "mean_r2", "std_r2", "mean_mae", "std_mae",
        *[F.col(f"{k}_pair")[c].alias(f"{k}_{c}") for k in ("best", "worst") for c in ("train_deadline", "test_deadline")]))


@query("model_reload", f"WITH {RUNS} SELECT count(*) AS rows, 0::BIGINT AS differences FROM runs1")
def q_model_reload(spark, sf):
    """Predictions of a saved and loaded model against the original's."""
    data = written(RM._cast_numeric(T.runs(spark, sf), RM.select_features(T.runs(spark, sf))))
    model = RM.build_pipeline(RM.select_features(data), "rf", numTrees=10, maxDepth=4).fit(data)
    path = shared_path(spark, "model")
    RM.save_model(model, path)
    a, b = (RM.predict(m, data).select("run_id", F.col("prediction").alias(n)) for m, n in
            ((model, "a"), (RM.load_model(path), "b")))
    return a.join(b, "run_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differences"))


@query("model_policy_fitted")
def q_model_policy_fitted(spark, sf):
    """M12 and M17 with a fitted forest as the predictor."""
    rf, tm = _forest(spark, sf)
    wl = (rf.groupBy(F.col("graph_name").alias("workload"), "algorithm_type")
          .agg(*[F.first(c).cast("double").alias(c) for c in ("nodes", "edges", "density", "avg_clustering")]))
    predict = lambda grid: RM.predict(tm.model, RM._cast_numeric(grid, tm.features))
    out = OPT.model_policy(OPT.optimise_deadlines(wl, T.deadlines(spark), predict))
    return rounded(out.withColumns({c: F.col(c).cast("int") for c in ("nodes", "cost")}))
