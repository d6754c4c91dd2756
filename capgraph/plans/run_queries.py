"""Registered run-analytics queries (A1-A28) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import sql_corr
from ..operators import runs as R
from ..operators.graph import features as FT
from ..operators.graph import pagerank as PR
from ..sources import tables as T
from .registry import query, rounded
from .sql_views import EDGES_RUNS, RUNS, features_sql, pagerank_converged_sql

ALG = R.ALG
DL = "(VALUES (20.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE), (60.0::DOUBLE)) d(deadline)"


def _runs(spark, sf):
    return T.runs(spark, sf)


def _runs_features(spark, sf):
    feats = FT.graph_features(T.run_graph_edges(spark, sf))
    return R.assemble_runs(T.runs(spark, sf), feats.drop("sampled"))


W = f"WITH {RUNS}"

# ---------------------------------------------------------------- A1, A2


@query("deadline_flags", f"""{W}
SELECT run_id, simulated_time <= 20 AS meets_deadline_20s, simulated_time <= 30 AS meets_deadline_30s,
       simulated_time <= 45 AS meets_deadline_45s, simulated_time <= 60 AS meets_deadline_60s
FROM runs1""")
def q_deadline_flags(spark, sf):
    return R.with_deadline_flags(_runs(spark, sf)).select(
        "run_id", *[R.flag_name(d) for d in T.DEADLINES])


@query("deadline_long", f"""{W}
SELECT run_id, deadline, simulated_time <= deadline AS meets_deadline FROM runs1 CROSS JOIN {DL}""")
def q_deadline_long(spark, sf):
    return R.deadline_long(_runs(spark, sf), T.deadlines(spark)).select(
        "run_id", "deadline", "meets_deadline")


_CATEGORY = """CASE WHEN simulated_time < 10 THEN 'fast' WHEN simulated_time < 30 THEN 'medium'
                   WHEN simulated_time < 60 THEN 'slow' ELSE 'very_slow' END"""


@query("runtime_category", f"{W} SELECT run_id, {_CATEGORY} AS execution_category FROM runs1")
def q_runtime_category(spark, sf):
    return R.with_runtime_category(_runs(spark, sf)).select("run_id", "execution_category")


# ---------------------------------------------------------------- A3-A10

_PROFILE = f"""{W},
p AS (SELECT algorithm_type, count(*) AS total_runs,
             count_if(simulated_time >= 10) AS substantial_runs,
             count_if(simulated_time >= 30) AS long_runs,
             count_if(simulated_time < 5) AS short_runs,
             min(simulated_time) AS min_time, max(simulated_time) AS max_time,
             avg(simulated_time) AS mean_time, median(simulated_time) AS median_time
      FROM runs1 GROUP BY algorithm_type)"""


@query("algorithm_profile", f"""{_PROFILE}
SELECT algorithm_type, total_runs, substantial_runs, long_runs, short_runs,
       round(min_time, 6) AS min_time, round(max_time, 6) AS max_time,
       round(mean_time, 6) AS mean_time, round(median_time, 6) AS median_time,
       round(100.0 * substantial_runs / total_runs, 6) AS substantial_pct,
       round(100.0 * long_runs / total_runs, 6) AS long_pct,
       round(100.0 * short_runs / total_runs, 6) AS short_pct
FROM p""")
def q_algorithm_profile(spark, sf):
    return rounded(R.algorithm_profile(_runs(spark, sf)))


@query("distribution_check", f"""{_PROFILE},
c AS (SELECT algorithm_type, total_runs, substantial_runs, short_runs,
             substantial_runs >= 3 AND short_runs <= 0.7 * total_runs AS passed FROM p)
SELECT *, (SELECT bool_and(passed) FROM c) AS all_passed FROM c""")
def q_distribution_check(spark, sf):
    return R.distribution_check(_runs(spark, sf))


@query("overall_summary", f"""{W}
SELECT count(*) AS total_runs, count(DISTINCT graph_name) AS graphs,
       count(DISTINCT algorithm_type) AS algorithms, round(avg(simulated_time), 6) AS mean_time,
       round(min(simulated_time), 6) AS min_time, round(max(simulated_time), 6) AS max_time,
       round(avg(node_cost), 6) AS mean_cost
FROM runs1""")
def q_overall_summary(spark, sf):
    return rounded(R.overall_summary(_runs(spark, sf)))


@query("deadline_hit_rates", f"""{W}
SELECT deadline, count(*) AS runs, count_if(simulated_time <= deadline) AS hits,
       round(100.0 * count_if(simulated_time <= deadline) / count(*), 6) AS hit_rate_pct
FROM runs1 CROSS JOIN {DL} GROUP BY deadline""")
def q_deadline_hit_rates(spark, sf):
    return rounded(R.deadline_hit_rates(_runs(spark, sf), T.deadlines(spark)))


@query("deadline_hit_rates_by_algorithm", f"""{W}
SELECT deadline, algorithm_type, count(*) AS runs, count_if(simulated_time <= deadline) AS hits,
       round(100.0 * count_if(simulated_time <= deadline) / count(*), 6) AS hit_rate_pct
FROM runs1 CROSS JOIN {DL} GROUP BY deadline, algorithm_type""")
def q_deadline_hit_rates_by_algorithm(spark, sf):
    return rounded(R.deadline_hit_rates(_runs(spark, sf), T.deadlines(spark), by_algorithm=True))


@query("algorithm_report", f"""{W}
SELECT algorithm_type, count(*) AS runs, round(avg(simulated_time), 6) AS mean_time,
       round(100.0 * count_if(simulated_time >= 10) / count(*), 6) AS substantial_pct,
       round(100.0 * count_if(simulated_time <= 60) / count(*), 6) AS hit_rate_pct,
       round(median(simulated_time), 6) AS median_time
FROM runs1 GROUP BY algorithm_type""")
def q_algorithm_report(spark, sf):
    return rounded(R.algorithm_report(_runs(spark, sf)))


@query("resource_correlation", f"""{W}
SELECT algorithm_type,
       round({sql_corr('total_memory_gb', 'simulated_time')}, 6) AS memory_corr,
       round({sql_corr('total_cores', 'simulated_time')}, 6) AS cores_corr
FROM runs1 GROUP BY algorithm_type""")
def q_resource_correlation(spark, sf):
    return rounded(R.resource_correlation(_runs(spark, sf)))


@query("category_counts", f"""{W},
c AS (SELECT {_CATEGORY} AS execution_category, count(*) AS runs FROM runs1 GROUP BY 1)
SELECT execution_category, runs, round(100.0 * runs / (SELECT sum(runs) FROM c), 6) AS pct FROM c""")
def q_category_counts(spark, sf):
    return rounded(R.category_counts(_runs(spark, sf)))


@query("category_pivot", f"""{W},
c AS (SELECT algorithm_type, {_CATEGORY} AS cat FROM runs1)
SELECT algorithm_type, count_if(cat = 'fast') AS fast, count_if(cat = 'medium') AS medium,
       count_if(cat = 'slow') AS slow, count_if(cat = 'very_slow') AS very_slow
FROM c GROUP BY algorithm_type""")
def q_category_pivot(spark, sf):
    return R.category_pivot(_runs(spark, sf))


# ---------------------------------------------------------------- A11-A16

def _hist_sql(src: str, col: str, bins: int, by: str | None) -> str:
    k = f"{by}, " if by else ""
    join = f"JOIN rg USING ({by})" if by else "CROSS JOIN rg"
    grp = f"GROUP BY {by}" if by else ""
    return f"""x AS (SELECT {k}{col} AS x FROM {src} WHERE {col} IS NOT NULL),
rg AS (SELECT {k}min(x) AS lo, max(x) AS hi FROM x {grp}),
b AS (SELECT {k}CASE WHEN hi = lo THEN 0
                     ELSE CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) END AS bin,
             lo, hi FROM x {join})
SELECT {k}bin, count(*) AS count, round(lo + bin * (hi - lo) / {bins}, 6) AS lo,
       round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS hi
FROM b GROUP BY {k}bin, lo, hi"""


@query("runtime_histogram", f"{W}, " + _hist_sql("runs1", "simulated_time", 15, "algorithm_type"))
def q_runtime_histogram(spark, sf):
    return rounded(R.histogram(_runs(spark, sf), "simulated_time", 15, [ALG]))


@query("runtime_histogram_10", f"{W}, " + _hist_sql("runs1", "simulated_time", 10, "algorithm_type"))
def q_runtime_histogram_10(spark, sf):
    """A11, the 10-bin per-algorithm runtime histogram (shown when the runs
    carry no deadline flags)."""
    return rounded(R.histogram(_runs(spark, sf), "simulated_time", 10, [ALG]))


@query("resource_score_runtime", f"""{W}
SELECT algorithm_type, CAST(total_cores + 0.5 * total_memory_gb AS DOUBLE) AS resource_score,
       round(avg(simulated_time), 6) AS mean_time, count(*) AS runs
FROM runs1 GROUP BY ALL""")
def q_resource_score_runtime(spark, sf):
    return rounded(R.resource_score_runtime(_runs(spark, sf)))


@query("scaling_curve", f"""{W}
SELECT algorithm_type, num_nodes, round(avg(simulated_time), 6) AS mean_time, count(*) AS runs
FROM runs1 GROUP BY ALL""")
def q_scaling_curve(spark, sf):
    return rounded(R.scaling_curve(_runs(spark, sf)))


@query("log_size_runtime", features_sql() + """
SELECT algorithm_type, graph_name, round(log10(any_value(nodes)), 6) AS log10_nodes,
       round(log10(any_value(density)), 6) AS log10_density, round(avg(simulated_time), 6) AS mean_time
FROM rf WHERE density > 0 AND nodes > 0 GROUP BY algorithm_type, graph_name""")
def q_log_size_runtime(spark, sf):
    return rounded(R.log_size_runtime(_runs_features(spark, sf)))


@query("dataset_summary", features_sql() + """
SELECT graph_name, round(arg_min(nodes, run_id) / 1000.0, 6) AS nodes_k,
       round(arg_min(edges, run_id) / 1000.0, 6) AS edges_k,
       round(arg_min(density, run_id) * 10000.0, 6) AS density_x1e4
FROM rf GROUP BY graph_name""")
def q_dataset_summary(spark, sf):
    return rounded(R.dataset_summary(_runs_features(spark, sf)))


@query("mean_runtime_by_algorithm", f"""{W}
SELECT algorithm_type, round(avg(simulated_time), 6) AS mean_time FROM runs1 GROUP BY algorithm_type""")
def q_mean_runtime_by_algorithm(spark, sf):
    return rounded(R.mean_runtime_by_algorithm(_runs(spark, sf)))


# ---------------------------------------------------------------- A17-A21

_KEYG = f"""{W},
names AS (SELECT DISTINCT graph_name FROM runs1),
pref AS (SELECT graph_name FROM names
         WHERE graph_name IN ('p2p-Gnutella06', 'ca-AstroPh', 'email-EuAll', 'ca-HepPh')),
keyg AS (SELECT graph_name FROM pref WHERE (SELECT count(*) FROM pref) >= 4
         UNION ALL
         SELECT graph_name FROM (SELECT graph_name FROM names ORDER BY graph_name LIMIT 4)
         WHERE (SELECT count(*) FROM pref) < 4)"""


@query("key_datasets", f"{_KEYG} SELECT graph_name FROM keyg")
def q_key_datasets(spark, sf):
    return R.key_datasets(_runs(spark, sf))


@query("cheapest_passing_config", f"""{_KEYG},
algos AS (SELECT DISTINCT algorithm_type FROM runs1),
agg AS (SELECT graph_name, algorithm_type,
               min(CASE WHEN simulated_time <= 60 THEN num_nodes END) AS hit, max(num_nodes) AS mx
        FROM runs1 GROUP BY ALL)
SELECT k.graph_name, substr(k.graph_name, 1, 10) AS graph_label, a.algorithm_type,
       CAST(coalesce(hit, mx, 1) AS INTEGER) AS optimal_nodes, hit IS NOT NULL AS meets_deadline
FROM keyg k CROSS JOIN algos a LEFT JOIN agg ON agg.graph_name = k.graph_name
     AND agg.algorithm_type = a.algorithm_type""")
def q_cheapest_passing_config(spark, sf):
    runs = _runs(spark, sf)
    return R.cheapest_passing_config(runs, R.key_datasets(runs))


@query("cheapest_config_without_deadline", f"""{_KEYG},
algos AS (SELECT DISTINCT algorithm_type FROM runs1),
agg AS (SELECT graph_name, algorithm_type, arg_min(num_nodes, (simulated_time, num_nodes)) AS hit
        FROM runs1 GROUP BY ALL)
SELECT k.graph_name, substr(k.graph_name, 1, 10) AS graph_label, a.algorithm_type,
       CAST(coalesce(hit, 1) AS INTEGER) AS optimal_nodes, hit IS NOT NULL AS meets_deadline
FROM keyg k CROSS JOIN algos a LEFT JOIN agg ON agg.graph_name = k.graph_name
     AND agg.algorithm_type = a.algorithm_type""")
def q_cheapest_config_without_deadline(spark, sf):
    """A17 where runs have no deadline: the fastest run's nodes."""
    runs = _runs(spark, sf)
    return R.cheapest_passing_config(runs, R.key_datasets(runs), deadline=None)


_PREFERRED = tuple(f"g{k}" for k in range(1, 21))


@query("key_datasets_preferred", f"""{W}
SELECT DISTINCT graph_name FROM runs1 WHERE graph_name IN {_PREFERRED}""")
def q_key_datasets_preferred(spark, sf):
    """A21 where at least one preferred graph is there."""
    return R.key_datasets(_runs(spark, sf), _PREFERRED, minimum=1)


@query("runs_csv_roundtrip", f"""{W}
SELECT run_id, graph_name, algorithm_type, round(simulated_time, 6) AS simulated_time, num_nodes,
       cores_per_node, memory_per_node_gb, total_cores, total_memory_gb, node_cost FROM runs1""")
def q_runs_csv_roundtrip(spark, sf):
    """S5 + S6: the runs written as CSV with a header and scanned back with
    their schema."""
    from ..session import shared_path
    from ..sources import files as S
    runs, path = _runs(spark, sf), shared_path(spark, "runs_csv")
    S.write_table(runs, path, "csv")
    return rounded(S.read_runs_csv(spark, path, runs.schema))


@query("fastest_config", f"""{W}
SELECT graph_name, algorithm_type, num_nodes, total_memory_gb, round(simulated_time, 6) AS min_time
FROM runs1
QUALIFY row_number() OVER (PARTITION BY graph_name, algorithm_type
                           ORDER BY simulated_time, num_nodes, run_id) = 1""")
def q_fastest_config(spark, sf):
    return rounded(R.fastest_config(_runs(spark, sf)))


def _corr_cols():
    return list(R.CORE_FEATURES) + [R.RT, "algorithm_type_encoded"]


_ENC = """,
enc AS (SELECT rf.*, e.algorithm_type_encoded FROM rf JOIN
        (SELECT algorithm_type, CAST(dense_rank() OVER (ORDER BY algorithm_type) - 1 AS INTEGER)
                AS algorithm_type_encoded
         FROM (SELECT DISTINCT algorithm_type FROM rf)) e USING (algorithm_type))"""


def _corr_matrix_sql() -> str:
    cols = _corr_cols()
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    sel = ",\n".join(f"{sql_corr(a, b)} AS \"{a}|{b}\"" for a, b in pairs)
    return features_sql() + _ENC + f""",
agg AS (SELECT {sel} FROM enc),
u AS (FROM agg UNPIVOT INCLUDE NULLS (corr FOR pair IN (COLUMNS(*))))
SELECT split_part(pair, '|', 1) AS row_feature, split_part(pair, '|', 2) AS col_feature,
       round(corr, 6) AS corr FROM u"""


@query("correlation_matrix", _corr_matrix_sql())
def q_correlation_matrix(spark, sf):
    return rounded(R.correlation_matrix(_runs_features(spark, sf)))


def _corr_rank_sql() -> str:
    cols = list(R.CORE_FEATURES) + ["algorithm_type_encoded"]
    sel = ",\n".join(f"abs({sql_corr(c, R.RT)}) AS \"{c}\"" for c in cols)
    return features_sql() + _ENC + f""",
agg AS (SELECT {sel} FROM enc),
u AS (FROM agg UNPIVOT INCLUDE NULLS (abs_corr FOR feature IN (COLUMNS(*)))),
r AS (SELECT feature, abs_corr,
             row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, feature) AS rank FROM u)
SELECT feature, round(abs_corr, 6) AS abs_corr, CAST(rank AS INTEGER) AS rank,
       CASE WHEN abs_corr >= 0.7 THEN 'Strong' WHEN abs_corr >= 0.5 THEN 'Moderate'
            WHEN abs_corr >= 0.3 THEN 'Weak' ELSE 'Very Weak' END AS strength
FROM r WHERE rank <= 5"""


@query("runtime_correlation_ranking", _corr_rank_sql())
def q_runtime_correlation_ranking(spark, sf):
    out = R.runtime_correlation_ranking(_runs_features(spark, sf))
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


# ---------------------------------------------------------------- A22-A28

@query("experiment_design", f"""{W},
l AS (SELECT runs1.*, deadline, simulated_time <= deadline AS meets_deadline FROM runs1 CROSS JOIN {DL}),
dims AS (SELECT count(*) AS n, count(DISTINCT graph_name) AS g, count(DISTINCT algorithm_type) AS a,
                count(DISTINCT deadline) AS d FROM l)
SELECT deadline, count(*) AS runs, count_if(meets_deadline) AS hits,
       round(100.0 * count_if(meets_deadline) / count(*), 6) AS hit_rate_pct,
       CAST(floor(any_value(n) / (any_value(g) * any_value(a) * any_value(d))) AS BIGINT) AS configs_per_combo
FROM l CROSS JOIN dims GROUP BY deadline""")
def q_experiment_design(spark, sf):
    return rounded(R.experiment_design(_runs(spark, sf), T.deadlines(spark)))


@query("median_success_rate", f"""{W},
m AS (SELECT median(simulated_time) AS median_time FROM runs1)
SELECT round(any_value(median_time), 6) AS median_time,
       round(100.0 * count_if(simulated_time <= median_time) / count(*), 6) AS success_rate_pct
FROM runs1 CROSS JOIN m""")
def q_median_success_rate(spark, sf):
    return rounded(R.median_success_rate(_runs(spark, sf)))


@query("systematic_sample", f"""{W}
SELECT run_id, graph_name, algorithm_type, round(simulated_time, 6) AS simulated_time, num_nodes
FROM runs1 QUALIFY (row_number() OVER (ORDER BY run_id) - 1) % 12 = 0""")
def q_systematic_sample(spark, sf):
    out = R.systematic_sample(_runs(spark, sf), 12)
    return rounded(out.select("run_id", "graph_name", ALG, "simulated_time", "num_nodes"))


@query("tight_deadline_failures", f"""{W}
SELECT deadline, algorithm_type, count_if(NOT (simulated_time <= deadline)) AS misses, count(*) AS runs
FROM runs1 CROSS JOIN (VALUES (20.0::DOUBLE), (30.0::DOUBLE)) d(deadline) GROUP BY ALL""")
def q_tight_deadline_failures(spark, sf):
    return R.tight_deadline_failures(_runs(spark, sf))


_TRADEOFF = f"""{W},
a AS (SELECT algorithm_type, node_cost AS cost, avg(simulated_time) AS mean_time,
             min(simulated_time) AS min_time, count(*) AS runs FROM runs1 GROUP BY ALL),
f AS (SELECT *, min(min_time) OVER (PARTITION BY algorithm_type ORDER BY cost
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM a)
SELECT algorithm_type, cost, round(mean_time, 6) AS mean_time, round(min_time, 6) AS min_time, runs,
       best_before IS NULL OR min_time < best_before AS frontier
FROM f"""


@query("cost_tradeoff", _TRADEOFF)
def q_cost_tradeoff(spark, sf):
    return rounded(R.cost_tradeoff(_runs(spark, sf)))


@query("cost_tradeoff_by_nodes", _TRADEOFF)
def q_cost_tradeoff_by_nodes(spark, sf):
    """A26 for runs without a cost column."""
    return rounded(R.cost_tradeoff(_runs(spark, sf).drop("node_cost")))


@query("runtime_series", features_sql() + """
SELECT algorithm_type, CAST(total_memory_gb AS DOUBLE) AS x, round(avg(simulated_time), 6) AS mean_time,
       count(*) AS runs, 'total_memory_gb' AS series FROM rf GROUP BY ALL
UNION ALL
SELECT algorithm_type, CAST(nodes AS DOUBLE), round(avg(simulated_time), 6), count(*), 'nodes'
FROM rf WHERE nodes IS NOT NULL GROUP BY ALL
UNION ALL
SELECT algorithm_type, round(density, 6), round(avg(simulated_time), 6), count(*), 'density'
FROM rf WHERE density IS NOT NULL GROUP BY algorithm_type, density""")
def q_runtime_series(spark, sf):
    rf = _runs_features(spark, sf)
    out = None
    for x in ("total_memory_gb", "nodes", "density"):
        s = R.runtime_series(rf, x).withColumn("x", F.col("x").cast("double"))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


@query("assembled_runs", features_sql() + """
SELECT run_id, graph_name, algorithm_type, round(simulated_time, 6) AS simulated_time, num_nodes,
       cores_per_node, memory_per_node_gb, total_cores, total_memory_gb, node_cost, nodes, edges,
       round(density, 6) AS density, is_connected, num_components, round(avg_clustering, 6) AS avg_clustering,
       meets_deadline_20s, meets_deadline_30s, meets_deadline_45s, meets_deadline_60s, execution_category
FROM rf""")
def q_assembled_runs(spark, sf):
    return rounded(_runs_features(spark, sf))


@query("assembled_runs_outcomes", pagerank_converged_sql(EDGES_RUNS) + f""", {RUNS}
SELECT run_id, r.graph_name, algorithm_type, round(simulated_time, 6) AS simulated_time, iterations AS num_iterations, converged,
       CASE algorithm_type WHEN 'PageRank' THEN 'iterative' WHEN 'ConnectedComponents' THEN 'traversal'
                           WHEN 'TriangleCounting' THEN 'memory_intensive' END AS algorithm_category,
       CAST(NULL AS DOUBLE) AS actual_time, CAST(NULL AS VARCHAR) AS scaling_reason
FROM runs1 r LEFT JOIN (SELECT graph_name, any_value(iterations) AS iterations, any_value(done) AS converged FROM s40 GROUP BY graph_name) p
     USING (graph_name)""")
def q_assembled_runs_outcomes(spark, sf):
    """A28's columns on how each run went: PageRank's rounds on the run's graph."""
    ranks = PR.pagerank_converged(T.run_graph_edges(spark, sf), max_iter=40)
    outcomes = ranks.groupBy("graph_name").agg(F.max("iterations").alias("num_iterations"), F.first("converged").alias("converged"))
    runs = R.assemble_runs(T.runs(spark, sf), T.runs(spark, sf).select("graph_name").distinct(), outcomes=outcomes)
    return rounded(runs.select("run_id", "graph_name", "algorithm_type", "simulated_time", "num_iterations", "converged",
                               "algorithm_category", "actual_time", "scaling_reason"))
