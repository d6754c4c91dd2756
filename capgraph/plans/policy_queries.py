"""Registered threshold (R1-R7) and policy (P1-P8) queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policies as P
from ..operators import thresholds as TH
from ..operators.graph import edges as E
from ..sources import tables as T
from .registry import query, rounded
from .sql_views import (CANON, EDGES_RUNS, POLICY_VALUES, RUNS, THRESHOLDS, WORKLOADS,
                        rule_nodes_sql)

WT = f"WITH {RUNS}, {THRESHOLDS}"


def _th(spark, sf):
    return TH.threshold_rows(T.runs(spark, sf))


def _sc(spark, sf):
    return TH.scaling_rows(T.runs(spark, sf))


# ---------------------------------------------------------------- R1-R7

@query("minimum_level", f"""{WT}
SELECT dataset, algorithm, min_level, passing, CAST(min_level * 1.5 AS DOUBLE) AS recommended_level FROM ml""")
def q_minimum_level(spark, sf):
    return TH.minimum_level(_th(spark, sf))


@query("speedup_efficiency", f"""{WT}
SELECT dataset, algorithm, level, round(baseline_time, 6) AS baseline_time,
       round(parallel_time, 6) AS parallel_time, round(speedup, 6) AS speedup,
       round(efficiency, 6) AS efficiency FROM se""")
def q_speedup_efficiency(spark, sf):
    return rounded(TH.speedup_efficiency(_sc(spark, sf)))


@query("efficiency_summary", f"""{WT},
p AS (SELECT algorithm, coalesce(avg(CASE WHEN level = 4 THEN efficiency END), 0.0) AS efficiency_4,
             coalesce(avg(CASE WHEN level = 8 THEN efficiency END), 0.0) AS efficiency_8
      FROM se GROUP BY algorithm)
SELECT algorithm, round(efficiency_4, 6) AS efficiency_4, round(efficiency_8, 6) AS efficiency_8,
       CASE WHEN efficiency_4 > 0.7 THEN 'good' WHEN efficiency_4 > 0.5 THEN 'moderate' ELSE 'low' END
       AS assessment
FROM p""")
def q_efficiency_summary(spark, sf):
    return rounded(TH.efficiency_summary(TH.speedup_efficiency(_sc(spark, sf))))


@query("mean_efficiency", f"""{WT}
SELECT algorithm, level, round(avg(efficiency), 6) AS mean_efficiency, round(avg(speedup), 6) AS mean_speedup
FROM se GROUP BY ALL""")
def q_mean_efficiency(spark, sf):
    return rounded(TH.mean_efficiency(TH.speedup_efficiency(_sc(spark, sf))))


@query("success_rate", f"""{WT}
SELECT algorithm, level, round(100.0 * avg(CAST(success AS DOUBLE)), 6) AS success_rate_pct,
       count(*) AS tests FROM th GROUP BY ALL""")
def q_success_rate(spark, sf):
    return rounded(TH.success_rate(_th(spark, sf)))


@query("failure_report", f"""{WT},
tot AS (SELECT algorithm, count(*) AS total, count_if(success) AS successes,
               min(CASE WHEN success THEN level END) AS min_passing_level FROM th GROUP BY algorithm),
rs AS (SELECT algorithm, failure_reason, count(*) AS n FROM th WHERE NOT success GROUP BY ALL),
top AS (SELECT algorithm, failure_reason, n FROM rs
        QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY n DESC, failure_reason) = 1)
SELECT tot.algorithm, total, successes, round(100.0 * successes / total, 6) AS success_rate_pct,
       min_passing_level, top.failure_reason AS common_failure, top.n AS common_failure_count
FROM tot LEFT JOIN top USING (algorithm)""")
def q_failure_report(spark, sf):
    return rounded(TH.failure_report(_th(spark, sf)))


@query("requirement_summary", f"""{WT}
SELECT algorithm, round(avg(min_level), 6) AS mean_min_level, max(min_level) AS max_min_level,
       arg_min(dataset, (-min_level, dataset)) AS most_demanding
FROM ml GROUP BY algorithm""")
def q_requirement_summary(spark, sf):
    return rounded(TH.requirement_summary(TH.minimum_level(_th(spark, sf))))


@query("level_vs_graph", f"""{WT}, {EDGES_RUNS}, {CANON}
SELECT ml.algorithm, CAST(cnt.nodes AS DOUBLE) AS x, round(avg(min_level), 6) AS mean_min_level,
       count(*) AS datasets, 'nodes' AS series
FROM ml JOIN cnt ON cnt.graph_name = ml.dataset GROUP BY ALL
UNION ALL
SELECT ml.algorithm, round(cnt.density, 6), round(avg(min_level), 6), count(*), 'density'
FROM ml JOIN cnt ON cnt.graph_name = ml.dataset GROUP BY ml.algorithm, cnt.density""")
def q_level_vs_graph(spark, sf):
    ml = TH.minimum_level(_th(spark, sf))
    counts = E.graph_counts(E.canonical_edges(T.run_graph_edges(spark, sf)))
    out = None
    for x in ("nodes", "density"):
        s = TH.level_vs_graph(ml, counts, x).withColumn("x", F.col("x").cast("double"))
        out = s if out is None else out.unionByName(s)
    return rounded(out)


# ---------------------------------------------------------------- P6, P7, P5

@query("sizing_rules", f"""WITH {WORKLOADS}
SELECT workload, algorithm, edges, nodes AS graph_nodes, round(density, 6) AS density, policy,
       {rule_nodes_sql('policy', 'algorithm', 'edges', 'density')} AS nodes
FROM wl CROSS JOIN {POLICY_VALUES}""")
def q_sizing_rules(spark, sf):
    out = P.size_workloads(T.workloads(spark, sf))
    return rounded(out.select("workload", "algorithm", "edges", "graph_nodes", "density",
                              "policy", "nodes"))


def run_workloads(spark, sf):
    """Workloads = the (graph, algorithm) pairs of the runs, sized by the
    graph's co-purchase edge count and density."""
    runs = T.runs(spark, sf)
    counts = E.graph_counts(E.canonical_edges(T.run_graph_edges(spark, sf)))
    pairs = runs.select(F.col("graph_name").alias("workload"),
                        F.col("algorithm_type").alias("algorithm")).distinct()
    c = counts.select(F.col("graph_name").alias("workload"), "edges", "density")
    return (pairs.join(c, "workload", "left")
            .select("workload", "algorithm", F.coalesce("edges", F.lit(0)).alias("edges"),
                    F.coalesce("density", F.lit(0.0)).alias("density")))


def scored_policies(spark, sf):
    alloc = P.size_workloads(run_workloads(spark, sf))
    return P.score_against_runs(alloc, T.runs(spark, sf))


_SCORED = f"""WITH {RUNS}, {EDGES_RUNS}, {CANON},
wk AS (SELECT DISTINCT graph_name AS workload, algorithm_type AS algorithm FROM runs1),
wl AS (SELECT wk.workload, wk.algorithm, coalesce(cnt.edges, 0) AS edges, coalesce(cnt.density, 0.0) AS density
       FROM wk LEFT JOIN cnt ON cnt.graph_name = wk.workload),
alloc AS (SELECT workload, algorithm, policy,
                 {rule_nodes_sql('policy', 'algorithm', 'edges', 'density')} AS nodes
          FROM wl CROSS JOIN {POLICY_VALUES}),
lv AS (SELECT graph_name AS workload, algorithm_type AS algorithm, num_nodes AS level,
              avg(simulated_time) AS t FROM runs1 GROUP BY ALL),
best AS (SELECT a.workload, a.algorithm, a.policy, a.nodes, a.nodes AS cost, lv.level AS tried_level, lv.t AS est_time
         FROM alloc a LEFT JOIN lv ON lv.workload = a.workload AND lv.algorithm = a.algorithm
         QUALIFY row_number() OVER (PARTITION BY a.workload, a.algorithm, a.policy
                                    ORDER BY abs(lv.level - a.nodes), lv.level) = 1),
scored AS (SELECT *, 60.0::DOUBLE AS deadline, false AS fallback FROM best),
pm AS (SELECT policy, avg(nodes) AS mean_nodes, avg(cost) AS mean_cost,
              100.0 * avg(CAST(coalesce(est_time <= deadline, false) AND NOT fallback AS DOUBLE)) AS hit_pct,
              count_if(fallback) AS fallbacks, count_if(est_time IS NULL) AS unscored, count(*) AS workloads FROM scored GROUP BY policy),
pm2 AS (SELECT *, CASE WHEN mean_cost > 0
                       THEN 100.0 * (SELECT mean_cost FROM pm WHERE policy = 'tiered') / mean_cost
                       ELSE 0.0 END AS cost_efficiency FROM pm)"""


@query("policy_scores", f"""{_SCORED}
SELECT workload, algorithm, policy, nodes, cost, tried_level, round(est_time, 6) AS est_time,
       est_time <= deadline AS meets_deadline,
       round(CASE WHEN est_time <= deadline THEN CAST(cost AS DOUBLE)
                  ELSE 2.0 * cost + (est_time - deadline) END, 6) AS efficiency_score,
       CAST(row_number() OVER (PARTITION BY workload, algorithm
            ORDER BY CASE WHEN est_time <= deadline THEN CAST(cost AS DOUBLE)
                          ELSE 2.0 * cost + (est_time - deadline) END, policy) AS INTEGER) AS rank
FROM scored""")
def q_policy_scores(spark, sf):
    r = P.rank_policies(scored_policies(spark, sf))
    return rounded(r.select("workload", "algorithm", "policy", "nodes", "cost", "tried_level",
                            "est_time", "meets_deadline", "efficiency_score",
                            F.col("rank").cast("int").alias("rank")))


# ---------------------------------------------------------------- P1-P4, P8

@query("policy_metrics", f"""{_SCORED}
SELECT policy, round(mean_nodes, 6) AS mean_nodes, round(mean_cost, 6) AS mean_cost,
       round(hit_pct, 6) AS hit_pct, fallbacks, unscored, workloads, round(cost_efficiency, 6) AS cost_efficiency
FROM pm2""")
def q_policy_metrics(spark, sf):
    return rounded(P.policy_metrics(scored_policies(spark, sf)))


@query("best_policies", f"""{_SCORED}
SELECT arg_min(policy, (-hit_pct, policy)) AS best_hit_policy,
       arg_min(policy, (-cost_efficiency, policy)) AS best_efficiency_policy,
       arg_min(policy, (mean_cost, policy)) AS lowest_cost_policy
FROM pm2""")
def q_best_policies(spark, sf):
    return P.best_policies(P.policy_metrics(scored_policies(spark, sf)))


@query("policy_metrics_by_deadline", f"""{_SCORED}
SELECT d.deadline, policy,
       round(100.0 * avg(CAST(coalesce(est_time <= d.deadline, false) AND NOT fallback AS DOUBLE)), 6) AS hit_pct,
       round(avg(nodes), 6) AS mean_nodes
FROM scored CROSS JOIN (VALUES (20.0::DOUBLE), (30.0::DOUBLE), (45.0::DOUBLE), (60.0::DOUBLE)) d(deadline)
GROUP BY d.deadline, policy""")
def q_policy_metrics_by_deadline(spark, sf):
    return rounded(P.metrics_by_deadline(scored_policies(spark, sf), T.deadlines(spark)))


@query("policy_overview", f"""{_SCORED}
SELECT round(avg(CASE WHEN mean_nodes > 0 THEN mean_nodes END), 6) AS mean_nodes,
       round(avg(CASE WHEN hit_pct > 0 THEN hit_pct END), 6) AS mean_hit_pct,
       count_if(mean_nodes > 0) AS policies, round(max(cost_efficiency), 6) AS best_efficiency
FROM pm2""")
def q_policy_overview(spark, sf):
    return rounded(P.policy_overview(P.policy_metrics(scored_policies(spark, sf))))


def _wide_sql():
    cols = []
    for p in P.POLICIES:
        cols += [f"max(CASE WHEN policy = '{p}' THEN nodes END) AS {p}_nodes",
                 f"round(max(CASE WHEN policy = '{p}' THEN est_time END), 6) AS {p}_time",
                 f"max(CASE WHEN policy = '{p}' THEN cost END) AS {p}_cost"]
    return f"""{_SCORED}
SELECT workload, algorithm, {', '.join(cols)} FROM scored GROUP BY workload, algorithm"""


@query("policy_wide", _wide_sql())
def q_policy_wide(spark, sf):
    return rounded(P.to_wide(scored_policies(spark, sf)))


@query("policy_long", f"""{_SCORED}
SELECT workload, algorithm, policy, nodes, round(est_time, 6) AS est_time, cost FROM scored""")
def q_policy_long(spark, sf):
    """P1 back again: the wide table unpivoted."""
    return rounded(P.to_long(P.to_wide(scored_policies(spark, sf))))
