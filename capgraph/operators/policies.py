"""Allocation-policy analytics.

Sizing rules are column expressions evaluated for every workload x rule
(the rule table is five fixed rows, broadcast); choices are scored against
observed runtimes, not a runtime formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cluster bounds, per-algorithm complexity weights, and the
# constants of the five sizing rules.
MIN_NODES, MAX_NODES = 1, 8
CORES_PER_NODE, MEMORY_PER_NODE_GB = 4, 8
COMPLEXITY = {"PageRank": 1.0, "ConnectedComponents": 0.8, "TriangleCounting": 5.4}
LOG_RULE = {"min_allocation": 2, "boost": {"high": 2, "medium": 1, "low": 0}}
SQRT_RULE = {"partition_edges": 100000, "density_threshold": 0.001,
             "add": {"TriangleCounting": 2, "PageRank": 1}}
LINEAR_RULE = {"edges_per_node": 50000, "multiplier": {"high": 1.5, "medium": 1.0, "low": 0.8}}
FIXED_NODES = 4
TIERED_EDGES = (150000, 50000)  # TriangleCounting: > 150000 -> 4, > 50000 -> 2, else 1
POLICIES = ("log", "sqrt", "linear", "fixed", "tiered")
REFERENCE_POLICY = "tiered"


def complexity_category(algorithm: Column) -> Column:
    """high when weight > 3, medium when > 1, else low; unknown names weigh 1."""
    w = F.lit(1.0)
    for name, v in COMPLEXITY.items():
        w = F.when(algorithm == name, F.lit(v)).otherwise(w)
    return F.when(w > 3.0, F.lit("high")).when(w > 1.0, F.lit("medium")).otherwise(F.lit("low"))


def _clamp(x: Column) -> Column:
    return F.least(F.lit(MAX_NODES), F.greatest(F.lit(MIN_NODES), x))


def rule_nodes(policy: Column, algorithm: Column, edges: Column, density: Column) -> Column:
    """Node count each sizing rule picks."""
    cat = complexity_category(algorithm)
    # log: log10(max(e, 1000)) / 3, truncated, at least 2, plus complexity boost
    base = F.least(F.lit(MAX_NODES), F.greatest(
        F.lit(2), F.floor(F.log10(F.greatest(edges, F.lit(1000))) / F.lit(3.0))))
    boost = (F.when(cat == "high", F.lit(LOG_RULE["boost"]["high"]))
             .when(cat == "medium", F.lit(LOG_RULE["boost"]["medium"])).otherwise(F.lit(0)))
    log_n = F.greatest(F.lit(LOG_RULE["min_allocation"]), F.least(F.lit(MAX_NODES), base + boost))
    # sqrt: sqrt(max(1, e // 100000)) truncated, algorithm add-on, +1 when dense
    parts = F.greatest(F.lit(1), F.floor(edges / F.lit(SQRT_RULE["partition_edges"])))
    init = F.least(F.lit(MAX_NODES), F.greatest(F.lit(1), F.floor(F.sqrt(parts))))
    add = F.lit(0)
    for name, v in SQRT_RULE["add"].items():
        add = F.when(algorithm == name, F.lit(v)).otherwise(add)
    s = F.greatest(F.lit(1), F.least(F.lit(MAX_NODES), init + add))
    sqrt_n = F.when(density > SQRT_RULE["density_threshold"],
                    F.least(F.lit(MAX_NODES), s + 1)).otherwise(s)
    # linear: e // 50000 (at least 1) scaled by complexity, clamped to 1..8
    size = F.greatest(F.lit(1), F.floor(edges / F.lit(LINEAR_RULE["edges_per_node"])))
    lin = (F.when(cat == "high", F.floor(size * F.lit(LINEAR_RULE["multiplier"]["high"])))
           .when(cat == "medium", size)
           .otherwise(F.greatest(F.lit(1), F.floor(size * F.lit(LINEAR_RULE["multiplier"]["low"])))))
    linear_n = _clamp(lin)
    # tiered: only triangle counting grows with edges
    tiered_n = (F.when((algorithm == "TriangleCounting") & (edges > TIERED_EDGES[0]), F.lit(4))
                .when((algorithm == "TriangleCounting") & (edges > TIERED_EDGES[1]), F.lit(2))
                .otherwise(F.lit(1)))
    return (F.when(policy == "log", log_n).when(policy == "sqrt", sqrt_n)
            .when(policy == "linear", linear_n).when(policy == "fixed", F.lit(FIXED_NODES))
            .when(policy == "tiered", tiered_n)).cast("int")


def size_workloads(workloads: DataFrame, policies=POLICIES) -> DataFrame:
    """Every workload (``workload, algorithm, edges, density``) x every
    rule -> ``nodes, cost, total_cores, total_memory_gb``."""
    spark = workloads.sparkSession
    rules = spark.createDataFrame([(p,) for p in policies], "policy string")
    x = workloads.crossJoin(F.broadcast(rules))
    n = rule_nodes(F.col("policy"), F.col("algorithm"), F.col("edges"), F.col("density"))
    return x.withColumn("nodes", n).withColumns({
        "cost": F.col("nodes"),
        "total_cores": F.col("nodes") * CORES_PER_NODE,
        "total_memory_gb": F.col("nodes") * MEMORY_PER_NODE_GB})


def score_against_runs(alloc: DataFrame, runs: DataFrame, deadline: float = 60.0) -> DataFrame:
    """Each choice gets the mean observed runtime at the nearest tried
    node count (ties -> fewer nodes) for its workload (graph x algorithm); a
    workload that was never run keeps its choices, with a null time."""
    levels = (runs.groupBy(F.col("graph_name").alias("workload"),
                           F.col("algorithm_type").alias("algorithm"),
                           F.col("num_nodes").alias("level"))
              .agg(F.avg("simulated_time").alias("t")))
    j = alloc.join(levels, ["workload", "algorithm"])
    dist = F.struct(F.abs(F.col("level") - F.col("nodes")).alias("d"), F.col("level").alias("l"))
    best = (j.groupBy("workload", "algorithm", "policy")
            .agg(F.min_by(F.struct("level", "t"), dist).alias("b")))
    return (alloc.join(best, ["workload", "algorithm", "policy"], "left")
            .select("workload", "algorithm", "policy", "nodes", "cost",
                    F.col("b.level").alias("tried_level"), F.col("b.t").alias("est_time"),
                    F.lit(float(deadline)).alias("deadline"), F.lit(False).alias("fallback")))


def rank_policies(scored: DataFrame) -> DataFrame:
    """P5: score = cost when the deadline is met, else ``2 cost + overrun``;
    rank ascending per workload (ties -> policy name)."""
    hit = F.col("est_time") <= F.col("deadline")  # null, and ranked last, without a time
    score = F.when(hit, F.col("cost").cast("double")).otherwise(
        2.0 * F.col("cost") + (F.col("est_time") - F.col("deadline")))
    w = Window.partitionBy("workload", "algorithm").orderBy(F.col("efficiency_score").asc_nulls_last(), "policy")
    return (scored.withColumn("meets_deadline", hit).withColumn("efficiency_score", score)
            .withColumn("rank", F.row_number().over(w)))


def policy_metrics(scored: DataFrame, reference: str = REFERENCE_POLICY) -> DataFrame:
    """Per policy mean nodes, mean cost, deadline hit %, cost efficiency
    (reference policy's mean cost / this policy's x 100; without the reference
    policy the lowest mean cost stands in), fallback count, and choices without
    an observed time; neither of these two counts as a hit."""
    hit = F.coalesce((F.col("est_time") <= F.col("deadline")) & ~F.col("fallback"), F.lit(False))
    m = scored.groupBy("policy").agg(
        F.avg("nodes").alias("mean_nodes"), F.avg("cost").alias("mean_cost"),
        (100.0 * F.avg(hit.cast("double"))).alias("hit_pct"),
        F.count_if("fallback").alias("fallbacks"), F.count_if(F.col("est_time").isNull()).alias("unscored"),
        F.count(F.lit(1)).alias("workloads"))
    ref = m.agg(F.coalesce(F.max(F.when(F.col("policy") == reference, F.col("mean_cost"))),
                           F.min("mean_cost")).alias("_ref"))  # one row
    return (m.crossJoin(F.broadcast(ref))
            .withColumn("cost_efficiency", F.when(F.col("mean_cost") > 0,
                                                  100.0 * F.col("_ref") / F.col("mean_cost"))
                        .otherwise(F.lit(0.0)))
            .drop("_ref"))


def best_policies(metrics: DataFrame) -> DataFrame:
    """Best policy by hit %, by cost efficiency, and lowest mean cost
    (ties -> policy name)."""
    return metrics.agg(
        F.min(F.struct((-F.col("hit_pct")).alias("k"), F.col("policy").alias("p")))["p"]
        .alias("best_hit_policy"),
        F.min(F.struct((-F.col("cost_efficiency")).alias("k"), F.col("policy").alias("p")))["p"]
        .alias("best_efficiency_policy"),
        F.min(F.struct(F.col("mean_cost").alias("k"), F.col("policy").alias("p")))["p"]
        .alias("lowest_cost_policy"))


def metrics_by_deadline(scored: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Hit % and mean nodes per deadline x policy (deadlines: a few
    fixed rows, broadcast)."""
    x = scored.drop("deadline").crossJoin(F.broadcast(deadlines.select("deadline")))
    hit = F.coalesce((F.col("est_time") <= F.col("deadline")) & ~F.col("fallback"), F.lit(False))
    return x.groupBy("deadline", "policy").agg(
        (100.0 * F.avg(hit.cast("double"))).alias("hit_pct"), F.avg("nodes").alias("mean_nodes"))


def policy_overview(metrics: DataFrame) -> DataFrame:
    """Mean nodes and mean hit % over policies with a positive value,
    count of policies with positive mean nodes, best cost efficiency."""
    return metrics.agg(
        F.avg(F.when(F.col("mean_nodes") > 0, F.col("mean_nodes"))).alias("mean_nodes"),
        F.avg(F.when(F.col("hit_pct") > 0, F.col("hit_pct"))).alias("mean_hit_pct"),
        F.count_if(F.col("mean_nodes") > 0).alias("policies"), F.max("cost_efficiency").alias("best_efficiency"))


def to_wide(scored: DataFrame, policies=POLICIES) -> DataFrame:
    """Long -> wide, ``{policy}_nodes, {policy}_time, {policy}_cost``."""
    w = (scored.groupBy("workload", "algorithm").pivot("policy", list(policies))
         .agg(F.first("nodes").alias("nodes"), F.first("est_time").alias("time"),
              F.first("cost").alias("cost")))
    return w


def to_long(wide: DataFrame, policies=POLICIES) -> DataFrame:
    """Wide -> long again with ``stack``."""
    parts = ", ".join(f"'{p}', `{p}_nodes`, `{p}_time`, `{p}_cost`" for p in policies)
    return wide.selectExpr("workload", "algorithm",
                           f"stack({len(policies)}, {parts}) AS (policy, nodes, est_time, cost)")
