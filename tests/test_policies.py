"""Sizing rules against hand-computed allocations for published graph sizes."""
from capgraph.operators import policies as P


def test_rules_on_reference_graph_sizes(spark):
    # (workload, algorithm, edges, density) for two graphs of the reference's goldens
    rows = [("web-Google", "TriangleCounting", 4322051, 2 * 4322051 / (875713 * 875712)),
            ("ca-GrQc", "PageRank", 14496, 2 * 14496 / (5242 * 5241)),
            ("ca-GrQc", "ConnectedComponents", 14496, 2 * 14496 / (5242 * 5241))]
    w = spark.createDataFrame(rows, "workload string, algorithm string, edges long, density double")
    got = {(r["workload"], r["algorithm"], r["policy"]): r["nodes"]
           for r in P.size_workloads(w).collect()}
    want = {
        ("web-Google", "TriangleCounting", "log"): 4, ("web-Google", "TriangleCounting", "sqrt"): 8,
        ("web-Google", "TriangleCounting", "linear"): 8, ("web-Google", "TriangleCounting", "fixed"): 4,
        ("web-Google", "TriangleCounting", "tiered"): 4,
        ("ca-GrQc", "PageRank", "log"): 2, ("ca-GrQc", "PageRank", "sqrt"): 3,
        ("ca-GrQc", "PageRank", "linear"): 1, ("ca-GrQc", "PageRank", "fixed"): 4,
        ("ca-GrQc", "PageRank", "tiered"): 1,
        ("ca-GrQc", "ConnectedComponents", "log"): 2, ("ca-GrQc", "ConnectedComponents", "sqrt"): 2,
        ("ca-GrQc", "ConnectedComponents", "linear"): 1,
    }
    for k, v in want.items():
        assert got[k] == v, k


def test_metrics_fallback_not_a_hit(spark):
    rows = [("w1", "a", "model", 8, 8, 70.0, 60.0, True), ("w2", "a", "model", 2, 2, 30.0, 60.0, False),
            ("w1", "a", "tiered", 1, 1, 50.0, 60.0, False), ("w2", "a", "tiered", 1, 1, 90.0, 60.0, False)]
    df = spark.createDataFrame(rows, "workload string, algorithm string, policy string, nodes int, "
                                     "cost int, est_time double, deadline double, fallback boolean")
    m = {r["policy"]: r for r in P.policy_metrics(df).collect()}
    assert m["model"]["hit_pct"] == 50.0 and m["model"]["fallbacks"] == 1
    assert m["model"]["cost_efficiency"] == 100.0 * 1.0 / 5.0
    best = P.best_policies(P.policy_metrics(df)).first()
    assert best["lowest_cost_policy"] == "tiered"
    wide = P.to_wide(P.rank_policies(df), policies=("model", "tiered"))
    back = P.to_long(wide, policies=("model", "tiered"))
    assert back.count() == 4


COLS = ("workload string, algorithm string, policy string, nodes int, cost int, est_time double, deadline double, "
        "fallback boolean")


def test_metrics_without_the_reference_policy(spark):
    rows = [("w1", "a", "log", 4, 4, 50.0, 60.0, False), ("w1", "a", "sqrt", 2, 2, 70.0, 60.0, False)]
    m = {r["policy"]: r for r in P.policy_metrics(spark.createDataFrame(rows, COLS)).collect()}
    # the lowest mean cost stands in for the reference's
    assert m["log"]["cost_efficiency"] == 50.0 and m["sqrt"]["cost_efficiency"] == 100.0
    assert P.best_policies(P.policy_metrics(spark.createDataFrame(rows, COLS))).first()["lowest_cost_policy"] == "sqrt"


def test_overview_counts_policies_with_nodes(spark):
    rows = [("w1", "a", "log", 4, 4, 50.0, 60.0, False), ("w1", "a", "none", 0, 0, 50.0, 60.0, False)]
    assert P.policy_overview(P.policy_metrics(spark.createDataFrame(rows, COLS))).first()["policies"] == 1


def test_choices_never_run_stay_with_a_null_time(spark):
    alloc = spark.createDataFrame([("g1", "a", "log", 2, 2), ("g9", "a", "log", 3, 3)],
                                  "workload string, algorithm string, policy string, nodes int, cost int")
    runs = spark.createDataFrame([("g1", "a", 1, 30.0)], "graph_name string, algorithm_type string, num_nodes int, simulated_time double")
    scored = P.score_against_runs(alloc, runs)
    got = {r["workload"]: r["est_time"] for r in scored.collect()}
    assert got == {"g1": 30.0, "g9": None}
    m = P.policy_metrics(scored).first()
    assert m["unscored"] == 1 and m["workloads"] == 2 and m["hit_pct"] == 50.0
    ranks = {r["workload"]: r["efficiency_score"] for r in P.rank_policies(scored).collect()}
    assert ranks["g9"] is None


def test_zero_runtime_has_no_speedup(spark):
    from capgraph.operators import thresholds as TH
    rows = [("d", "a", 1, 10.0, True), ("d", "a", 2, 0.0, True), ("d", "a", 4, 5.0, True)]
    s = spark.createDataFrame(rows, "dataset string, algorithm string, level int, time double, success boolean")
    got = {r["level"]: r["speedup"] for r in TH.speedup_efficiency(s).collect()}
    assert got == {2: None, 4: 2.0}
    assert TH.mean_efficiency(TH.speedup_efficiency(s)).count() == 2
