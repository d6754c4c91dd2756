"""Run analytics over a runs table.

A runs table has one row per observed run: ``run_id, graph_name,
algorithm_type, simulated_time, num_nodes, cores_per_node,
memory_per_node_gb, total_cores, total_memory_gb, node_cost`` and, once
assembled with graph features (A28), ``nodes, edges, density,
avg_clustering, ...``.

Every operator is a grouped aggregate (partial aggregation before the
shuffle), a join against a handful of fixed rows (deadlines, rules: always
broadcast), or a window over an already-aggregated table.  Medians use the
radix-selected exact median in ``ordered.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import correlation_strength, runtime_category
from ..functions.stats import safe_corr
from ..sources.tables import DEADLINES
from ..session import written
from .ordered import exact_median, positions

RT = "simulated_time"
ALG = "algorithm_type"

# Distribution-check thresholds, key datasets, feature groups.
SUBSTANTIAL_S, LONG_S, SHORT_S = 10.0, 30.0, 5.0
MIN_SUBSTANTIAL, MAX_SHORT_SHARE = 3, 0.7
KEY_DATASETS = ("p2p-Gnutella06", "ca-AstroPh", "email-EuAll", "ca-HepPh")
CORE_FEATURES = ("nodes", "edges", "density", "avg_clustering", "num_nodes", "total_cores",
                 "total_memory_gb")
#: Frames of at most so many rows are broadcast; more are joined by a shuffle.
FEW_GROUPS = 10_000
LABEL_CHARS = 10
CATEGORIES = ("fast", "medium", "slow", "very_slow")


def flag_name(d: float) -> str:
    return f"meets_deadline_{int(d)}s"


# ------------------------------------------------------------------ A1, A2

def with_deadline_flags(runs: DataFrame, deadlines=DEADLINES) -> DataFrame:
    """A1 wide: one boolean column per deadline."""
    return runs.withColumns({flag_name(d): F.col(RT) <= F.lit(float(d)) for d in deadlines})


def deadline_long(runs: DataFrame, deadlines: DataFrame) -> DataFrame:
    """A1 long: runs x deadlines (a few fixed rows, broadcast) with
    ``meets_deadline``."""
    return (runs.crossJoin(F.broadcast(deadlines.select("deadline")))
            .withColumn("meets_deadline", F.col(RT) <= F.col("deadline")))


def with_runtime_category(runs: DataFrame) -> DataFrame:
    """A2: fast < 10 <= medium < 30 <= slow < 60 <= very_slow."""
    return runs.withColumn("execution_category", runtime_category(F.col(RT)))


# ------------------------------------------------------------------ A3-A9

def algorithm_profile(runs: DataFrame) -> DataFrame:
    """A3: per algorithm counts and shares of >=10 s, >=30 s, <5 s runs and
    min / max / mean / median runtime."""
    counted = _counted_profile(runs)
    out = _with_median(counted, runs)
    return _shares(out)


def _counted_profile(runs: DataFrame) -> DataFrame:
    t = F.col(RT)
    return runs.groupBy(ALG).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(t >= SUBSTANTIAL_S).alias("substantial_runs"),
        F.count_if(t >= LONG_S).alias("long_runs"),
        F.count_if(t < SHORT_S).alias("short_runs"),
        F.min(t).alias("min_time"), F.max(t).alias("max_time"), F.avg(t).alias("mean_time"))


def _shares(profile: DataFrame) -> DataFrame:
    return profile.withColumns({f"{c}_pct": 100.0 * F.col(f"{c}_runs") / F.col("total_runs")
                                for c in ("substantial", "long", "short")})


def _with_median(agg: DataFrame, runs: DataFrame) -> DataFrame:
    """``agg`` (one row for each algorithm, a null one included) with the
    median runtime."""
    med = exact_median(runs, [ALG], RT, "median_time").withColumnRenamed(ALG, "_alg")
    return agg.join(med, F.col(ALG).eqNullSafe(F.col("_alg")), "left").drop("_alg")


def distribution_check(runs: DataFrame) -> DataFrame:
    """A4: an algorithm passes with >= 3 runs of >= 10 s and at most 70% under
    5 s; ``all_passed`` is the verdict over all algorithms."""
    p = _counted_profile(runs).withColumn(
        "passed", (F.col("substantial_runs") >= MIN_SUBSTANTIAL)
        & (F.col("short_runs") <= F.lit(MAX_SHORT_SHARE) * F.col("total_runs")))
    verdict = p.agg(F.every("passed").alias("all_passed"))  # one row
    return (p.select(ALG, "total_runs", "substantial_runs", "short_runs", "passed")
            .crossJoin(F.broadcast(verdict)))


def overall_summary(runs: DataFrame) -> DataFrame:
    """A5: runs, distinct graphs and algorithms, runtime mean/min/max, mean cost."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_distinct("graph_name").alias("graphs"),
        F.count_distinct(ALG).alias("algorithms"),
        F.avg(RT).alias("mean_time"), F.min(RT).alias("min_time"), F.max(RT).alias("max_time"),
        F.avg("node_cost").alias("mean_cost"))


def deadline_hit_rates(runs: DataFrame, deadlines: DataFrame, by_algorithm: bool = False) -> DataFrame:
    """Hits and hit rate (%) per deadline (and algorithm)."""
    keys = ["deadline"] + ([ALG] if by_algorithm else [])
    return (deadline_long(runs, deadlines).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("runs"),
                 F.count_if("meets_deadline").alias("hits"))
            .withColumn("hit_rate_pct", 100.0 * F.col("hits") / F.col("runs")))


def algorithm_report(runs: DataFrame, deadline: float = 60.0) -> DataFrame:
    """Per algorithm runs, mean, median, share >= 10 s, hit rate at 60 s."""
    t = F.col(RT)
    agg = runs.groupBy(ALG).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(t).alias("mean_time"),
        (100.0 * F.count_if(t >= SUBSTANTIAL_S) / F.count(F.lit(1))).alias("substantial_pct"),
        (100.0 * F.count_if(t <= deadline) / F.count(F.lit(1))).alias("hit_rate_pct"))
    return _with_median(agg, runs)


def resource_correlation(runs: DataFrame) -> DataFrame:
    """Per algorithm corr(runtime, total memory) and corr(runtime, total
    cores); null when either side is constant."""
    return runs.groupBy(ALG).agg(
        safe_corr("total_memory_gb", RT).alias("memory_corr"),
        safe_corr("total_cores", RT).alias("cores_corr"))


def category_counts(runs: DataFrame) -> DataFrame:
    """Runs per runtime category with percentage (the window runs over
    the aggregated four-row table)."""
    c = with_runtime_category(runs).groupBy("execution_category").agg(
        F.count(F.lit(1)).alias("runs"))
    total = c.agg(F.sum("runs").alias("_t"))
    return (c.crossJoin(F.broadcast(total))
            .withColumn("pct", 100.0 * F.col("runs") / F.col("_t")).drop("_t"))


def category_pivot(runs: DataFrame) -> DataFrame:
    """A10: algorithm x category run counts, 0 filled."""
    return (with_runtime_category(runs).groupBy(ALG)
            .pivot("execution_category", list(CATEGORIES)).count().fillna(0))


# ------------------------------------------------------------------ A11-A16

def histogram(df: DataFrame, col: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """``bins`` equal-width bins over [min, max] per group, last edge
    inclusive; ``(by..., bin, lo, hi, count)`` for non-empty bins.

    Rows are counted by group and value first, so only distinct values meet
    their group's range (one row for each group, broadcast while counted to be
    few); null groups are kept."""
    by = list(by or [])
    x = written(df.select(*by, F.col(col).alias("_x")).filter(F.col("_x").isNotNull())
                .groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")))
    rng = written(x.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")))
    few = rng.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "_lo", "_hi")
    if rng.count() <= FEW_GROUPS:
        few = F.broadcast(few)
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    x = x.join(few, same)
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), w)), F.lit(bins - 1))).cast("int")
    return (x.withColumn("bin", b)
            .groupBy(*by, "bin").agg(F.sum("_c").alias("count"),
                                     F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .withColumn("lo", F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins)
            .withColumn("hi", F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins)
            .drop("_lo", "_hi"))


def resource_score_runtime(runs: DataFrame) -> DataFrame:
    """Resource score ``cores + 0.5 * memory`` per algorithm, with mean
    runtime and run count per score."""
    score = F.col("total_cores") + F.lit(0.5) * F.col("total_memory_gb")
    return (runs.groupBy(ALG, score.alias("resource_score"))
            .agg(F.avg(RT).alias("mean_time"), F.count(F.lit(1)).alias("runs")))


def scaling_curve(runs: DataFrame) -> DataFrame:
    """Mean runtime per algorithm x num_nodes."""
    return runs.groupBy(ALG, "num_nodes").agg(F.avg(RT).alias("mean_time"),
                                               F.count(F.lit(1)).alias("runs"))


def log_size_runtime(runs: DataFrame) -> DataFrame:
    """log10 graph size and log10 density (positive only) against mean
    runtime, per algorithm x graph."""
    return (runs.filter((F.col("density") > 0) & (F.col("nodes") > 0))
            .groupBy(ALG, "graph_name")
            .agg(F.first(F.log10("nodes")).alias("log10_nodes"),
                 F.first(F.log10("density")).alias("log10_density"),
                 F.avg(RT).alias("mean_time")))


def dataset_summary(runs: DataFrame, order_col: str = "run_id") -> DataFrame:
    """The first run of each graph (by ``order_col``): size in
    thousands, density x 10000.  ``min_by`` aggregates partially -- no sort."""
    first = runs.groupBy("graph_name").agg(
        F.min_by(F.struct("nodes", "edges", "density"), F.col(order_col)).alias("f"))
    return first.select("graph_name", (F.col("f.nodes") / 1000.0).alias("nodes_k"),
                        (F.col("f.edges") / 1000.0).alias("edges_k"),
                        (F.col("f.density") * 10000.0).alias("density_x1e4"))


def mean_runtime_by_algorithm(runs: DataFrame) -> DataFrame:
    """Mean runtime per algorithm, ascending."""
    return runs.groupBy(ALG).agg(F.avg(RT).alias("mean_time")).orderBy("mean_time", ALG)


# ------------------------------------------------------------------ A17-A21

def key_datasets(runs: DataFrame, preferred=KEY_DATASETS, minimum: int = 4) -> DataFrame:
    """Preferred graphs that are present; if fewer than ``minimum`` of
    them are, the first ``minimum`` graph names instead."""
    names = runs.select("graph_name").distinct()
    spark = runs.sparkSession
    pref = spark.createDataFrame([(p,) for p in preferred], "graph_name string")
    present = names.join(F.broadcast(pref), "graph_name", "left_semi")
    n = present.agg(F.count(F.lit(1)).alias("_n"))
    first = names.orderBy("graph_name").limit(minimum)
    return (present.crossJoin(F.broadcast(n)).filter(F.col("_n") >= minimum)
            .unionByName(first.crossJoin(F.broadcast(n)).filter(F.col("_n") < minimum))
            .select("graph_name"))


def cheapest_passing_config(runs: DataFrame, graphs: DataFrame, deadline: float | None = 60.0) -> DataFrame:
    """Per key graph x algorithm the fewest nodes among runs within the
    deadline; otherwise the most nodes tried; 1 when there are no runs.
    Without a deadline the nodes of the fastest run.  ``graph_label`` is the
    graph name's first ten characters."""
    keys = written(graphs.select("graph_name").distinct())
    few = F.broadcast(keys) if keys.count() <= FEW_GROUPS else keys
    algos = runs.select(ALG).distinct()
    grid = algos.crossJoin(few)
    mine = runs.join(few, "graph_name", "left_semi")
    if deadline is None:
        hit = F.min_by("num_nodes", F.struct(RT, "num_nodes"))
    else:
        hit = F.min(F.when(F.col(RT) <= deadline, F.col("num_nodes")))
    agg = (mine.groupBy("graph_name", ALG).agg(hit.alias("_hit"), F.max("num_nodes").alias("_max"))
           .select(F.col("graph_name").alias("_g"), F.col(ALG).alias("_a"), "_hit", "_max"))
    return (grid.join(agg, (F.col("graph_name") == F.col("_g")) & F.col(ALG).eqNullSafe(F.col("_a")), "left")
            .select("graph_name", ALG, F.substring("graph_name", 1, LABEL_CHARS).alias("graph_label"),
                    F.coalesce("_hit", "_max", F.lit(1)).cast("int").alias("optimal_nodes"),
                    F.col("_hit").isNotNull().alias("meets_deadline")))


def fastest_config(runs: DataFrame) -> DataFrame:
    """The fastest run per graph x algorithm (ties -> fewer nodes, then run id)."""
    key = F.struct(F.col(RT), F.col("num_nodes"), F.col("run_id"))
    return (runs.groupBy("graph_name", ALG)
            .agg(F.min(F.struct(key.alias("k"), F.col("num_nodes").alias("n"),
                                F.col("total_memory_gb").alias("m"))).alias("b"))
            .select("graph_name", ALG, F.col("b.n").alias("num_nodes"),
                    F.col("b.m").alias("total_memory_gb"), F.col(f"b.k.{RT}").alias("min_time")))


def encoded(runs: DataFrame) -> DataFrame:
    """``runs`` with the alphabetical label code of the algorithm, from 0; a
    null algorithm has none.  The codes are a map of the distinct names, so the
    runs aren't shuffled; more than ``FEW_GROUPS`` names are joined."""
    names = written(runs.select(ALG).distinct().where(F.col(ALG).isNotNull()))
    # the window runs over the distinct names only
    codes = names.select(F.col(ALG).alias("_name"),
                         (F.dense_rank().over(Window.orderBy(ALG)) - 1).cast("int").alias("algorithm_type_encoded"))
    if names.count() <= FEW_GROUPS:
        codes = F.broadcast(codes)
    return runs.join(codes, F.col(ALG) == F.col("_name"), "left").drop("_name")


def correlation_matrix(runs: DataFrame, features=CORE_FEATURES, target: str = RT) -> DataFrame:
    """Pearson correlation of every pair among ``features`` + runtime +
    encoded algorithm, strict lower triangle, long form ``(row, col, corr)``.
    One aggregate computes every pair."""
    cols = list(features) + [target, "algorithm_type_encoded"]
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    agg = encoded(runs).agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return agg.selectExpr(f"stack({len(pairs)}, {stack}) AS (row_feature, col_feature, corr)")


def runtime_correlation_ranking(runs: DataFrame, features=CORE_FEATURES, top: int = 5,
                                target: str = RT) -> DataFrame:
    """Features ranked by |corr| with runtime, strength label, top 5."""
    cols = list(features) + ["algorithm_type_encoded"]
    agg = encoded(runs).agg(*[F.abs(safe_corr(c, target)).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = agg.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, abs_corr)")
    w = Window.orderBy(F.col("abs_corr").desc_nulls_last(), "feature")
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .withColumn("strength", correlation_strength(F.col("abs_corr"))))


# ------------------------------------------------------------------ A22-A28

def experiment_design(runs: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Runs per graph x algorithm x deadline (``n // (g a d)``) and the
    hit rate per deadline.  Distinct graphs and algorithms are counted on the
    runs, not on runs x deadlines."""
    dims = runs.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("graph_name").alias("_g"),
                    F.count_distinct(ALG).alias("_a"))  # one row
    per = deadline_long(runs, deadlines).groupBy("deadline").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("meets_deadline").alias("hits"))
    return (per.crossJoin(F.broadcast(dims))
            .select("deadline", "runs", "hits",
                    (100.0 * F.col("hits") / F.col("runs")).alias("hit_rate_pct"),
                    F.floor(F.try_divide(F.col("_n"), F.col("_g") * F.col("_a")))
                    .cast("bigint").alias("configs_per_combo")))


def median_success_rate(runs: DataFrame) -> DataFrame:
    """Without a deadline, success = runtime at or below the median;
    share in percent."""
    med = exact_median(runs, [], RT, "median_time")
    return (runs.crossJoin(F.broadcast(med))
            .agg(F.first("median_time").alias("median_time"),
                 (100.0 * F.count_if(F.col(RT) <= F.col("median_time")) / F.count(F.lit(1)))
                 .alias("success_rate_pct")))


def systematic_sample(runs: DataFrame, every: int = 12, order_col: str = "run_id") -> DataFrame:
    """Every ``every``-th run in ``order_col`` order, starting with the
    first.  Positions come from one range shuffle, not a global window."""
    return (positions(runs, [], order_col).filter((F.col("_pos") - 1) % every == 0)
            .drop("_pos"))


def tight_deadline_failures(runs: DataFrame, deadlines=(20.0, 30.0)) -> DataFrame:
    """Misses per tight deadline (and algorithm)."""
    spark = runs.sparkSession
    d = spark.createDataFrame([(float(x),) for x in deadlines], "deadline double")
    return (deadline_long(runs, d).groupBy("deadline", ALG)
            .agg(F.count_if(~F.col("meets_deadline")).alias("misses"),
                 F.count(F.lit(1)).alias("runs")))


def cost_tradeoff(runs: DataFrame) -> DataFrame:
    """Per algorithm x cost the mean and best runtime; ``frontier`` marks
    costs whose best runtime beats every cheaper cost.  The cost column falls
    back to ``num_nodes`` when ``node_cost`` is absent."""
    cost = "node_cost" if "node_cost" in runs.columns else "num_nodes"
    agg = runs.groupBy(ALG, F.col(cost).alias("cost")).agg(
        F.avg(RT).alias("mean_time"), F.min(RT).alias("min_time"), F.count(F.lit(1)).alias("runs"))
    w = (Window.partitionBy(ALG).orderBy("cost")
         .rowsBetween(Window.unboundedPreceding, -1))
    best_before = F.min("min_time").over(w)
    return agg.withColumn("frontier", best_before.isNull() | (F.col("min_time") < best_before))


def runtime_series(runs: DataFrame, x: str) -> DataFrame:
    """Mean runtime per algorithm x value of ``x`` (memory, size, density)."""
    return (runs.filter(F.col(x).isNotNull()).groupBy(ALG, F.col(x).alias("x"))
            .agg(F.avg(RT).alias("mean_time"), F.count(F.lit(1)).alias("runs"))
            .withColumn("series", F.lit(x)))


#: What kind of work an algorithm is.
ALGORITHM_CATEGORY = {"PageRank": "iterative", "ConnectedComponents": "traversal", "TriangleCounting": "memory_intensive"}


def assemble_runs(observed: DataFrame, features: DataFrame, deadlines=DEADLINES, outcomes: DataFrame | None = None) -> DataFrame:
    """Graph features x configuration x observed runtime -> the runs
    table with totals, cost, deadline flags and runtime category.

    With ``outcomes`` (graph_name, num_iterations, converged: what PageRank took
    on each graph) also those two, algorithm_category (null for other names) and
    what only a caller's table can say: actual_time and scaling_reason, null
    where it doesn't."""
    out = observed.join(features, "graph_name", "left")
    if "total_cores" not in out.columns:
        out = out.withColumns({
            "total_cores": F.col("num_nodes") * F.col("cores_per_node"),
            "total_memory_gb": F.col("num_nodes") * F.col("memory_per_node_gb")})
    if "node_cost" not in out.columns:
        out = out.withColumn("node_cost", F.col("num_nodes"))
    if outcomes is not None:
        out = out.join(outcomes.select("graph_name", "num_iterations", "converged"), "graph_name", "left")
        category = F.create_map(*[F.lit(x) for pair in ALGORITHM_CATEGORY.items() for x in pair])
        out = out.withColumn("algorithm_category", F.try_element_at(category, F.col("algorithm_type")))
        for name, kind in (("actual_time", "double"), ("scaling_reason", "string")):
            if name not in out.columns:
                out = out.withColumn(name, F.lit(None).cast(kind))
    return with_runtime_category(with_deadline_flags(out, deadlines))
