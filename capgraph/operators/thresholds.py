"""Threshold and scaling analytics over observed runs.

The inputs are observed tables, not a simulator:
threshold rows ``(dataset, algorithm, level, success, time, failure_reason)``
and scaling rows ``(dataset, algorithm, level, time, success)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["dataset", "algorithm"]
# Safety margin on the minimum level, efficiency grades.
SAFETY_MARGIN = 1.5
GOOD_EFFICIENCY, MODERATE_EFFICIENCY = 0.7, 0.5


def threshold_rows(runs: DataFrame, deadline: float = 60.0, far: float = 120.0) -> DataFrame:
    """Threshold rows from runs: level = nodes used, success = within the
    deadline, failure reason by how far over it the run went."""
    t = F.col("simulated_time")
    return runs.select(
        F.col("graph_name").alias("dataset"), F.col("algorithm_type").alias("algorithm"),
        F.col("num_nodes").alias("level"), (t <= deadline).alias("success"), t.alias("time"),
        F.when(t <= deadline, F.lit(None).cast("string"))
        .when(t < far, F.lit("deadline_exceeded")).otherwise(F.lit("far_over_deadline"))
        .alias("failure_reason"))


def scaling_rows(runs: DataFrame, deadline: float = 60.0) -> DataFrame:
    """Scaling rows: mean runtime per dataset x algorithm x level; a cell
    succeeds when every run in it met the deadline."""
    return (runs.groupBy(F.col("graph_name").alias("dataset"),
                         F.col("algorithm_type").alias("algorithm"),
                         F.col("num_nodes").alias("level"))
            .agg(F.avg("simulated_time").alias("time"),
                 F.every(F.col("simulated_time") <= deadline).alias("success")))


def minimum_level(t: DataFrame, margin: float = SAFETY_MARGIN) -> DataFrame:
    """Smallest passing level per dataset x algorithm (the largest level
    tried when none passes), and the recommended level ``1.5 x`` that."""
    return (t.groupBy(*KEYS)
            .agg(F.coalesce(F.min(F.when(F.col("success"), F.col("level"))), F.max("level"))
                 .alias("min_level"),
                 F.count_if("success").alias("passing"))
            .withColumn("recommended_level", F.col("min_level") * F.lit(margin)))


def speedup_efficiency(scaling: DataFrame, base_level: int = 1) -> DataFrame:
    """R2: speedup = time at the base level / time at level L, efficiency =
    speedup / L, where both cells succeeded (null for a zero time).  The base rows are one per
    dataset x algorithm, joined back on the key."""
    base = (scaling.filter((F.col("level") == base_level) & F.col("success"))
            .select(*KEYS, F.col("time").alias("baseline_time")))
    par = scaling.filter((F.col("level") != base_level) & F.col("success"))
    return (par.join(base, KEYS)
            .select(*KEYS, "level", "baseline_time", F.col("time").alias("parallel_time"),
                    F.try_divide(F.col("baseline_time"), F.col("time")).alias("speedup"))
            .withColumn("efficiency", F.col("speedup") / F.col("level")))


def efficiency_summary(eff: DataFrame, levels=(4, 8)) -> DataFrame:
    """Mean efficiency per algorithm at the given levels (0 when absent)
    and a grade from the first: > .7 good, > .5 moderate, else low."""
    p = (eff.groupBy("algorithm").pivot("level", list(levels)).agg(F.avg("efficiency")))
    for lv in levels:
        p = p.withColumnRenamed(str(lv), f"efficiency_{lv}")
    p = p.fillna(0.0, subset=[f"efficiency_{lv}" for lv in levels])
    first = F.col(f"efficiency_{levels[0]}")
    return p.withColumn("assessment", F.when(first > GOOD_EFFICIENCY, F.lit("good"))
                        .when(first > MODERATE_EFFICIENCY, F.lit("moderate"))
                        .otherwise(F.lit("low")))


def mean_efficiency(eff: DataFrame) -> DataFrame:
    """R3 (long): mean efficiency per algorithm x level."""
    return eff.groupBy("algorithm", "level").agg(F.avg("efficiency").alias("mean_efficiency"),
                                                  F.avg("speedup").alias("mean_speedup"))


def success_rate(t: DataFrame) -> DataFrame:
    """Success rate (%) per algorithm x level."""
    return (t.groupBy("algorithm", "level")
            .agg((100.0 * F.avg(F.col("success").cast("double"))).alias("success_rate_pct"),
                 F.count(F.lit(1)).alias("tests")))


def failure_report(t: DataFrame) -> DataFrame:
    """Per algorithm total, successes, rate, smallest passing level and
    the most frequent failure reason with its count (ties by reason)."""
    tot = t.groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"),
        F.min(F.when(F.col("success"), F.col("level"))).alias("min_passing_level"))
    reasons = (t.filter(~F.col("success")).groupBy("algorithm", "failure_reason")
               .agg(F.count(F.lit(1)).alias("n")))
    top = reasons.groupBy("algorithm").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("failure_reason").alias("r"))).alias("m"))
    return (tot.join(top, "algorithm", "left")
            .select("algorithm", "total", "successes",
                    (100.0 * F.col("successes") / F.col("total")).alias("success_rate_pct"),
                    "min_passing_level", F.col("m.r").alias("common_failure"),
                    (-F.col("m.neg")).alias("common_failure_count")))


def requirement_summary(minlev: DataFrame) -> DataFrame:
    """Per algorithm mean and max minimum level and the most demanding
    dataset (ties -> first by name)."""
    return (minlev.groupBy("algorithm")
            .agg(F.avg("min_level").alias("mean_min_level"), F.max("min_level").alias("max_min_level"),
                 F.min(F.struct((-F.col("min_level")).alias("neg"), F.col("dataset").alias("d")))
                 .alias("m"))
            .select("algorithm", "mean_min_level", "max_min_level",
                    F.col("m.d").alias("most_demanding")))


def level_vs_graph(minlev: DataFrame, features: DataFrame, x: str) -> DataFrame:
    """Mean minimum level per algorithm against a graph feature
    (``nodes`` or ``density``) of the dataset."""
    f = features.select(F.col("graph_name").alias("dataset"), F.col(x).alias("x"))
    return (minlev.join(f, "dataset").groupBy("algorithm", "x")
            .agg(F.avg("min_level").alias("mean_min_level"), F.count(F.lit(1)).alias("datasets"))
            .withColumn("series", F.lit(x)))
