"""Deadline optimiser and the model as an allocation policy.

A predictor is any function ``DataFrame -> DataFrame`` adding a
``prediction`` column (a fitted pipeline's ``transform``, or the lookup
predictor below).  The whole what-if grid -- workloads x node counts x
deadlines -- is scored in one distributed pass; the smallest passing node
count is a grouped ``min``, not a driver loop that stops at the first hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .runtime_model import CORES_PER_NODE, MEMORY_PER_NODE_GB, MIN_TIME, what_if_rows

#: Tables of at most so many keys are broadcast; larger ones are joined by a shuffle.
FEW_KEYS = 10_000

Predictor = Callable[[DataFrame], DataFrame]


def lookup_predictor(runs: DataFrame, keys=("algorithm_type", "num_nodes"),
                     floor: float = MIN_TIME) -> Predictor:
    """A deterministic predictor: mean observed runtime per ``keys``; rows
    whose key was never observed predict null."""
    table = written(runs.groupBy(*keys).agg(F.avg("simulated_time").alias("prediction")))
    if table.count() <= FEW_KEYS:
        table = F.broadcast(table)

    def predict(df: DataFrame) -> DataFrame:
        return (df.join(table, list(keys), "left")
                .withColumn("prediction", F.when(F.col("prediction").isNotNull(),
                                                 F.greatest(F.col("prediction"), F.lit(floor)))))
    return predict


def optimise_deadlines(workloads: DataFrame, deadlines: DataFrame, predict: Predictor,
                       max_nodes: int = 8, key=("workload", "algorithm_type")) -> DataFrame:
    """Per workload x deadline the fewest nodes in 1..max_nodes whose
    predicted time is within the deadline, with margin, cost, cores and
    memory; null columns when no node count qualifies.  ``last_prediction`` is
    the time predicted for ``max_nodes``."""
    key = list(key)
    grid = predict(what_if_rows(workloads, max_nodes))
    x = grid.crossJoin(F.broadcast(deadlines.select("deadline")))
    hit = F.col("prediction") <= F.col("deadline")
    best = (x.groupBy(*key, "deadline")
            .agg(F.min_by(F.struct("num_nodes", "prediction"),
                          F.when(hit, F.col("num_nodes"))).alias("b"),
                 F.max_by("prediction", "num_nodes").alias("last_prediction"),
                 F.count_if(hit).alias("_hits")))
    pick = F.col("_hits") > 0
    return best.select(
        *key, "deadline",
        F.when(pick, F.col("b.num_nodes")).alias("num_nodes"),
        F.when(pick, F.col("b.prediction")).alias("predicted_time"),
        F.when(pick, F.col("deadline") - F.col("b.prediction")).alias("deadline_margin"),
        F.when(pick, F.col("b.num_nodes")).alias("cost"),
        F.when(pick, F.col("b.num_nodes") * CORES_PER_NODE).alias("total_cores"),
        F.when(pick, F.col("b.num_nodes") * MEMORY_PER_NODE_GB).alias("total_memory_gb"),
        "last_prediction")


def model_policy(optimised: DataFrame, max_nodes: int = 8) -> DataFrame:
    """The optimiser as a policy row per workload x deadline.  When no
    node count qualifies it falls back to ``max_nodes`` and the row is
    flagged ``fallback`` (its time is the prediction for ``max_nodes``, and it
    never counts as a hit)."""
    fb = F.col("num_nodes").isNull()
    return optimised.select(
        F.col("workload"), F.col("algorithm_type").alias("algorithm"), "deadline",
        F.lit("model").alias("policy"),
        F.coalesce("num_nodes", F.lit(max_nodes)).alias("nodes"),
        F.coalesce("num_nodes", F.lit(max_nodes)).alias("cost"),
        F.coalesce("predicted_time", "last_prediction").alias("est_time"), fb.alias("fallback"))
