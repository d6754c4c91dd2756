"""Runtime model.

Features are prepared by a Spark ML pipeline (``StringIndexer -> Imputer ->
VectorAssembler -> StandardScaler``); the models are the histogram trees of
``trees``, which have the L1 and L2 terms and the least rows of a split that
Spark's own tree learners lack.  Training, scoring and prediction are Spark
jobs, never row at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from . import trees as TT
from .metrics import regression_metrics

# Model inputs, target, split, and the cross-deadline model's settings.
FEATURE_COLUMNS = ("nodes", "edges", "density", "avg_clustering", "num_nodes", "total_cores",
                   "total_memory_gb", "algorithm_type")
TARGET = "simulated_time"
TEST_SHARE_PCT = 25
MIN_TIME = 0.1
CORES_PER_NODE, MEMORY_PER_NODE_GB, MOST_NODES = 4, 8, 8
CROSS_PARAMS = dict(maxIter=100, maxDepth=4, stepSize=0.1)
MOST_DEADLINES = 16
#: Names of settings that callers may change, as Spark's learners have them.
SETTINGS = {"maxIter": "trees", "numTrees": "trees", "maxDepth": "depth", "stepSize": "rate", "seed": "seed"}


def settings(kind: str, **params) -> TT.Settings:
    """The settings of a model kind, some of them changed."""
    if kind not in ("gbt", "rf"):
        raise ValueError(f"unknown model kind {kind!r}")
    return replace(TT.BOOSTED if kind == "gbt" else TT.FOREST, **{SETTINGS.get(k, k): v for k, v in params.items()})


def select_features(df: DataFrame, deadline_col: str = "deadline_constraint") -> list[str]:
    """M1: the model columns present in ``df`` (plus the deadline when there)."""
    cols = [c for c in FEATURE_COLUMNS if c in df.columns]
    if deadline_col in df.columns:
        cols.append(deadline_col)
    return cols


def usable_features(df: DataFrame) -> list[str]:
    """M1 + the reference's mean fill: columns that are entirely null cannot
    be imputed, so they are dropped (one aggregate of non-null counts)."""
    cols = select_features(df)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c] > 0]


def split_train_test(df: DataFrame, key: str = "run_id", test_pct: int = TEST_SHARE_PCT):
    """M5: repeatable split by a hash of the row key: the first four hex
    digits of ``md5(key)`` mod 100 below ``100 - test_pct`` is training.
    Unlike ``randomSplit`` it does not change under repartitioning."""
    b = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 100
    x = df.withColumn("_bucket", b)
    return (x.filter(F.col("_bucket") < 100 - test_pct).drop("_bucket"),
            x.filter(F.col("_bucket") >= 100 - test_pct).drop("_bucket"))


def preparation(features: list[str]) -> Pipeline:
    """M2-M4: encode the algorithm alphabetically (``predict`` maps unseen names
    to index 0), mean-impute numeric columns, assemble, standardise."""
    numeric = [c for c in features if c != "algorithm_type"]
    stages = []
    if "algorithm_type" in features:
        stages.append(StringIndexer(inputCol="algorithm_type", outputCol="algorithm_type_encoded",
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
    imputed = [f"{c}_imp" for c in numeric]
    stages.append(Imputer(strategy="mean", inputCols=numeric, outputCols=imputed))
    assembled = imputed + (["algorithm_type_encoded"] if "algorithm_type" in features else [])
    stages.append(VectorAssembler(inputCols=assembled, outputCol="raw_features",
                                  handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features",
                                 withMean=True, withStd=True))
    return Pipeline(stages=stages)


@dataclass
class RuntimeModel:
    """A fitted preparation and its trees; ``lane`` says which trees, where
    several models were fitted together."""

    prepared: PipelineModel
    trees: TT.Model
    lane: int = 0

    def encoded(self, df: DataFrame) -> DataFrame:
        """``df`` with the array column x.  Algorithms unseen in training get
        encoded as 0, as the reference does."""
        first = self.prepared.stages[0]
        if hasattr(first, "labels") and "algorithm_type" in df.columns:
            # The fitted label list is the handful of algorithm names seen in
            # training; an unseen name takes index 0 (the first label).
            labels = list(first.labels)
            df = df.withColumn("algorithm_type", F.when(F.col("algorithm_type").isin(labels), F.col("algorithm_type"))
                               .otherwise(F.lit(labels[0])))
        return self.prepared.transform(df).select(*df.columns, vector_to_array("features").alias("x"))

    def transform(self, df: DataFrame) -> DataFrame:
        return TT.predict(self.encoded(df), self.trees, F.col("x"), lane=self.lane).drop("x")


class Learner:
    """M6/M7 behind M2-M4: ``fit`` gives a ``RuntimeModel``."""

    def __init__(self, features: list[str], kind: str = "gbt", **params):
        self.features, self.settings = features, settings(kind, **params)

    def fit(self, df: DataFrame, key: str = "run_id") -> RuntimeModel:
        prepared = preparation(self.features).fit(df)
        return RuntimeModel(prepared, TT.fit(written(training_rows(prepared, df, key)), len(self.features), self.settings))


def training_rows(prepared: PipelineModel, df: DataFrame, key: str, lane: int = 0) -> DataFrame:
    """key, lane, y, x of the rows that have a target."""
    own = F.col(key).cast("bigint") if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key)
    return (prepared.transform(df.where(F.col(TARGET).isNotNull()))
            .select(own.alias("key"), F.lit(lane).alias("lane"), F.col(TARGET).cast("double").alias("y"),
                    vector_to_array("features").alias("x")))


def build_pipeline(features: list[str], kind: str = "gbt", **params) -> Learner:
    """The learner of a model kind (``settings``)."""
    return Learner(features, kind, **params)


def _cast_numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features if c != "algorithm_type"})


@dataclass
class TrainedModel:
    kind: str
    model: RuntimeModel
    features: list[str]
    metrics: DataFrame  # (split, rmse, mae, r2, rows)


def train(df: DataFrame, kind: str = "gbt", key: str = "run_id", **params) -> TrainedModel:
    """M6/M7 + M8: fit on the training split, score both splits."""
    feats = usable_features(df)
    # read by every fitted stage and both scorings
    data = written(_cast_numeric(df, feats))
    tr, te = split_train_test(data, key)
    model = build_pipeline(feats, kind, **params).fit(tr, key)
    tr, te = (x.select(*feats, TARGET) for x in (tr, te))  # what scoring needs
    m = regression_metrics(predict(model, tr), TARGET, "prediction").withColumn("split", F.lit("train"))
    m2 = regression_metrics(predict(model, te), TARGET, "prediction").withColumn("split", F.lit("test"))
    return TrainedModel(kind, model, feats, m.unionByName(m2))


def select_best(models: list[TrainedModel]) -> TrainedModel:
    """M9: the model with the best test R^2 (one scalar per model).  The models'
    metrics are written, so that both splits are scored once."""
    def r2(t):
        t.metrics = written(t.metrics)
        return t.metrics.filter(F.col("split") == "test").first()["r2"] or float("-inf")
    return max(models, key=r2)


def predict(model: RuntimeModel, df: DataFrame, floor: float = MIN_TIME) -> DataFrame:
    """Batch prediction with a floor of 0.1 s."""
    out = model.transform(df)
    return out.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(floor)))


def feature_importance(tm: TrainedModel) -> DataFrame:
    """Importances of the fitted trees by feature name, descending."""
    numeric = [c for c in tm.features if c != "algorithm_type"]
    names = numeric + (["algorithm_type_encoded"] if "algorithm_type" in tm.features else [])
    imp = tm.model.trees.importance(tm.model.lane).tolist()
    spark = tm.metrics.sparkSession
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return (spark.createDataFrame(rows, "feature string, importance double")
            .orderBy(F.col("importance").desc(), "feature"))


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of about ``TT.CHUNK`` of the ``rows`` that are predicted for it: the few
    bytes of their workloads would come merged into a few tasks."""
    return df.repartition(max(1, -(-rows // TT.CHUNK)))


def what_if_rows(workloads: DataFrame, max_nodes: int = MOST_NODES) -> DataFrame:
    """Configurations to score: every workload x 1..max_nodes nodes, with
    totals derived from nodes (4 cores, 8 GB each)."""
    return (workloads.withColumn("num_nodes", F.explode(F.sequence(F.lit(1), F.lit(max_nodes))))
            .withColumns({"total_cores": F.col("num_nodes") * CORES_PER_NODE,
                          "total_memory_gb": F.col("num_nodes") * MEMORY_PER_NODE_GB}))


def save_model(model: RuntimeModel, path: str) -> None:
    """Persist the preparation, the node table and what goes with it."""
    spark = _session()
    model.prepared.write().overwrite().save(f"{path}/prepared")
    model.trees.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = {"boosted": model.trees.boosted, "features": model.trees.features, "lane": model.lane,
             "base": {str(k): v for k, v in model.trees.base.items()}}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_model(path: str) -> RuntimeModel:
    spark = _session()
    about = json.loads(spark.read.schema("about string").json(f"{path}/about").first().about)
    nodes = spark.read.parquet(f"{path}/nodes")
    trees = TT.Model.of_nodes(nodes, about["boosted"], about["features"], {int(k): v for k, v in about["base"].items()})
    return RuntimeModel(PipelineModel.load(f"{path}/prepared"), trees, about["lane"])


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def derived_deadline(df: DataFrame, deadlines, key: str = "run_id", name: str = "deadline_constraint") -> DataFrame:
    """A deadline for each row, by a hash of its key: for runs tables that
    don't say which deadline a run had."""
    b = F.conv(F.substring(F.md5(F.col(key).cast("string")), 5, 4), 16, 10).cast("int") % len(deadlines)
    return df.withColumn(name, F.element_at(F.array(*[F.lit(float(d)) for d in deadlines]), b + 1))


def cross_deadline(df: DataFrame, deadline_col: str = "deadline_constraint", kind: str = "gbt",
                   key: str = "run_id", **params) -> DataFrame:
    """Train on the rows of one deadline, test on another, for every
    ordered pair of at most ``MOST_DEADLINES`` deadlines.  The models grow side
    by side, in the same jobs.  ``(train_deadline, test_deadline,
    train_samples, test_samples, rmse, mae, r2)``."""
    params = {**(CROSS_PARAMS if kind == "gbt" else {}), **params}
    counts = df.groupBy(deadline_col).count().orderBy(deadline_col).limit(MOST_DEADLINES + 1).collect()
    if len(counts) > MOST_DEADLINES:
        raise ValueError(f"more than {MOST_DEADLINES} deadlines")
    feats = usable_features(df)
    data = written(_cast_numeric(df, feats))
    prepared, rows = [], None
    for lane, (a, _) in enumerate(counts):
        own = data.filter(F.col(deadline_col).eqNullSafe(F.lit(a)))
        prepared.append(preparation(feats).fit(own))
        part = training_rows(prepared[-1], own, key, lane)
        rows = part if rows is None else rows.unionByName(part)
    trees = TT.fit(written(rows), len(feats), settings(kind, **params))
    out = None
    for lane, (a, n) in enumerate(counts):
        # one scoring pass for all other deadlines
        scored = predict(RuntimeModel(prepared[lane], trees, lane), data.select(*dict.fromkeys([*feats, TARGET, deadline_col])).filter(F.col(deadline_col) != a))
        m = regression_metrics(scored, TARGET, "prediction", [deadline_col]).select(
            F.lit(a).alias("train_deadline"), F.col(deadline_col).alias("test_deadline"),
            F.lit(n).alias("train_samples"), F.col("rows").alias("test_samples"), "rmse", "mae", "r2")
        out = m if out is None else out.unionByName(m)
    return out


def generalisation_summary(pairs: DataFrame) -> DataFrame:
    """M15 summary: mean and sample std of R^2 and MAE over the pairs, best
    and worst pair."""
    return pairs.agg(
        F.avg("r2").alias("mean_r2"), F.stddev_samp("r2").alias("std_r2"),
        F.avg("mae").alias("mean_mae"), F.stddev_samp("mae").alias("std_mae"),
        F.max_by(F.struct("train_deadline", "test_deadline"), "r2").alias("best_pair"),
        F.min_by(F.struct("train_deadline", "test_deadline"), "r2").alias("worst_pair"))
