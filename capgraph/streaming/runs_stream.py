"""Incremental run analytics with Structured Streaming.

New run records (the ``events`` parquet layout) arriving in a folder update
the deadline hit rates (A6) and runtime-category counts (A9) as they land;
the operators are the batch ones, applied to a streaming frame.  The deadline
table is a few fixed rows joined stream-to-static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources import tables as T

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def run_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming runs from parquet files matching ``pattern`` in ``folder``."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return T.runs_from_events(r.parquet(folder))


def live_hit_rates(runs: DataFrame, deadlines: DataFrame) -> DataFrame:
    """A6 over a stream: hits and runs per deadline x algorithm (complete mode)."""
    return R.deadline_hit_rates(runs, deadlines, by_algorithm=True)


def live_categories(runs: DataFrame) -> DataFrame:
    """A2/A9 over a stream: runs per runtime category."""
    return (R.with_runtime_category(runs).groupBy("algorithm_type", "execution_category")
            .agg(F.count(F.lit(1)).alias("runs")))


def start(df: DataFrame, name: str, checkpoint: str, mode: str = "complete",
          trigger_once: bool = True):
    """Start ``df`` into an in-memory table ``name``; the checkpoint folder
    keeps the state and source offsets so a restarted query resumes."""
    w = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", checkpoint))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
