"""Places of rows in an order, however large one group of them is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Runs of a group in a range partition are broadcast up to this many, else joined.
BROADCAST_RUNS = 100_000


def ranked(rows: DataFrame, group: str, order: list[str], carry: list[str] | None = None) -> DataFrame:
    """``rows`` (a written frame, as it is sampled and then read) with ``rank``,
    the place from 0 of a row among its group's by ``order``, and ``in_group``, the
    group's number of rows.  ``group`` is not null; ``order`` should end with a
    column that tells equal rows apart, so that many of them need not share a
    task.

    One range shuffle by (group, order); a row's rank is its place in its
    partition plus what the partitions before it hold of the group, so no
    group has to fit in one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [group, *order, *[c for c in carry or rows.columns if c not in (group, *order)]]
    placed = written(rows.select(*keep).repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
                     .withColumn("_id", F.monotonically_increasing_id()))
    at = placed.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    runs = at.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # one row for each partition that a group reaches into
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.select("_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                               F.sum("_n").over(whole).alias("in_group")))
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    return at.join(runs, ["_part", group]).select(*keep, (F.col("_at") + F.col("_shift")).alias("rank"), "in_group")
