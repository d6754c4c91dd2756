"""Exact order statistics without sending a whole group to one task.

A group can hold a third of all rows, all of them different, so neither a
window by group over rows or values nor Spark's exact ``percentile`` (which
keeps every distinct value of a group in one buffer) is safe at scale.

*Radix selection* (``at_ranks``): a value becomes a 64-bit integer in the same
order.  A pass counts the rows of each group by the next ``DIGIT`` bits (map-side,
so at most 2^16 rows a group and task move), finds the cells that hold the wanted
ranks by running sums over these counts, and goes on with the rows of these
cells only.  A cell whose least and greatest value agree is done, so columns of
few values take one pass and no column takes more than four.

Null groups are groups like any others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from ..session import written

DIGIT = 16
#: Open cells (one or two a group) are broadcast up to this many, else joined.
BROADCAST_CELLS = 100_000


def _ordered_bits(rows: DataFrame) -> DataFrame:
    """``rows`` (key, value double) as (key, bits): integers in the values' order."""
    def run(batches):
        for b in batches:
            bits = (np.asarray(b.column("value"), np.float64) + 0.0).view(np.int64)  # one zero
            bits = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(bits, pa.int64())], ["key", "bits"])

    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("bits", LongType())]))


def _values(rows: DataFrame) -> DataFrame:
    """``rows`` with ``value``, the double that ``bits`` stands for."""
    def run(batches):
        for b in batches:
            bits = np.asarray(b.column("bits"), np.int64)
            bits = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits.view(np.float64), pa.float64())], [*b.schema.names, "value"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("value", DoubleType())]))


def at_ranks(df: DataFrame, keys: list[str], col: str, ranks: Callable[[Column], list[Column]],
             digit: int = DIGIT) -> DataFrame:
    """``(keys..., which, value)``: the values of ``col`` (nulls left out) at the
    1-based places ``ranks(n)`` of each group's ``n`` sorted values; ``which``
    numbers the ranks from 0.  ``digit`` divides 64."""
    # a struct is equal to another with nulls in the same places
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(col).isNotNull()).select(key.alias("key"), F.col(col).alias("value"))
    kind = df.schema[col].dataType
    floating = isinstance(kind, (DoubleType, FloatType))
    rows = written(_ordered_bits(rows.withColumn("value", F.col("value").cast("double"))) if floating
                   else rows.select("key", F.col("value").cast("bigint").alias("bits")))
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("which"), r.cast("bigint").alias("rank")) for i, r in enumerate(ranks(F.col("n")))])
    open_ = written(n.select("key", F.lit(0).cast("bigint").alias("cell"), F.explode(wanted).alias("w"))
                    .select("key", "cell", "w.which", "w.rank"))
    done = None
    for shift in range(64 - digit, -1, -digit):
        own = F.shiftright("bits", shift)
        if shift == 64 - digit:
            inside = rows.select("key", F.lit(0).cast("bigint").alias("cell"), "bits")
        else:
            cells = written(open_.select("key", "cell").distinct())
            cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
            inside = rows.withColumn("cell", F.shiftright("bits", shift + digit)).join(cells, ["key", "cell"])
        counts = inside.groupBy("key", "cell", own.alias("next")).agg(
            F.count(F.lit(1)).alias("c"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        # at most 2^16 rows a cell
        upto = Window.partitionBy("key", "cell").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
        summed = counts.withColumn("end", F.sum("c").over(upto))
        hit = written(open_.join(summed, ["key", "cell"]).where((F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("c")))
                      .select("key", F.col("next").alias("cell"), "which", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), "low", "high"))
        found = hit.where("low = high").select("key", "which", F.col("low").alias("bits"))
        done = found if done is None else done.unionByName(found)
        open_ = hit.where("low <> high").select("key", "cell", "which", "rank")
        if open_.isEmpty():
            break
    out = _values(done) if floating else done.withColumn("value", F.col("bits"))
    return out.select(*[F.col("key")[k].alias(k) for k in keys], "which", F.col("value").cast(kind).alias("value"))


def exact_median(df: DataFrame, keys: list[str], col: str, alias: str = "median", digit: int = DIGIT) -> DataFrame:
    """Exact (interpolated) median of ``col`` per ``keys``, nulls ignored; a
    group without values is absent."""
    x = at_ranks(df, keys, col, lambda n: [F.floor((n + 1) / 2), F.ceil((n + 1) / 2)], digit)
    lo, hi = (F.min(F.when(F.col("which") == i, F.col("value"))) for i in (0, 1))
    return x.groupBy(*keys).agg((lo + F.lit(0.5) * (hi - lo)).alias(alias))


def positions(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """``df`` plus ``_pos``: 1-based rank by ``order_col`` (nulls last) inside
    ``keys``; ties are broken by a hash of the row.

    One range shuffle puts the rows in order (a frequent value is split by the
    hash); a row's place is its number in its partition, plus the rows of the
    partitions before it, minus those of the groups before it."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(order_col).asc_nulls_last(), tie.asc()]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_id"), 33)
    # one row for each partition
    before = (x.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))))
    x = (x.withColumn("_part", part).join(F.broadcast(before.select("_part", "_before")), "_part")
         .withColumn("_at", F.coalesce("_before", F.lit(0)) + F.col("_id").bitwiseAND((1 << 33) - 1)))
    if not keys:
        return x.withColumn("_pos", F.col("_at") + 1).drop("_id", "_part", "_before", "_at")
    start = x.groupBy(*keys).agg(F.min("_at").alias("_start"))
    start = start.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (x.join(start, same).withColumn("_pos", F.col("_at") - F.col("_start") + 1)
            .select(*df.columns, "_pos"))
