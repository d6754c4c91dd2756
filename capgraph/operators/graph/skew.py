"""Joins on vertex keys that stay even where a few vertices have most edges.

Adaptive execution splits a hot join key only where both sides are plain
shuffles; here one side is nearly always an aggregate by the same key, so the
split is made in the plan: rows of hub vertices get a salt from the other end
of the edge, and the few matching rows of the small side are copied once for
each salt.  Results don't depend on the salt.

A hub has more than ``bound`` edge ends, so there are at most
``2 * edges / bound`` of them, ``MOST_HUBS`` at the default bound: a list that
can be broadcast whatever the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

G = "graph_name"

#: A vertex with fewer edge ends than this is never worth a salt.
HUB_ENDS = 100_000
#: The bound grows with the graph so that there are at most so many hubs.
MOST_HUBS = 1000
SALTS = 64


def hub_bound(edges: int) -> int:
    """Edge ends above which a vertex counts as a hub in ``edges`` edges."""
    return max(HUB_ENDS, 2 * edges // MOST_HUBS)


def find_hubs(ends: DataFrame, edges: int) -> DataFrame | None:
    """The hubs ``(graph_name, vertex)`` of ``ends`` (the same columns, one row
    for each edge end), or None; with too few edges for one no job runs."""
    return hubs_of(ends.groupBy(G, "vertex").agg(F.count(F.lit(1)).alias("n")), "n", edges)


def hubs_of(degrees: DataFrame, col: str, edges: int) -> DataFrame | None:
    """``find_hubs`` from vertices' numbers of edge ends, in ``col``."""
    bound = hub_bound(edges)
    if 2 * edges <= bound:
        return None
    found = degrees.where(F.col(col) > bound).select(G, "vertex").limit(MOST_HUBS + 1).collect()
    if not found:
        return None
    return degrees.sparkSession.createDataFrame(found, degrees.select(G, "vertex").schema)


def salted(rows: DataFrame, hubs: DataFrame | None, key: str, spread: list[str]) -> DataFrame:
    """``rows`` with ``_salt``: for hubs in ``key`` a hash of ``spread``."""
    if hubs is None:
        return rows.withColumn("_salt", F.lit(0))
    h = F.broadcast(hubs.select(G, F.col("vertex").alias(key), F.lit(True).alias("_hub")))
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(h, [G, key], "left").withColumn("_salt", salt).drop("_hub")


def copied(rows: DataFrame, hubs: DataFrame | None, key: str) -> DataFrame:
    """``rows`` (one for each key) with ``_salt``: hubs once for each salt."""
    if hubs is None:
        return rows.withColumn("_salt", F.lit(0))
    h = F.broadcast(hubs.select(G, F.col("vertex").alias(key), F.lit(True).alias("_hub")))
    salts = F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(h, [G, key], "left").withColumn("_salt", F.explode(salts)).drop("_hub")


def hub_join(rows: DataFrame, by_key: DataFrame, hubs: DataFrame | None, key: str,
             spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key`` (at most one row for each key)."""
    if hubs is None:
        return rows.join(by_key, [G, key], how)
    return (salted(rows, hubs, key, spread).join(copied(by_key, hubs, key), [G, key, "_salt"], how)
            .drop("_salt"))
