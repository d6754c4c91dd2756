"""Basic graph operators over edge DataFrames.

Conventions: an edge DataFrame has ``(graph_name, src, dst)``; a vertex
DataFrame has ``(graph_name, vertex)``.  ``graph_name`` is a key in every
operator, so one job serves many graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

G = "graph_name"


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple graph -- (low, high) ends, parallel and reversed
    edges merged, self-loops kept."""
    return (edges.select(G, F.least("src", "dst").alias("src"),
                         F.greatest("src", "dst").alias("dst"))
            .distinct())


def vertices(edges: DataFrame) -> DataFrame:
    """G1: every endpoint once per graph (one shuffle, partial distinct)."""
    return (edges.select(G, F.explode(F.array("src", "dst")).alias("vertex"))
            .distinct())


def out_degree(edges: DataFrame) -> DataFrame:
    """G3 (directed): ``(graph_name, vertex, out_degree)`` for vertices with
    at least one out-edge."""
    return (edges.groupBy(G, F.col("src").alias("vertex"))
            .agg(F.count(F.lit(1)).alias("out_degree")))


def degree(canon: DataFrame, loops: bool = True) -> DataFrame:
    """G3 (undirected) over canonical edges: a self-loop adds 2, unless
    ``loops=False`` where self-loops are dropped first."""
    e = canon if loops else canon.filter(F.col("src") != F.col("dst"))
    return (e.select(G, F.explode(F.array("src", "dst")).alias("vertex"))
            .groupBy(G, "vertex").agg(F.count(F.lit(1)).alias("degree")))


def graph_counts(canon: DataFrame, verts: DataFrame | None = None) -> DataFrame:
    """G4 + G5: nodes, edges, average degree ``2m/n``, density ``2m/(n(n-1))``.

    Both counts are per-graph aggregates (partial aggregation, one row per
    graph) joined on ``graph_name``.
    """
    verts = vertices(canon) if verts is None else verts
    n = verts.groupBy(G).agg(F.count(F.lit(1)).alias("nodes"))
    m = canon.groupBy(G).agg(F.count(F.lit(1)).alias("edges"))
    out = n.join(m, G, "left").fillna(0, subset=["edges"])
    return out.withColumns({
        "avg_degree": F.when(F.col("nodes") > 0,
                             2.0 * F.col("edges") / F.col("nodes")).otherwise(F.lit(0.0)),
        "density": density_expr(F.col("nodes"), F.col("edges")),
    })


def density_expr(nodes, edges):
    """``2m / (n (n-1))``, 0 when n <= 1."""
    return F.when(nodes > 1, 2.0 * edges / (nodes.cast("double") * (nodes - 1))).otherwise(F.lit(0.0))


def induced_subgraph(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """Edges whose both ends are in ``verts`` (two left-semi joins)."""
    v_src = verts.select(G, F.col("vertex").alias("src"))
    v_dst = verts.select(G, F.col("vertex").alias("dst"))
    return edges.join(v_src, [G, "src"], "left_semi").join(v_dst, [G, "dst"], "left_semi")


def first_k_vertices(verts: DataFrame, k: int, shards: int = 64) -> DataFrame:
    """The ``k`` lowest vertex ids per graph -- the deterministic stand-in
    for "first k nodes in file order".

    Two levels, for any ``k``: each graph is cut into ``shards`` by a hash of
    the vertex and every shard keeps its own ``k`` lowest, so no task sorts a
    whole graph; the second level sees at most ``shards * k`` rows a graph."""
    def lowest(frame, *keys):
        w = Window.partitionBy(G, *keys).orderBy("vertex")
        return frame.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")

    cut = verts.withColumn("_shard", F.pmod(F.xxhash64("vertex"), F.lit(shards)))
    return lowest(lowest(cut, "_shard").drop("_shard"))


def hash_sample_vertices(verts: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """G18 (hash variant): keep a vertex when the first 15 hex digits of the
    md5 of ``graph|vertex|seed`` fall under ``fraction`` in millionths;
    repeatable under any partitioning and in other engines, no shuffle."""
    key = F.concat_ws("|", F.col(G), F.col("vertex").cast("string"), F.lit(str(seed)))
    bucket = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint") % 1_000_000
    return verts.filter(bucket < F.lit(int(fraction * 1_000_000)))
