"""Graph profiles, dataset ranking, feature rows and algorithm dispatch
(G7, G8, G19, G20, G21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.categories import (DENSITY_LIMITS, SIZE_LIMITS, canonical_name, density_category,
                                     size_category)
from ...session import written
from .components import component_summary, connected_components
from .edges import G, canonical_edges, graph_counts
from .pagerank import pagerank_converged, pagerank_fixed
from .prepared import Graph, graph
from .triangles import sampled_average_clustering, triangle_count, triangle_estimate

# Per-algorithm dataset picks -- (algorithm, how many).
RANKING_RULES = (("PageRank", 8), ("ConnectedComponents", 7), ("TriangleCounting", 6))
DEFAULT_PICK = 6
TRIANGLE_ELIGIBLE = {"max_nodes": 20000, "min_density": 0.001, "max_density": 0.05}


def graph_profile(edges: DataFrame, size_limits=SIZE_LIMITS,
                  density_limits=DENSITY_LIMITS) -> DataFrame:
    """G7 (+G4, G5): nodes, edges, density, avg_degree and the two categories."""
    canon = canonical_edges(edges)
    return graph_counts(canon).withColumns({
        "size_category": size_category(F.col("nodes"), size_limits),
        "density_category": density_category(F.col("density"), density_limits),
    })


def dataset_profile(edges: DataFrame, max_to_analyze: int = 15) -> DataFrame:
    """Profile of the first ``max_to_analyze`` graphs by name (a few
    names by that parameter, so they are broadcast)."""
    edges = written(edges)
    first = edges.select(G).distinct().orderBy(G).limit(max_to_analyze)
    return graph_profile(edges.join(F.broadcast(first), G, "left_semi"))


def rank_datasets(profiles: DataFrame, algorithms=None, rules=RANKING_RULES,
                  default_k: int = DEFAULT_PICK, eligible=TRIANGLE_ELIGIBLE) -> DataFrame:
    """Graphs picked per algorithm, ``(algorithm, rank, graph_name, score)``.

    PageRank by ``nodes * avg_degree`` (top 8), components by ``nodes`` (top 7),
    triangles among ``nodes < 20000`` and ``.001 < density < .05`` by
    ``density * nodes`` (top 6); any other algorithm takes the first 6 by name.
    Each pick is a distributed top-k (``orderBy().limit(k)``: per-partition
    top-k, then a merge of those), so no task sees all graphs of a rule.
    """
    rule_k = dict(rules)
    profiles = written(profiles)
    out = None
    for algo in list(algorithms or rule_k):
        k = rule_k.get(algo, default_k)
        p = profiles
        if algo == "PageRank":
            score = F.col("nodes") * F.col("avg_degree")
        elif algo == "ConnectedComponents":
            score = F.col("nodes").cast("double")
        elif algo == "TriangleCounting":
            score = F.col("density") * F.col("nodes")
            p = p.filter((F.col("nodes") < eligible["max_nodes"])
                         & (F.col("density") > eligible["min_density"])
                         & (F.col("density") < eligible["max_density"]))
        else:
            score = F.lit(None).cast("double")
        top = (p.select(G, score.alias("score"))
               .orderBy(F.col("score").desc_nulls_last(), F.col(G)).limit(k))
        # the window below runs over the k picked rows only
        w = Window.orderBy(F.col("score").desc_nulls_last(), F.col(G))
        top = top.select(F.lit(algo).alias("algorithm"), F.row_number().over(w).alias("rank"),
                         G, "score")
        out = top if out is None else out.unionByName(top)
    return out


def graph_features(edges: DataFrame | Graph, clustering_threshold: int | None = None,
                   clustering_sample: int = 5000) -> DataFrame:
    """One feature row per graph -- nodes, edges, density, is_connected,
    num_components, avg_clustering, sampled.  Clustering is exact unless a
    threshold is given (see ``sampled_average_clustering``)."""
    g = graph(edges)  # written once for all three
    counts = graph_counts(g.canon, g.vertices).select(G, "nodes", "edges", "density")
    comps = component_summary(connected_components(g))
    clus = sampled_average_clustering(g, clustering_threshold, clustering_sample)
    return (counts.join(comps, G, "left").join(clus, G, "left")
            .select(G, "nodes", "edges", "density", "is_connected", "num_components",
                    "avg_clustering", "sampled"))


ALGORITHMS = {"pagerank": "PageRank", "connectedcomponents": "ConnectedComponents",
              "trianglecounting": "TriangleCounting"}


def run_algorithm(edges: DataFrame | Graph, name: str, **params) -> tuple[DataFrame, DataFrame]:
    """Run an algorithm by (case/spelling-insensitive) name.

    Returns ``(result, summary)``; ``summary`` has one row per graph with
    ``algorithm, nodes, edges, result_count`` -- vertex rows for PageRank,
    components for connected components, triangles for triangle counting.
    Unknown names raise ``ValueError``.
    """
    key = canonical_name(name)
    if key not in ALGORITHMS:
        raise ValueError(f"unknown algorithm: {name!r}")
    algo = ALGORITHMS[key]
    g = graph(edges)
    counts = graph_counts(g.canon, g.vertices).select(G, "nodes", "edges")
    if algo == "PageRank":
        if params.pop("converged", False):
            result = pagerank_converged(g, **params)
        else:
            result = pagerank_fixed(g.canon, g.vertices, **params)
        rc = result.groupBy(G).agg(F.count(F.lit(1)).alias("result_count"))
    elif algo == "ConnectedComponents":
        result = connected_components(g, **params)
        rc = component_summary(result).select(G, F.col("num_components").alias("result_count"))
    else:
        if params:
            result = triangle_estimate(g, **params)
        else:
            result = triangle_count(g)
        rc = result.select(G, F.col("triangles").alias("result_count"))
    summary = (counts.join(rc, G, "left")
               .select(G, F.lit(algo).alias("algorithm"), "nodes", "edges",
                       F.coalesce("result_count", F.lit(0)).cast("bigint").alias("result_count")))
    return result, summary
