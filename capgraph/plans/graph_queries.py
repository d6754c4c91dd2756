"""Registered graph queries (S4, G1-G21) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import components as CC
from ..operators.graph import edges as E
from ..operators.graph import features as FT
from ..operators.graph import pagerank as PR
from ..operators.graph import triangles as TR
from ..operators.graph.prepared import graph
from ..sources import tables as T
from .registry import query, rounded
from .sql_views import (CANON, EDGES, EDGES_BIPARTITE, EDGES_CUSTOMER, EDGES_MULTI, TRIANGLES,
                        components_sql, pagerank_converged_sql, pagerank_sql)

G = E.G


def _edges(spark, sf):
    return T.copurchase_edges(spark, sf)


def _multi(spark, sf):
    return T.copurchase_edges_multi(spark, sf)


# ---------------------------------------------------------------- S4, G1-G6

@query("copurchase_edges", f"WITH {EDGES} SELECT graph_name, src, dst FROM e")
def q_copurchase_edges(spark, sf):
    return _edges(spark, sf)


@query("graph_vertices", f"WITH {EDGES_MULTI}, {CANON} SELECT graph_name, vertex FROM v")
def q_graph_vertices(spark, sf):
    return E.vertices(_multi(spark, sf))


@query("canonical_edges", f"WITH {EDGES_BIPARTITE}, {CANON} SELECT graph_name, src, dst FROM c")
def q_canonical_edges(spark, sf):
    return E.canonical_edges(T.bipartite_edges(spark, sf))


@query("out_degree", f"""WITH {EDGES_MULTI}
SELECT graph_name, src AS vertex, count(*) AS out_degree FROM e GROUP BY graph_name, src""")
def q_out_degree(spark, sf):
    return E.out_degree(_multi(spark, sf))


@query("degree", f"""WITH {EDGES_MULTI}, {CANON},
d0 AS (SELECT graph_name, src AS vertex FROM c UNION ALL SELECT graph_name, dst FROM c)
SELECT graph_name, vertex, count(*) AS degree FROM d0 GROUP BY graph_name, vertex""")
def q_degree(spark, sf):
    return E.degree(E.canonical_edges(_multi(spark, sf)))


@query("graph_counts", f"""WITH {EDGES_MULTI}, {CANON}
SELECT graph_name, nodes, edges, round(avg_degree, 6) AS avg_degree, round(density, 6) AS density
FROM cnt""")
def q_graph_counts(spark, sf):
    return rounded(E.graph_counts(E.canonical_edges(_multi(spark, sf))))


@query("first_k_vertices", f"""WITH {EDGES_MULTI}, {CANON}
SELECT graph_name, vertex FROM v
QUALIFY row_number() OVER (PARTITION BY graph_name ORDER BY vertex) <= 200""")
def q_first_k_vertices(spark, sf):
    return E.first_k_vertices(E.vertices(_multi(spark, sf)), 200)


@query("induced_subgraph", f"""WITH {EDGES_MULTI}, {CANON},
sv AS (SELECT graph_name, vertex FROM v
       QUALIFY row_number() OVER (PARTITION BY graph_name ORDER BY vertex) <= 200)
SELECT graph_name, src, dst FROM c
WHERE (graph_name, src) IN (SELECT (graph_name, vertex) FROM sv)
  AND (graph_name, dst) IN (SELECT (graph_name, vertex) FROM sv)""")
def q_induced_subgraph(spark, sf):
    canon = E.canonical_edges(_multi(spark, sf))
    return E.induced_subgraph(canon, E.first_k_vertices(E.vertices(canon), 200))


# ---------------------------------------------------------------- G7, G8, G21

_PROFILE_SQL = """SELECT graph_name, nodes, edges, round(avg_degree, 6) AS avg_degree,
       round(density, 6) AS density,
       CASE WHEN nodes < 5000 THEN 'small' WHEN nodes < 20000 THEN 'medium' ELSE 'large' END AS size_category,
       CASE WHEN density < 0.001 THEN 'sparse' WHEN density < 0.01 THEN 'medium' ELSE 'dense' END AS density_category
FROM cnt"""


@query("graph_profile", f"WITH {EDGES_MULTI}, {CANON} {_PROFILE_SQL}")
def q_graph_profile(spark, sf):
    return rounded(FT.graph_profile(_multi(spark, sf)))


@query("dataset_profile", f"""WITH {EDGES_CUSTOMER},
first AS (SELECT DISTINCT graph_name FROM e ORDER BY graph_name LIMIT 15),
e2 AS (SELECT * FROM e WHERE graph_name IN (SELECT graph_name FROM first)),
{CANON.replace('FROM e)', 'FROM e2)')} {_PROFILE_SQL}""")
def q_dataset_profile(spark, sf):
    return rounded(FT.dataset_profile(T.customer_graph_edges(spark, sf)))


@query("dataset_ranking", f"""WITH {EDGES_CUSTOMER}, {CANON},
algos(algorithm, k) AS (VALUES ('PageRank', 8), ('ConnectedComponents', 7), ('TriangleCounting', 6)),
x AS (SELECT a.algorithm, a.k, p.graph_name,
             CASE a.algorithm WHEN 'PageRank' THEN p.nodes * p.avg_degree
                              WHEN 'ConnectedComponents' THEN CAST(p.nodes AS DOUBLE)
                              WHEN 'TriangleCounting' THEN p.density * p.nodes END AS score
      FROM cnt p CROSS JOIN algos a
      WHERE a.algorithm <> 'TriangleCounting'
         OR (p.nodes < 20000 AND p.density > 0.001 AND p.density < 0.05)),
r AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score DESC NULLS LAST, graph_name) AS rank
      FROM x)
SELECT algorithm, CAST(rank AS INTEGER) AS rank, graph_name, round(score, 6) AS score FROM r WHERE rank <= k""")
def q_dataset_ranking(spark, sf):
    prof = FT.graph_profile(T.customer_graph_edges(spark, sf))
    out = FT.rank_datasets(prof)
    return rounded(out.withColumn("rank", F.col("rank").cast("int")))


# ---------------------------------------------------------------- G9, G10

@query("pagerank_fixed", pagerank_sql(EDGES) +
       "\nSELECT graph_name, vertex, round(pr, 6) AS pagerank FROM r10")
def q_pagerank_fixed(spark, sf):
    return rounded(PR.pagerank_fixed(_edges(spark, sf), max_iterations=10))


@query("pagerank_converged", pagerank_converged_sql(EDGES_MULTI) +
       "\nSELECT graph_name, vertex, round(pr, 9) AS pagerank, iterations, done AS converged,"
       " round(error, 9) AS error FROM s40")
def q_pagerank_converged(spark, sf):
    return rounded(PR.pagerank_converged(_multi(spark, sf), max_iter=40), 9)


# ---------------------------------------------------------------- G11, G12

@query("connected_components", components_sql(EDGES_MULTI) +
       "\nSELECT graph_name, vertex, component FROM comp")
def q_connected_components(spark, sf):
    return CC.connected_components(_multi(spark, sf))


@query("component_summary", components_sql(EDGES_MULTI) +
       "\nSELECT graph_name, num_components, is_connected, largest_component FROM csum")
def q_component_summary(spark, sf):
    comps = CC.connected_components(_multi(spark, sf))
    largest = CC.component_sizes(comps).groupBy(G).agg(F.max("size").alias("largest_component"))
    return CC.component_summary(comps).join(largest, G)


@query("connected_components_customers", components_sql(EDGES_CUSTOMER) +
       "\nSELECT graph_name, vertex, component FROM comp")
def q_connected_components_customers(spark, sf):
    """G11 over many graphs, most of which fall into several components."""
    return CC.connected_components(T.customer_graph_edges(spark, sf))


@query("component_summary_customers", components_sql(EDGES_CUSTOMER) +
       "\nSELECT graph_name, num_components, is_connected, largest_component FROM csum")
def q_component_summary_customers(spark, sf):
    comps = CC.connected_components(T.customer_graph_edges(spark, sf))
    largest = CC.component_sizes(comps).groupBy(G).agg(F.max("size").alias("largest_component"))
    return CC.component_summary(comps).join(largest, G)


# ---------------------------------------------------------------- G13-G17

@query("triangle_count", f"""WITH {EDGES_MULTI}, {CANON}, {TRIANGLES}
SELECT g.graph_name, CAST(count(t.a) AS BIGINT) AS triangles
FROM (SELECT DISTINCT graph_name FROM c) g LEFT JOIN t USING (graph_name) GROUP BY g.graph_name""")
def q_triangle_count(spark, sf):
    return TR.triangle_count(_multi(spark, sf))


@query("triangles_per_vertex", f"""WITH {EDGES}, {CANON}, {TRIANGLES}
SELECT graph_name, vertex, triangles FROM tv""")
def q_triangles_per_vertex(spark, sf):
    return TR.triangles_per_vertex(_edges(spark, sf))


def _estimate_sql(threshold: int, k: int) -> str:
    return f"""WITH {EDGES_CUSTOMER}, {CANON}, {TRIANGLES},
sv AS (SELECT graph_name, vertex FROM v
       QUALIFY row_number() OVER (PARTITION BY graph_name ORDER BY vertex) <= {k}),
k AS (SELECT graph_name, count(*) AS k FROM sv GROUP BY graph_name),
tall AS (SELECT graph_name, count(*) AS n FROM t GROUP BY graph_name),
tsub AS (SELECT graph_name, count(*) AS n FROM t
         WHERE (graph_name, a) IN (SELECT (graph_name, vertex) FROM sv)
           AND (graph_name, b) IN (SELECT (graph_name, vertex) FROM sv)
           AND (graph_name, cc) IN (SELECT (graph_name, vertex) FROM sv)
         GROUP BY graph_name)
SELECT nv.graph_name, nv.nodes, nv.nodes > {threshold} AS sampled,
       CASE WHEN nv.nodes > {threshold}
            THEN CAST(floor(coalesce(tsub.n, 0) * pow(nv.nodes / k.k, 1.4)) AS BIGINT)
            ELSE CAST(coalesce(tall.n, 0) AS BIGINT) END AS triangles
FROM nv JOIN k USING (graph_name) LEFT JOIN tall USING (graph_name) LEFT JOIN tsub USING (graph_name)"""


@query("triangle_estimate", f"""WITH {EDGES_CUSTOMER}, {CANON}, {TRIANGLES}
SELECT nv.graph_name, nv.nodes, false AS sampled, CAST(coalesce(x.n, 0) AS BIGINT) AS triangles
FROM nv LEFT JOIN (SELECT graph_name, count(*) AS n FROM t GROUP BY graph_name) x USING (graph_name)""")
def q_triangle_estimate(spark, sf):
    return TR.triangle_estimate(T.customer_graph_edges(spark, sf))


@query("triangle_estimate_sampled", _estimate_sql(100, 50))
def q_triangle_estimate_sampled(spark, sf):
    """G15's sampled branch, asked for with a small threshold."""
    return TR.triangle_estimate(T.customer_graph_edges(spark, sf), threshold=100, sample_size=50)


@query("clustering", f"""WITH {EDGES_MULTI}, {CANON}, {TRIANGLES}
SELECT graph_name, round(avg(clustering), 6) AS avg_clustering FROM lc GROUP BY graph_name""")
def q_clustering(spark, sf):
    return rounded(TR.average_clustering(_multi(spark, sf)))


@query("local_clustering", f"""WITH {EDGES}, {CANON}, {TRIANGLES}
SELECT graph_name, vertex, degree, triangles, round(clustering, 6) AS clustering FROM lc""")
def q_local_clustering(spark, sf):
    return rounded(TR.local_clustering(_edges(spark, sf)))


@query("clustering_sampled", f"""WITH {EDGES_CUSTOMER}, {CANON}, {TRIANGLES}
SELECT graph_name, round(avg(clustering), 6) AS avg_clustering, false AS sampled FROM lc GROUP BY graph_name""")
def q_clustering_sampled(spark, sf):
    """G17 without a threshold: exact."""
    return rounded(TR.sampled_average_clustering(T.customer_graph_edges(spark, sf)))


@query("clustering_sampled_small", f"""WITH {EDGES_CUSTOMER},
c0 AS (SELECT DISTINCT graph_name, least(src, dst) AS src, greatest(src, dst) AS dst FROM e),
v0 AS (SELECT graph_name, src AS vertex FROM c0 UNION SELECT graph_name, dst FROM c0),
n0 AS (SELECT graph_name, count(*) AS n FROM v0 GROUP BY graph_name),
sv AS (SELECT graph_name, vertex, n FROM v0 JOIN n0 USING (graph_name)
       QUALIFY n < 100 OR row_number() OVER (PARTITION BY graph_name ORDER BY vertex) <= 50),
e2 AS (SELECT * FROM c0 WHERE (graph_name, src) IN (SELECT (graph_name, vertex) FROM sv)
                          AND (graph_name, dst) IN (SELECT (graph_name, vertex) FROM sv)),
{CANON.replace("FROM e)", "FROM e2)").replace("v AS (SELECT graph_name, src AS vertex FROM c UNION SELECT graph_name, dst FROM c)",
                                               "v AS (SELECT graph_name, vertex FROM sv)")}, {TRIANGLES}
SELECT lc.graph_name, round(avg(clustering), 6) AS avg_clustering, max(n0.n) >= 100 AS sampled
FROM lc JOIN n0 USING (graph_name) GROUP BY lc.graph_name""")
def q_clustering_sampled_small(spark, sf):
    """G17's sampled branch, asked for with a small threshold."""
    return rounded(TR.sampled_average_clustering(T.customer_graph_edges(spark, sf), threshold=100,
                                                 sample_size=50))


# ---------------------------------------------------------------- G19, G20

@query("graph_features", components_sql(EDGES_MULTI) + f""", {TRIANGLES}
SELECT cnt.graph_name, cnt.nodes, cnt.edges, round(cnt.density, 6) AS density,
       csum.is_connected, csum.num_components, round(a.avg_clustering, 6) AS avg_clustering, false AS sampled
FROM cnt JOIN csum USING (graph_name)
JOIN (SELECT graph_name, avg(clustering) AS avg_clustering FROM lc GROUP BY graph_name) a USING (graph_name)""")
def q_graph_features(spark, sf):
    return rounded(FT.graph_features(_multi(spark, sf)))


@query("algorithm_dispatch", components_sql(EDGES_MULTI) + f""", {TRIANGLES},
tc AS (SELECT g.graph_name, count(t.a) AS n FROM (SELECT DISTINCT graph_name FROM c) g
       LEFT JOIN t USING (graph_name) GROUP BY g.graph_name)
SELECT graph_name, 'PageRank' AS algorithm, nodes, edges, nodes AS result_count FROM cnt
UNION ALL
SELECT graph_name, 'ConnectedComponents', nodes, edges, num_components FROM cnt JOIN csum USING (graph_name)
UNION ALL
SELECT graph_name, 'TriangleCounting', nodes, edges, CAST(n AS BIGINT) FROM cnt JOIN tc USING (graph_name)""")
def q_algorithm_dispatch(spark, sf):
    g = graph(_multi(spark, sf))
    out = None
    for name in ("pagerank", "connected_components", "TriangleCounting"):
        _, summary = FT.run_algorithm(g, name)
        out = summary if out is None else out.unionByName(summary)
    return out


# ---------------------------------------------------------------- S1-S3, S6

@query("edge_list_roundtrip", f"""WITH {EDGES_MULTI}
SELECT graph_name, src, dst, 0::BIGINT AS rejected_lines FROM e""")
def q_edge_list_roundtrip(spark, sf):
    """Write the co-purchase graphs as edge-list text (one folder per graph)
    under the checkpoint folder and scan them back with reject counting."""
    from ..session import shared_path
    from ..sources import files as S
    path = shared_path(spark, "edgelists")
    S.write_edge_list(_multi(spark, sf), path)
    edges, rejects = S.read_edge_lists(spark, path)
    rc = S.reject_counts(rejects)
    return (edges.join(rc, "graph_name", "left")
            .select("graph_name", "src", "dst",
                    F.coalesce("rejected_lines", F.lit(0)).cast("bigint").alias("rejected_lines")))


def _filed(spark, sf, bad: bool):
    """The priorities' graphs as part files, ordered by falling dst, then src;
    ``bad``: with comments and malformed lines among them."""
    from ..session import shared_path
    from ..sources import files as S
    path, e = shared_path(spark, "edgefiles"), _multi(spark, sf)
    line = F.concat(F.col("src").cast("string"), F.lit("\t "), F.col("dst").cast("string"), F.lit(" # edge"))
    lines = e.select(G, line.alias("value"), (-F.col("dst")).alias("o1"), F.col("src").alias("o2"))
    if bad:
        odd = E.vertices(e).where("vertex % 97 = 0")
        for text in (F.concat(F.lit("x"), "vertex"), F.lit("# note")):
            lines = lines.unionByName(odd.select(G, text.alias("value"), (-F.col("vertex")).alias("o1"), F.lit(0).cast("bigint").alias("o2")))
    S.write_named_edge_lists(lines, path, ["o1", "o2"])
    return path


@query("edge_list_files", f"""WITH {EDGES_MULTI}, {CANON},
bad AS (SELECT graph_name, count(*) AS n FROM v WHERE vertex % 97 = 0 GROUP BY graph_name)
SELECT graph_name, e.src, e.dst, coalesce(bad.n, 0) AS rejected_lines FROM e LEFT JOIN bad USING (graph_name)""")
def q_edge_list_files(spark, sf):
    """Part files of all graphs, named after them, with comments and
    malformed lines, written in parallel and read back in one scan."""
    from ..sources import files as S
    found, rejects = S.read_edge_lists(spark, _filed(spark, sf, True))
    return (found.join(S.reject_counts(rejects), G, "left")
            .select(G, "src", "dst", F.coalesce("rejected_lines", F.lit(0)).cast("bigint").alias("rejected_lines")))


@query("first_k_vertices_by_file", f"""WITH {EDGES_MULTI},
o AS (SELECT *, row_number() OVER (PARTITION BY graph_name ORDER BY dst DESC, src) AS pos FROM e),
seen AS (SELECT graph_name, vertex, min(place) AS place FROM
         (SELECT graph_name, src AS vertex, 2 * pos AS place FROM o UNION ALL SELECT graph_name, dst, 2 * pos + 1 FROM o) GROUP BY ALL)
SELECT graph_name, vertex, CAST(row_number() OVER w AS INTEGER) AS position FROM seen
WINDOW w AS (PARTITION BY graph_name ORDER BY place) QUALIFY row_number() OVER w <= 200""")
def q_first_k_vertices_by_file(spark, sf):
    """The 200 vertices of each graph that its files name first."""
    from ..sources import files as S
    edges, _ = S.read_edge_lists(spark, _filed(spark, sf, False), places=True)
    return S.first_k_vertices_by_file(edges, 200)


@query("hash_sample_vertices", f"""WITH {EDGES_MULTI}, {CANON}
SELECT graph_name, vertex FROM v
WHERE CAST('0x' || substr(md5(graph_name || '|' || CAST(vertex AS VARCHAR) || '|42'), 1, 15) AS BIGINT)
      % 1000000 < 500000""")
def q_hash_sample_vertices(spark, sf):
    """G18 (hash variant): about half of every graph's vertices, chosen by a
    seeded hash -- the same rows under any partitioning."""
    return E.hash_sample_vertices(E.vertices(_multi(spark, sf)), 0.5, seed=42)
