"""DuckDB CTE fragments that rebuild the fixture views from the raw tables,
used by the oracle SQL strings."""

# Co-purchase graph, one graph.
EDGES = """
op AS (SELECT DISTINCT l_orderkey AS okey, l_partkey AS part FROM lineitem),
e AS (SELECT DISTINCT 'copurchase' AS graph_name, a.part AS src, b.part AS dst
      FROM op a JOIN op b ON a.okey = b.okey AND a.part < b.part)"""

# One co-purchase graph per order priority.
EDGES_MULTI = """
op0 AS (SELECT DISTINCT l_orderkey AS okey, l_partkey AS part FROM lineitem),
op AS (SELECT op0.okey, op0.part, o.o_orderpriority AS graph_name
       FROM op0 JOIN orders o ON o.o_orderkey = op0.okey),
e AS (SELECT DISTINCT a.graph_name, a.part AS src, b.part AS dst
      FROM op a JOIN op b ON a.okey = b.okey AND a.part < b.part)"""

# One co-purchase graph per customer, all lines.
EDGES_CUSTOMER = """
op0 AS (SELECT DISTINCT l_orderkey AS okey, l_partkey AS part FROM lineitem),
op AS (SELECT op0.okey, op0.part, 'g' || CAST(o.o_custkey AS VARCHAR) AS graph_name
       FROM op0 JOIN orders o ON o.o_orderkey = op0.okey),
e AS (SELECT DISTINCT a.graph_name, a.part AS src, b.part AS dst
      FROM op a JOIN op b ON a.okey = b.okey AND a.part < b.part)"""

# Customer -- supplier graph.
EDGES_BIPARTITE = """
e AS (SELECT DISTINCT 'cust_supp' AS graph_name, o.o_custkey AS src, -1 - l.l_suppkey AS dst
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""

# Canonical simple graph (c), vertices (v), counts (cnt) over e.
CANON = """
c AS (SELECT DISTINCT graph_name, least(src, dst) AS src, greatest(src, dst) AS dst FROM e),
v AS (SELECT graph_name, src AS vertex FROM c UNION SELECT graph_name, dst FROM c),
nv AS (SELECT graph_name, count(*) AS nodes FROM v GROUP BY graph_name),
ne AS (SELECT graph_name, count(*) AS edges FROM c GROUP BY graph_name),
cnt AS (SELECT nv.graph_name, nv.nodes, coalesce(ne.edges, 0) AS edges,
               CASE WHEN nv.nodes > 0 THEN 2.0 * coalesce(ne.edges, 0) / nv.nodes ELSE 0.0 END AS avg_degree,
               CASE WHEN nv.nodes > 1 THEN 2.0 * coalesce(ne.edges, 0) / (nv.nodes * (nv.nodes - 1)) ELSE 0.0 END AS density
        FROM nv LEFT JOIN ne USING (graph_name))"""

# Triangles (a < b < c by id) over the loop-free canonical graph, per-vertex
# counts (tv), loop-free degree (kd) and local clustering (lc).
TRIANGLES = """
s AS (SELECT graph_name, src, dst FROM c WHERE src <> dst),
t AS (SELECT s1.graph_name, s1.src AS a, s1.dst AS b, s2.dst AS cc
      FROM s s1 JOIN s s2 ON s1.graph_name = s2.graph_name AND s1.src = s2.src AND s1.dst < s2.dst
      JOIN s s3 ON s3.graph_name = s1.graph_name AND s3.src = s1.dst AND s3.dst = s2.dst),
tv0 AS (SELECT graph_name, a AS vertex FROM t UNION ALL SELECT graph_name, b FROM t
        UNION ALL SELECT graph_name, cc FROM t),
tv AS (SELECT v.graph_name, v.vertex, count(tv0.vertex) AS triangles
       FROM v LEFT JOIN tv0 ON tv0.graph_name = v.graph_name AND tv0.vertex = v.vertex
       GROUP BY v.graph_name, v.vertex),
kd0 AS (SELECT graph_name, src AS vertex FROM s UNION ALL SELECT graph_name, dst FROM s),
kd AS (SELECT graph_name, vertex, count(*) AS degree FROM kd0 GROUP BY graph_name, vertex),
lc AS (SELECT tv.graph_name, tv.vertex, coalesce(kd.degree, 0) AS degree, tv.triangles,
              CASE WHEN coalesce(kd.degree, 0) >= 2
                   THEN 2.0 * tv.triangles / (kd.degree * (kd.degree - 1)) ELSE 0.0 END AS clustering
       FROM tv LEFT JOIN kd ON kd.graph_name = tv.graph_name AND kd.vertex = tv.vertex)"""

def components_sql(edges_fragment: str) -> str:
    """WITH RECURSIVE prefix producing ``comp`` and ``csum``."""
    return f"""WITH RECURSIVE {edges_fragment}, {CANON},
und AS (SELECT graph_name, src AS a, dst AS b FROM c WHERE src <> dst
        UNION ALL SELECT graph_name, dst, src FROM c WHERE src <> dst),
reach(graph_name, vertex, label) AS (
    SELECT graph_name, vertex, vertex FROM v
    UNION
    SELECT u.graph_name, u.b, r.label FROM reach r
    JOIN und u ON u.graph_name = r.graph_name AND u.a = r.vertex AND r.label < u.b),
comp AS (SELECT graph_name, vertex, min(label) AS component FROM reach GROUP BY graph_name, vertex),
csum AS (SELECT graph_name, count(DISTINCT component) AS num_components,
                count(DISTINCT component) = 1 AS is_connected,
                max(sz) AS largest_component
         FROM (SELECT graph_name, component, count(*) AS sz FROM comp GROUP BY graph_name, component)
         GROUP BY graph_name)"""


def pagerank_sql(edges_fragment: str, iterations: int = 10, damping: float = 0.85,
                 initial: float = 1.0) -> str:
    """Unrolled fixed-iteration PageRank; final ranks in ``r{iterations}``."""
    parts = [edges_fragment,
             """v AS (SELECT graph_name, src AS vertex FROM e UNION SELECT graph_name, dst FROM e),
od AS (SELECT graph_name, src, count(*) AS deg FROM e GROUP BY graph_name, src),
ew AS (SELECT e.graph_name, e.src, e.dst, 1.0::DOUBLE / od.deg AS w FROM e JOIN od USING (graph_name, src))""",
             f"r0 AS (SELECT graph_name, vertex, {initial}::DOUBLE AS pr FROM v)"]
    for i in range(1, iterations + 1):
        parts.append(f"""r{i} AS MATERIALIZED (
  SELECT v.graph_name, v.vertex,
         (1.0 - {damping}::DOUBLE) + {damping}::DOUBLE * coalesce(x.s, 0.0) AS pr
  FROM v LEFT JOIN (SELECT ew.graph_name, ew.dst AS vertex, sum(r.pr * ew.w) AS s
                    FROM ew JOIN r{i-1} r ON r.graph_name = ew.graph_name AND r.vertex = ew.src
                    GROUP BY ew.graph_name, ew.dst) x
  ON x.graph_name = v.graph_name AND x.vertex = v.vertex)""")
    return "WITH " + ",\n".join(parts)


def pagerank_converged_sql(edges_fragment: str, steps: int = 40, alpha: float = 0.85, tol: float = 1e-6) -> str:
    """Unrolled converged PageRank; a graph's rows stop changing once its
    ``done`` flag is set.  Final rows in ``s{steps}``."""
    parts = [edges_fragment, CANON, """
sym AS (SELECT graph_name, src, dst FROM c UNION ALL SELECT graph_name, dst, src FROM c WHERE src <> dst),
od AS (SELECT graph_name, src, count(*) AS deg FROM sym GROUP BY ALL),
ew AS (SELECT graph_name, src, dst, 1.0::DOUBLE / deg AS w FROM sym JOIN od USING (graph_name, src)),
s0 AS (SELECT graph_name, vertex, 1.0::DOUBLE / nodes AS pr, nodes, 0 AS iterations, false AS done,
              NULL::DOUBLE AS error FROM v JOIN nv USING (graph_name))"""]
    for i in range(1, steps + 1):
        parts.append(f"""x{i} AS MATERIALIZED (
  SELECT s.*, {alpha}::DOUBLE * coalesce(k.t, 0.0) + (1.0 - {alpha}::DOUBLE) / s.nodes AS new
  FROM s{i-1} s LEFT JOIN (SELECT ew.graph_name, ew.dst AS vertex, sum(p.pr * ew.w) AS t
                           FROM ew JOIN s{i-1} p ON p.graph_name = ew.graph_name AND p.vertex = ew.src
                           WHERE NOT p.done GROUP BY ALL) k USING (graph_name, vertex)),
s{i} AS MATERIALIZED (
  SELECT graph_name, vertex, CASE WHEN done THEN pr ELSE new END AS pr, nodes,
         CASE WHEN done THEN iterations ELSE {i} END AS iterations, done OR g.e < nodes * {tol} AS done,
         CASE WHEN done THEN error ELSE g.e END AS error
  FROM x{i} JOIN (SELECT graph_name, sum(abs(new - pr)) AS e FROM x{i} GROUP BY ALL) g USING (graph_name))""")
    return "WITH " + ",\n".join(parts)


# The runs view over events.
RUNS = r"""
runs AS (SELECT event_id AS run_id, 'g' || CAST(user_id AS VARCHAR) AS graph_name,
                event_type AS algorithm_type, value AS simulated_time,
                CAST(1 + floor(hour(ts) / 3) AS INTEGER) AS num_nodes, 4 AS cores_per_node,
                CAST(8 + 4 * (CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) % 3) AS INTEGER) AS memory_per_node_gb
         FROM events),
runs1 AS (SELECT *, num_nodes * cores_per_node AS total_cores,
                 num_nodes * memory_per_node_gb AS total_memory_gb, num_nodes AS node_cost FROM runs)"""

# Customer graphs for the customers that appear in runs.
EDGES_RUNS = """
op0 AS (SELECT DISTINCT l_orderkey AS okey, l_partkey AS part FROM lineitem),
op AS (SELECT op0.okey, op0.part, 'g' || CAST(o.o_custkey AS VARCHAR) AS graph_name
       FROM op0 JOIN orders o ON o.o_orderkey = op0.okey
       WHERE o.o_custkey IN (SELECT user_id FROM events)),
e AS (SELECT DISTINCT a.graph_name, a.part AS src, b.part AS dst
      FROM op a JOIN op b ON a.okey = b.okey AND a.part < b.part)"""


def features_sql() -> str:
    """WITH RECURSIVE prefix ending in ``feat`` (G19 over the run graphs) and
    ``rf`` (runs assembled with features, flags and category)."""
    return components_sql(EDGES_RUNS) + f""", {TRIANGLES}, {RUNS},
feat AS (SELECT cnt.graph_name, cnt.nodes, cnt.edges, cnt.density, csum.is_connected,
                csum.num_components, a.avg_clustering
         FROM cnt JOIN csum USING (graph_name)
         JOIN (SELECT graph_name, avg(clustering) AS avg_clustering FROM lc GROUP BY graph_name) a
         USING (graph_name)),
rf AS (SELECT r.*, f.nodes, f.edges, f.density, f.is_connected, f.num_components, f.avg_clustering,
              r.simulated_time <= 20 AS meets_deadline_20s, r.simulated_time <= 30 AS meets_deadline_30s,
              r.simulated_time <= 45 AS meets_deadline_45s, r.simulated_time <= 60 AS meets_deadline_60s,
              CASE WHEN r.simulated_time < 10 THEN 'fast' WHEN r.simulated_time < 30 THEN 'medium'
                   WHEN r.simulated_time < 60 THEN 'slow' ELSE 'very_slow' END AS execution_category
       FROM runs1 r LEFT JOIN feat f USING (graph_name))"""


WORKLOADS = """
wj AS (SELECT o.o_orderpriority || '/' || l.l_returnflag AS workload, l.l_partkey, l.l_suppkey
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
wg AS (SELECT workload, count(DISTINCT (l_partkey, l_suppkey)) AS edges,
              count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS nodes FROM wj GROUP BY workload),
wl AS (SELECT workload, edges, nodes,
              CASE WHEN nodes > 1 THEN 2.0 * edges / (nodes * (nodes - 1)) ELSE 0.0 END AS density,
              algorithm
       FROM wg CROSS JOIN (VALUES ('PageRank'), ('ConnectedComponents'), ('TriangleCounting')) a(algorithm))"""


def rule_nodes_sql(policy: str, algorithm: str, edges: str, density: str) -> str:
    """The five sizing rules as a DuckDB expression."""
    cat = (f"(CASE WHEN (CASE {algorithm} WHEN 'PageRank' THEN 1.0 WHEN 'ConnectedComponents' THEN 0.8 "
           f"WHEN 'TriangleCounting' THEN 5.4 ELSE 1.0 END) > 3.0 THEN 'high' "
           f"WHEN (CASE {algorithm} WHEN 'PageRank' THEN 1.0 WHEN 'ConnectedComponents' THEN 0.8 "
           f"WHEN 'TriangleCounting' THEN 5.4 ELSE 1.0 END) > 1.0 THEN 'medium' ELSE 'low' END)")
    base = f"least(8, greatest(2, floor(log10(greatest({edges}, 1000)) / 3.0)))"
    boost = f"(CASE {cat} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)"
    log_n = f"greatest(2, least(8, {base} + {boost}))"
    init = f"least(8, greatest(1, floor(sqrt(greatest(1, floor({edges} / 100000))))))"
    add = f"(CASE {algorithm} WHEN 'TriangleCounting' THEN 2 WHEN 'PageRank' THEN 1 ELSE 0 END)"
    s = f"greatest(1, least(8, {init} + {add}))"
    sqrt_n = f"(CASE WHEN {density} > 0.001 THEN least(8, {s} + 1) ELSE {s} END)"
    size = f"greatest(1, floor({edges} / 50000))"
    lin = (f"(CASE {cat} WHEN 'high' THEN floor({size} * 1.5) WHEN 'medium' THEN {size} "
           f"ELSE greatest(1, floor({size} * 0.8)) END)")
    linear_n = f"least(8, greatest(1, {lin}))"
    tiered = (f"(CASE WHEN {algorithm} = 'TriangleCounting' AND {edges} > 150000 THEN 4 "
              f"WHEN {algorithm} = 'TriangleCounting' AND {edges} > 50000 THEN 2 ELSE 1 END)")
    return (f"CAST(CASE {policy} WHEN 'log' THEN {log_n} WHEN 'sqrt' THEN {sqrt_n} "
            f"WHEN 'linear' THEN {linear_n} WHEN 'fixed' THEN 4 WHEN 'tiered' THEN {tiered} END AS INTEGER)")


POLICY_VALUES = "(VALUES ('log'), ('sqrt'), ('linear'), ('fixed'), ('tiered')) p(policy)"

THRESHOLDS = """
th AS (SELECT graph_name AS dataset, algorithm_type AS algorithm, num_nodes AS level,
              simulated_time <= 60 AS success, simulated_time AS time,
              CASE WHEN simulated_time <= 60 THEN NULL WHEN simulated_time < 120 THEN 'deadline_exceeded'
                   ELSE 'far_over_deadline' END AS failure_reason FROM runs1),
sc AS (SELECT graph_name AS dataset, algorithm_type AS algorithm, num_nodes AS level,
              avg(simulated_time) AS time, bool_and(simulated_time <= 60) AS success
       FROM runs1 GROUP BY ALL),
ml AS (SELECT dataset, algorithm, coalesce(min(CASE WHEN success THEN level END), max(level)) AS min_level,
              count_if(success) AS passing FROM th GROUP BY ALL),
se AS (SELECT p.dataset, p.algorithm, p.level, b.time AS baseline_time, p.time AS parallel_time,
              b.time / nullif(p.time, 0) AS speedup, b.time / nullif(p.time, 0) / p.level AS efficiency
       FROM sc p JOIN sc b ON b.dataset = p.dataset AND b.algorithm = p.algorithm AND b.level = 1 AND b.success
       WHERE p.level <> 1 AND p.success)"""
