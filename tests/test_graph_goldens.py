"""Hand-made graphs with known answers, plus brute-force cross-checks."""
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from capgraph.operators.graph import components as CC
from capgraph.operators.graph import edges as E
from capgraph.operators.graph import features as FT
from capgraph.operators.graph import pagerank as PR
from capgraph.operators.graph import triangles as TR
from conftest import edges_df, multi_edges_df

TRI_TAIL = [(1, 2), (2, 3), (1, 3), (3, 4)]
STAR6 = [(0, i) for i in range(1, 7)]
TWO_EDGES = [(1, 2), (3, 4)]
LOOP = [(5, 5), (5, 6)]
PARALLEL = [(1, 2), (2, 1), (1, 2), (2, 3)]
K5 = list(itertools.combinations(range(5), 2))


def by_graph(df, col):
    return {r["graph_name"]: r[col] for r in df.collect()}


def test_counts_density_and_categories(spark):
    e = multi_edges_df(spark, {"tri": TRI_TAIL, "star": STAR6, "loop": LOOP, "par": PARALLEL})
    c = E.graph_counts(E.canonical_edges(e))
    nodes, edges = by_graph(c, "nodes"), by_graph(c, "edges")
    assert nodes == {"tri": 4, "star": 7, "loop": 2, "par": 3}
    assert edges == {"tri": 4, "star": 6, "loop": 2, "par": 2}
    dens = by_graph(c, "density")
    assert dens["tri"] == pytest.approx(2 * 4 / (4 * 3))
    assert dens["loop"] == pytest.approx(2 * 2 / (2 * 1))
    prof = FT.graph_profile(e)
    assert set(by_graph(prof, "size_category").values()) == {"small"}


def test_degree_self_loop_counts_two(spark):
    d = E.degree(E.canonical_edges(edges_df(spark, LOOP)))
    got = {r["vertex"]: r["degree"] for r in d.collect()}
    assert got == {5: 3, 6: 1}
    total = d.agg(F.sum("degree")).first()[0]
    assert total == 2 * 2


def test_components(spark):
    e = multi_edges_df(spark, {"two": TWO_EDGES, "tri": TRI_TAIL, "loop": LOOP})
    comps = CC.connected_components(e)
    got = {(r["graph_name"], r["vertex"]): r["component"] for r in comps.collect()}
    assert got[("two", 2)] == 1 and got[("two", 4)] == 3
    assert all(got[("tri", v)] == 1 for v in (1, 2, 3, 4))
    assert got[("loop", 6)] == 5
    s = by_graph(CC.component_summary(comps), "num_components")
    assert s == {"two": 2, "tri": 1, "loop": 1}
    # every component id is the smallest member
    assert all(c <= v for (_, v), c in got.items())


def test_components_isolated_vertex(spark):
    e = edges_df(spark, [(1, 2)])
    verts = spark.createDataFrame([("g", 1), ("g", 2), ("g", 9)], "graph_name string, vertex bigint")
    got = {r["vertex"]: r["component"] for r in CC.connected_components(e, verts).collect()}
    assert got == {1: 1, 2: 1, 9: 9}


def test_components_long_path_matches_bruteforce(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(260, 2))]
    e = edges_df(spark, pairs)
    got = {r["vertex"]: r["component"] for r in CC.connected_components(e).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    want = {v: min(u for u in got if find(u) == find(v)) for v in got}
    assert got == want


def test_triangles_and_clustering(spark):
    e = multi_edges_df(spark, {"k5": K5, "tri": TRI_TAIL, "star": STAR6, "loop": LOOP})
    t = by_graph(TR.triangle_count(e), "triangles")
    assert t == {"k5": 10, "tri": 1, "star": 0, "loop": 0}
    per = TR.triangles_per_vertex(e).groupBy("graph_name").agg(F.sum("triangles").alias("s"))
    assert by_graph(per, "s") == {"k5": 30, "tri": 3, "star": 0, "loop": 0}
    cl = by_graph(TR.average_clustering(e), "avg_clustering")
    assert cl["k5"] == pytest.approx(1.0)
    assert cl["tri"] == pytest.approx((1 + 1 + 1 / 3 + 0) / 4)
    assert cl["star"] == 0.0


def test_triangles_bruteforce_random(spark):
    rng = np.random.default_rng(3)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 40, size=(300, 2)) if p[0] != p[1]}
    e = edges_df(spark, list(pairs))
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    want = sum(1 for a, b, c in itertools.combinations(sorted(adj), 3)
               if b in adj[a] and c in adj[a] and c in adj[b])
    assert TR.triangle_count(e).first()["triangles"] == want


def test_triangle_estimate_sampled_branch(spark):
    e = edges_df(spark, K5 + [(10, 11), (11, 12)])
    out = TR.triangle_estimate(e, threshold=5, sample_size=4, exponent=1.4).first()
    # 8 vertices > 5: count on vertices {0,1,2,3} (4 triangles), scaled by (8/4)^1.4
    assert out["sampled"] is True
    assert out["triangles"] == int(4 * (8 / 4) ** 1.4)
    raw = TR.triangle_estimate(e, threshold=5, sample_size=4, extrapolate=False).first()
    assert raw["triangles"] == 4


def test_sampled_clustering_branch(spark):
    e = edges_df(spark, K5 + [(10, 11)])
    out = TR.sampled_average_clustering(e, threshold=5, sample_size=3).first()
    assert out["sampled"] is True
    assert out["avg_clustering"] == pytest.approx(1.0)


def _pagerank_fixed_numpy(pairs, n_iter=10, d=0.85):
    vs = sorted({v for p in pairs for v in p})
    idx = {v: i for i, v in enumerate(vs)}
    out = np.zeros(len(vs))
    for a, _ in pairs:
        out[idx[a]] += 1
    r = np.ones(len(vs))
    for _ in range(n_iter):
        s = np.zeros(len(vs))
        for a, b in pairs:
            s[idx[b]] += r[idx[a]] / out[idx[a]]
        r = (1 - d) + d * s
    return {v: r[idx[v]] for v in vs}


def test_pagerank_fixed_matches_numpy(spark):
    rng = np.random.default_rng(11)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, size=(80, 2)) if a < b})
    got = {r["vertex"]: r["pagerank"] for r in PR.pagerank_fixed(edges_df(spark, pairs)).collect()}
    want = _pagerank_fixed_numpy(pairs)
    assert got.keys() == want.keys()
    for v in want:
        assert got[v] == pytest.approx(want[v], rel=1e-9)


def _pagerank_nx_style(pairs, alpha=0.85, tol=1e-6, max_iter=100):
    vs = sorted({v for p in pairs for v in p})
    idx = {v: i for i, v in enumerate(vs)}
    n = len(vs)
    nbrs = [set() for _ in vs]
    for a, b in pairs:
        nbrs[idx[a]].add(idx[b])
        nbrs[idx[b]].add(idx[a])
    x = np.full(n, 1.0 / n)
    for it in range(max_iter):
        last = x
        x = np.zeros(n)
        for u in range(n):
            for v in nbrs[u]:
                x[v] += alpha * last[u] / len(nbrs[u])
        x += (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            return {v: x[idx[v]] for v in vs}, it + 1
    raise AssertionError("no convergence")


def test_pagerank_converged_matches_power_iteration(spark):
    pairs = TRI_TAIL + [(4, 5), (5, 6), (6, 4), (6, 7)]
    out = PR.pagerank_converged(edges_df(spark, pairs)).collect()
    want, iters = _pagerank_nx_style(pairs)
    assert sum(r["pagerank"] for r in out) == pytest.approx(1.0)
    for r in out:
        assert r["pagerank"] == pytest.approx(want[r["vertex"]], rel=1e-9)
        assert r["converged"] and r["iterations"] == iters


def test_dispatch(spark):
    e = edges_df(spark, K5)
    _, s = FT.run_algorithm(e, "connected_components")
    assert s.first()["result_count"] == 1
    _, s = FT.run_algorithm(e, "TriangleCounting")
    assert s.first()["result_count"] == 10
    _, s = FT.run_algorithm(e, "PAGERANK")
    assert s.first()["result_count"] == 5
    with pytest.raises(ValueError):
        FT.run_algorithm(e, "shortest_paths")


def test_empty_graph(spark):
    e = edges_df(spark, [])
    assert E.graph_counts(E.canonical_edges(e)).count() == 0
    assert CC.connected_components(e).count() == 0
    assert TR.triangle_count(e).count() == 0


def test_rank_datasets(spark):
    prof = spark.createDataFrame(
        [("a", 30000, 4.0, 0.0002), ("b", 10000, 10.0, 0.002), ("c", 6000, 8.0, 0.004)],
        "graph_name string, nodes long, avg_degree double, density double")
    out = FT.rank_datasets(prof).collect()
    pr = [r["graph_name"] for r in sorted(out, key=lambda r: r["rank"]) if r["algorithm"] == "PageRank"]
    assert pr == ["a", "b", "c"]
    tc = [r["graph_name"] for r in sorted(out, key=lambda r: r["rank"])
          if r["algorithm"] == "TriangleCounting"]
    assert tc == ["c", "b"]


def test_hash_sample_is_repeatable(spark):
    verts = spark.range(0, 2000).selectExpr("'g' AS graph_name", "id AS vertex")
    a = E.hash_sample_vertices(verts, 0.3)
    b = E.hash_sample_vertices(verts.repartition(7), 0.3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert 450 < a.count() < 750


def test_pagerank_never_reshuffles_edges(spark):
    """Large-data plan shape: with broadcasts off, the bucketed edge table
    reaches the iteration join without an Exchange above its scan."""
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 200, size=(600, 2)) if a < b})
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        e = edges_df(spark, pairs)
        ranks = E.vertices(e).withColumn("pagerank", F.lit(1.0))
        df = PR.WeightedEdges(e).contributions(ranks).groupBy("graph_name", "vertex").agg(F.sum("c"))
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    scans = [i for i, line in enumerate(plan) if "Bucketed: true" in line and "Scan" in line]
    assert scans
    for i in scans:
        depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
        for line in reversed(plan[:i]):
            d = len(line) - len(line.lstrip(" :+-"))
            if d < depth:
                assert "Exchange" not in line, line
                if "Join" in line:
                    break
                depth = d


def test_hubs_are_salted_and_change_nothing(spark, monkeypatch):
    """A vertex with most edges: every operator gives the same with salts, and
    the hub's rows no longer meet in one partition."""
    from capgraph.operators.graph import skew
    rng = np.random.default_rng(5)
    pairs = sorted({(0, int(v)) for v in range(1, 400)}
                   | {tuple(sorted((int(a), int(b)))) for a, b in rng.integers(1, 400, size=(500, 2)) if a != b})
    e = edges_df(spark, pairs)

    def everything():
        return [sorted(map(tuple, df.collect())) for df in (
            CC.connected_components(e), TR.triangle_count(e), TR.triangles_per_vertex(e),
            PR.pagerank_fixed(e, max_iterations=3).select("graph_name", "vertex", F.round("pagerank", 9)),
            PR.pagerank_converged(e).select("graph_name", "vertex", F.round("pagerank", 9), "iterations"))]

    plain = everything()
    monkeypatch.setattr(skew, "HUB_ENDS", 100)
    hubs = skew.find_hubs(TR.vertices_of_ends(e), len(pairs))
    assert [r.vertex for r in hubs.collect()] == [0]
    assert everything() == plain
    by = skew.salted(e, hubs, "src", ["dst"]).where("src = 0").groupBy("_salt").count().collect()
    assert len(by) > skew.SALTS // 2 and max(r["count"] for r in by) < 40


def test_hub_bound_keeps_the_list_of_hubs_small():
    from capgraph.operators.graph import skew
    for edges in (10, 10**6, 10**9, 10**12):
        assert 2 * edges / skew.hub_bound(edges) <= skew.MOST_HUBS


def test_components_raise_at_the_round_cap(spark):
    place = np.random.default_rng(2).permutation(401).tolist()
    e = edges_df(spark, [(place[k], place[k + 1]) for k in range(400)]).repartition(8)
    with pytest.raises(RuntimeError):
        CC.connected_components(e, max_rounds=1, finish_edges=0)
    assert CC.connected_components(e, finish_edges=0).select("component").distinct().count() == 1
    assert CC.connected_components(e).select("component").distinct().count() == 1


def test_rounds_leave_two_folders(spark, tmp_path):
    import os

    from capgraph.session import Rounds
    rounds = Rounds(spark)
    df = spark.range(3)
    for _ in range(5):
        df = rounds.write(df)
    assert df.count() == 3 and len(rounds.paths) == 2
    assert all(os.path.isdir(p.removeprefix("file:")) for p in rounds.paths)


def test_pagerank_leaves_no_tables(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert PR.pagerank_fixed(edges_df(spark, TRI_TAIL)).count() == 4
    assert PR.pagerank_converged(edges_df(spark, TRI_TAIL)).count() == 4
    assert {t.name for t in spark.catalog.listTables()} <= before


def test_first_k_for_large_k_sorts_no_whole_graph(spark):
    verts = spark.range(0, 30000).selectExpr("'g' AS graph_name", "id AS vertex")
    out = E.first_k_vertices(verts, 10000)
    assert out.count() == 10000 and out.agg(F.max("vertex")).first()[0] == 9999
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_shard" in plan and plan.count("Window") >= 2


def test_density_of_a_huge_graph_does_not_overflow(spark):
    df = spark.range(1).select(E.density_expr(F.lit(4_000_000_000), F.lit(10)).alias("d"))
    assert df.first()["d"] == pytest.approx(20 / 4e9 / 4e9, rel=1e-6)


def test_graph_features_are_exact_unless_asked(spark):
    pairs = [(k, k + 1) for k in range(60000)] + K5
    row = FT.graph_features(edges_df(spark, pairs)).first()
    want = TR.average_clustering(edges_df(spark, pairs)).first()["avg_clustering"]
    assert row["sampled"] is False and row["nodes"] == 60001 and row["avg_clustering"] == pytest.approx(want)
    sampled = FT.graph_features(edges_df(spark, pairs), clustering_threshold=50000, clustering_sample=5).first()
    assert sampled["sampled"] is True and sampled["avg_clustering"] == pytest.approx(1.0)


def test_pagerank_returns_only_asked_vertices(spark):
    verts = spark.createDataFrame([("g", 1), ("g", 9)], "graph_name string, vertex bigint")
    got = {r["vertex"] for r in PR.pagerank_fixed(edges_df(spark, TRI_TAIL), verts).collect()}
    assert got == {1, 9}
    out = PR.pagerank_converged(edges_df(spark, TRI_TAIL), max_iter=1).collect()
    assert all(not r["converged"] and r["iterations"] == 1 and r["error"] > 0 for r in out)
    with pytest.raises(RuntimeError):
        PR.pagerank_converged(edges_df(spark, TRI_TAIL), max_iter=1, must_converge=True)


def random_graphs(spark):
    rng = np.random.default_rng(11)
    pairs = {}
    for name, n, m in (("a", 60, 500), ("b", 200, 260), ("c", 30, 60), ("one", 2, 1)):
        pairs[name] = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, size=(m, 2))})
    pairs["hub"] = [(0, v) for v in range(1, 120)] + [(v, v + 1) for v in range(1, 119)]
    pairs["loop"] = [(1, 2), (2, 3), (3, 1), (9, 9)]
    return multi_edges_df(spark, pairs).repartition(6), pairs


def brute_triangles(pairs):
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return {tuple(sorted((a, b, c))) for a in adj for b in adj[a] for c in adj[a] & adj[b]}


@pytest.mark.parametrize("triple_edges", [1_000_000, 100, 7])
def test_triangles_by_colours_match_brute_force(spark, triple_edges):
    """Whole graphs in a task, triples of colours, and triples split again."""
    e, pairs = random_graphs(spark)
    want = {g: brute_triangles(p) for g, p in pairs.items()}
    found = {}
    for r in TR.triangles(e, triple_edges).collect():
        found.setdefault(r.graph_name, []).append(tuple(sorted((r.a, r.b, r.c))))
    assert all(sorted(found.get(g, [])) == sorted(want[g]) for g in want)
    assert {r.graph_name: r.triangles for r in TR.triangle_count(e, triple_edges=triple_edges).collect()} == {g: len(t) for g, t in want.items()}
    per = {(r.graph_name, r.vertex): r.triangles for r in TR.triangles_per_vertex(e, triple_edges=triple_edges).collect()}
    assert all(n == sum(v in t for t in want[g]) for (g, v), n in per.items()) and ("loop", 9) in per


@pytest.mark.parametrize("wedges, triple_edges, hubs", [(0, 1_000_000, False), (0, 7, False), (2, 100, False), (2, 7, True), (1_000_000, 7, True)])
def test_triangles_by_lists_and_by_colours_match_brute_force(spark, monkeypatch, wedges, triple_edges, hubs):
    """All graphs by colours, some by lists, all by lists; with and without salts."""
    if hubs:
        monkeypatch.setattr("capgraph.operators.graph.skew.HUB_ENDS", 20)
    e, pairs = random_graphs(spark)
    want = {g: brute_triangles(p) for g, p in pairs.items()}
    found = {}
    for r in TR.triangles(e, triple_edges, wedges).collect():
        found.setdefault(r.graph_name, []).append(tuple(sorted((r.a, r.b, r.c))))
    assert all(sorted(found.get(g, [])) == sorted(want[g]) for g in want)
    per = {(r.graph_name, r.vertex): r.triangles
           for r in TR.triangles_per_vertex(e, triple_edges=triple_edges, wedges=wedges).collect()}
    assert all(n == sum(v in t for t in want[g]) for (g, v), n in per.items()) and ("loop", 9) in per


def test_triangles_of_a_sparse_graph_move_its_wedges(spark):
    """An edge isn't copied for every colour, of which a large graph has many."""
    e, _ = random_graphs(spark)
    plan = TR.triangle_count(e, triple_edges=7)._jdf.queryExecution().toString()
    assert "array_intersect" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("finish_edges", [1_000_000, 0])
def test_components_of_many_graphs_match_union_find(spark, finish_edges):
    e, pairs = random_graphs(spark)
    got = {(r.graph_name, r.vertex): r.component for r in CC.connected_components(e, finish_edges=finish_edges).collect()}
    assert got["loop", 3] == 1 and got["loop", 9] == 9
    for g, p in pairs.items():
        parent = {v: v for pair in p for v in pair}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in p:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        assert all(got[g, v] == root(v) for v in parent)


def test_contraction_sends_a_forest(spark):
    e, _ = random_graphs(spark)
    one = CC.contracted(e.filter("src <> dst").coalesce(1)).collect()
    assert len(one) == len({(r.graph_name, r.src) for r in one}) and all(r.dst < r.src for r in one)


def test_contraction_merges_batches_that_are_not_null(spark, monkeypatch):
    """Stars that are held meet batches whose schema says not null."""
    monkeypatch.setattr(CC, "MERGE_EDGES", 20)
    e = spark.range(0, 30_000, numPartitions=1).select(F.lit("g").alias("graph_name"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert not e.schema["src"].nullable
    found = CC.contracted(e).collect()
    assert len(found) == 30_000 and {r.dst for r in found} == {0}


def test_operators_share_a_prepared_graph(spark):
    """The edge frame's plan runs once for all operators of a prepared graph."""
    from capgraph.operators.graph.prepared import graph
    e, _ = random_graphs(spark)
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    n = e.count()
    g = graph(e.mapInArrow(counted, e.schema))
    for name in ("PageRank", "ConnectedComponents", "TriangleCounting"):
        FT.run_algorithm(g, name)[1].collect()
    TR.average_clustering(g).collect()
    FT.graph_features(g).collect()
    assert runs.value == n


def test_small_graphs_are_counted_whole(spark):
    """Their edges move once, to a task that has whole graphs: no joins by
    vertex; larger graphs, loops and graphs without a name as before."""
    from capgraph.operators.graph.prepared import graph
    e, pairs = random_graphs(spark)
    nameless = spark.createDataFrame([(None, a, b) for a, b in ((1, 2), (2, 3), (1, 3))], e.schema)
    g = graph(e.unionByName(nameless))
    got = {(r.graph_name, r.vertex): (r.degree, r.triangles) for r in TR.local_clustering(g).collect()}
    assert not {"oriented", "out_lists", "simple_degree", "vertices"} & set(g.__dict__)
    want = {}
    for name, p in pairs.items():
        found, simple = brute_triangles(p), {tuple(sorted(x)) for x in p if x[0] != x[1]}
        for v in {v for pair in p for v in pair}:
            want[name, v] = (sum(v in x for x in simple), sum(v in t for t in found))
    assert got == want | {(None, v): (2, 0) for v in (1, 2, 3)}
    counted, rest = TR.split(g, 7)
    large = {r.graph_name for r in rest.canon.select("graph_name").distinct().collect()}
    assert large and all(len({tuple(sorted(x)) for x in pairs[name]}) > 7 for name in large)
    assert large | {r.graph_name for r in counted.collect()} == {*pairs, None}
    assert not large & {r.graph_name for r in counted.collect()}
    some = spark.createDataFrame([(name,) for name in list(pairs)[::2]], "graph_name string")
    left = g.without(some)
    assert ({r.graph_name: r.triangles for r in TR.triangle_count(left, triple_edges=7).collect()}
            == {name: len(brute_triangles(p)) for name, p in list(pairs.items())[1::2]} | {None: 0})


def union_find(rows):
    """(name, vertex) -> least of its component, by brute force; an edge with one end is a loop."""
    parent = {}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for name, a, b in rows:
        a, b = (b if a is None else a), (a if b is None else b)
        for v in (a, b):
            parent.setdefault((name, v), (name, v))
        if a is not None:
            a, b = root((name, a)), root((name, b))
            parent[max(a, b, key=lambda x: x[1])] = min(a, b, key=lambda x: x[1])
    return {v: root(v)[1] for v in parent}


@pytest.mark.parametrize("finish,shard,merge", [(1_000_000, 2_000_000, 50), (60, 25, 2_000_000), (0, 15, 10), (60, 2_000_000, 50)])
def test_components_of_dealt_edges_match_union_find(spark, monkeypatch, finish, shard, merge):
    """Whole graphs, graphs dealt by their ends, and rounds after these; with
    loops, repeats, both directions, ends and names that are null."""
    monkeypatch.setattr(CC, "SHARD_EDGES", shard)
    monkeypatch.setattr(CC, "MERGE_EDGES", merge)
    monkeypatch.setattr(CC, "FINISH_EDGES", 60)
    rng = np.random.default_rng(11)
    rows = [(name, int(a), int(b)) for name, n in (("wide", 90), (None, 70), ("small", 30))
            for a, b in rng.integers(0, n, size=(n, 2)) * 10**15 - 3]
    rows += rows[::5] + [(n, b, a) for n, a, b in rows[::7]] + [("wide", 5, 5), ("loop", 8, 8), ("small", 9, None), ("small", None, 9),
                                                               ("wide", None, 4), ("odd", None, None), (None, 7, 7)]
    rows += [("path", k, k + 1) for k in range(100)]
    e = spark.createDataFrame(rows, "graph_name string, src bigint, dst bigint").repartition(6)
    got = [(r.graph_name, r.vertex, r.component) for r in CC.connected_components(e, finish_edges=finish).collect()]
    assert len(got) == len(set(got)) and {(n, v): c for n, v, c in got} == union_find(rows)


def test_components_move_no_row_for_an_edge(spark, monkeypatch):
    """Edges reach their tasks as arrays, and no distinct of them comes first."""
    e, _ = random_graphs(spark)
    plan = CC.dealt(e, F.lit(0), 1)._jdf.queryExecution().toString()
    assert "edges" in plan and "HashAggregate" not in plan
    seen = []
    monkeypatch.setattr(CC, "graph", lambda *a: seen.append(graph_of(*a)) or seen[-1])
    from capgraph.operators.graph.prepared import graph as graph_of
    CC.connected_components(e).collect()
    assert not {"canon", "vertices", "simple"} & set(seen[0].__dict__)


def test_views_list_pairs_of_orders(spark, tmp_path):
    """Repeated lines and orders, null keys and names; all views share one listing."""
    from capgraph.sources import tables as T
    lines = [(1, 5, 1.0), (1, 3, 2.0), (1, 5, 3.0), (1, 9, 1.0), (2, 3, 1.0), (2, 5, 1.0), (3, 7, 1.0), (None, 1, 1.0), (None, 2, 1.0),
             (4, None, 1.0), (4, 2, 1.0), (4, 1, 9.0), (5, 1, 1.0), (5, 2, 1.0)]
    orders = [(1, 11, "a"), (1, 11, "b"), (1, 12, "a"), (2, 11, None), (3, 11, "a"), (4, None, "b"), (6, 11, "a")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(11,), (99,), (None,)], "user_id bigint").write.parquet(f"{tmp_path}/events.parquet")

    def rows(df):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got))
        return set(got)

    one = {(3, 5), (3, 9), (5, 9)}
    assert rows(T.copurchase_edges(spark, str(tmp_path))) == {("copurchase", *p) for p in one | {(1, 2)}}
    assert rows(T.copurchase_edges(spark, str(tmp_path), 2.0)) == {("copurchase", 3, 5)}
    assert rows(T.copurchase_edges_multi(spark, str(tmp_path))) == {(n, *p) for n in "ab" for p in one} | {(None, 3, 5), ("b", 1, 2)}
    assert rows(T.customer_graph_edges(spark, str(tmp_path))) == {(n, *p) for n in ("g11", "g12") for p in one} | {(None, 1, 2)}
    assert rows(T.run_graph_edges(spark, str(tmp_path))) == {("g11", *p) for p in one}


@pytest.mark.parametrize("light", [256, 2])
def test_lists_in_passes_close_the_same_triangles(spark, monkeypatch, light):
    """Lists that are moved in passes, of edges ordered by id or by the degrees of
    a few vertices, give all triangles."""
    from capgraph.operators.graph import prepared
    monkeypatch.setattr(TR, "PASS_BYTES", 200)
    monkeypatch.setattr(TR, "PASS_EDGE", 1)
    monkeypatch.setattr(prepared, "LIGHT", light)
    e, pairs = random_graphs(spark)
    taken = []
    closed = TR._closed
    monkeypatch.setattr(TR, "_closed", lambda *a: taken.append(a[2:]) or closed(*a))
    g = prepared.graph(e)
    got = {r.graph_name: r.triangles for r in TR.triangle_count(g, triple_edges=7, wedges=10**6).collect()}
    assert got == {name: len(brute_triangles(p)) for name, p in pairs.items()}
    assert len(taken) > 1 and {t[0] for t in taken} == {len(taken)} and [t[1] for t in taken] == [*range(len(taken))]
    each = {(r.graph_name, r.vertex): r.triangles for r in TR.triangles_per_vertex(g, triple_edges=7, wedges=10**6).collect()}
    assert each == {(name, v): sum(v in t for t in brute_triangles(p)) for name, p in pairs.items() for v in {v for pair in p for v in pair}}
    rest = TR.split(g, 7)[1]
    assert (rest.heavy is None) == (light == 256)
    assert "SortMergeJoin" not in rest.oriented._jdf.queryExecution().toString()


def test_written_frames_leave_no_shuffle_files(spark):
    from capgraph.session import written
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, held = spark.conf.get(key, None), tracker.shuffleStatuses().size()
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("x")).count()
    out = written(df)
    assert out.count() == 7 and df.count() == 7 and spark.conf.get(key, None) == before
    written(df)
    assert tracker.shuffleStatuses().size() <= held + 4  # those of the two counts
