"""Triangle counting and clustering.

Small graphs, of at most ``TRIPLE_EDGES`` edges, go whole: several to a task, which
gets their canonical edges in one shuffle and counts each vertex's degree and
triangles (``split``).  What follows is for larger ones.

Exact counting orients every edge from the lower to the higher
``(degree, id)`` end, degrees up to a bound (``prepared.LIGHT``) counting alike, so a
vertex has at most that bound or ``sqrt(2m)`` out-neighbours (a hub's edges point
*into* it).  What closes a graph's triangles is chosen by the
number of its wedges, pairs of out-neighbours:

*Lists.*  Each edge (a, b) sends b those out-neighbours of a that come after b,
as one array; they are intersected with the out-neighbours of b.  What moves is
the wedges, at 8 bytes each: a few for each edge in sparse graphs, however
large, so it grows with the edges.  Hubs are salted (``skew``).  Where it is much, it
moves in passes over the a's, each summed and written, its shuffle files gone before
the next one's.

*Colours*, where there are more than ``WEDGES`` wedges for each edge and
colour.  Vertices are dealt to ``C`` colours by a hash, ``C`` by the graph's edges.
There is a task for each triple of colours; it gets the edges between its
colours, once, as plain pairs, and counts the triangles whose colours are just
these: each triangle is found in one task.  An edge goes to C of the C^3 / 6
triples, so a triple holds 6m / C^2 edges, about ``TRIPLE_EDGES``.  In a task the
oriented edges lie in sorted arrays; every two out-neighbours b, c of a vertex
are looked up as an edge.  A triple that got more (a hub's colour, say) is split
again: into S x S tasks by hashes of a and of b, each with the out-lists of its
a's and the edges of its b's, which is 2 / S of the triple.  Small graphs share
tasks.

Both take ``O(m^1.5)`` work at most.

Sampling (G15, G17) happens only where a threshold is given.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import send_package, written
from .edges import G, first_k_vertices, induced_subgraph
from .prepared import Graph, graph, oriented_edges, vertices_of_ends  # noqa: F401  (part of this module's surface)
from .skew import copied, salted

#: Edges of a task, about; and pairs of out-neighbours looked up at a time.
TRIPLE_EDGES = 250_000
LOOKUPS = 4_000_000
#: Wedges for each edge and colour up to which lists move less than colours: a
#: wedge takes 8 bytes, an edge's row in a triple over 100.
WEDGES = 16

#: What tells tasks apart: a bucket of small graphs, or a graph's triple of colours and its part.
TASK = ["bucket", "own", "x", "y", "z", "p", "q"]


#: Bytes of lists, before compression, that are moved at a time: so many, or so
#: many for each edge.
PASS_BYTES, PASS_EDGE = 1 << 30, 24


def _dense(g: Graph, triple_edges: int, wedges: int) -> tuple[DataFrame, int]:
    """(graph_name, m, colours) of the graphs with more than ``wedges`` wedges
    for each edge and colour; and the wedges of the others."""
    n = F.size("outs").cast("bigint")
    sizes = g.out_lists.groupBy(G).agg(F.sum(n).alias("m"), F.sum(n * (n - 1) / 2).alias("w"))
    few = F.col("m") <= triple_edges
    colours = F.when(few, 1).otherwise(F.ceil(F.sqrt(6.0 * F.col("m") / triple_edges))).cast("int")
    sizes = written(sizes.withColumn("colours", colours))
    many = F.col("w") > F.lit(wedges) * F.col("m") * F.col("colours")
    return sizes.where(many).select(G, "m", "colours"), int(sizes.where(~many).agg(F.sum("w")).first()[0] or 0)


def _closed(g: Graph, lists: DataFrame, passes: int = 1, number: int = 0) -> DataFrame:
    """(graph_name, a, b, cs): for each oriented edge (a, b) in triangles, their
    third vertices, from ``lists`` of out-neighbours; of one of ``passes``, by a."""
    every, lists = lists, lists if passes == 1 else lists.where(F.pmod(F.xxhash64("lo", F.lit(1)), F.lit(passes)) == number)
    after = F.expr("slice(outs, i + 2, size(outs))")
    sent = (lists.select(G, F.col("lo").alias("a"), F.posexplode("outs").alias("i", "b"), "outs")
            .where(F.col("i") + 1 < F.size("outs")).select(G, "a", "b", after.alias("rest")))
    own, keys = every.withColumnRenamed("lo", "b"), [G, "b"]
    if g.hubs is not None:
        sent, own, keys = salted(sent, g.hubs, "b", ["a"]), copied(own, g.hubs, "b"), [*keys, "_salt"]
    sent, own = (x.repartition(g.list_tasks, *keys) for x in (sent, own))
    return (sent.join(own.hint("shuffle_hash"), keys).select(G, "a", "b", F.array_intersect("rest", "outs").alias("cs"))
            .where(F.size("cs") > 0))


def _dealt(g: Graph, sizes: DataFrame, triple_edges: int) -> DataFrame:
    """Oriented edges of the graphs in ``sizes`` by ``TASK``, with the colours i, j
    of their ends; side 0: to list out-neighbours of, 1: to look up, 2: both."""
    few = F.col("m") <= triple_edges
    shared = max(1, -(-(sizes.where(few).agg(F.sum("m")).first()[0] or 0) // triple_edges))
    edge = [G, "lo", "hi", "i", "j", "side"]
    joined = g.oriented.join(sizes.select(F.col(G).alias("_g"), "colours"), F.col(G).eqNullSafe(F.col("_g"))).drop("_g")
    none = [F.lit(0).alias(c) for c in TASK[2:]]
    # whole graphs, several to a task
    alone = joined.where("colours = 1").select(
        F.pmod(F.xxhash64(G), F.lit(shared)).cast("int").alias("bucket"), F.lit(None).cast("string").alias("own"), *none,
        G, "lo", "hi", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    if sizes.where("colours > 1").isEmpty():
        return alone
    colour = lambda v: F.pmod(F.xxhash64(v), F.col("colours")).cast("int")
    coloured = (joined.where("colours > 1").withColumns({"i": colour("lo"), "j": colour("hi")})
                .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("colours") - 1)))
                .withColumn("t", F.array_sort(F.array("i", "j", "k"))))
    triples = coloured.select(F.lit(-1).alias("bucket"), F.col(G).alias("own"), *[F.col("t")[n].alias(c) for n, c in enumerate("xyz")],
                              G, "lo", "hi", "i", "j")
    of = ["own", "x", "y", "z"]
    # triples with more than twice their share are split by s; at most 6 * edges / triple_edges of them
    full = written(triples.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * triple_edges)
                   .withColumn("s", F.ceil(F.col("n") / triple_edges).cast("int")).drop("n"))
    if full.isEmpty():
        return alone.unionByName(triples.select("bucket", *of, F.lit(0).alias("p"), F.lit(0).alias("q"), G, "lo", "hi", "i", "j",
                                                F.lit(2).alias("side")))
    s = F.coalesce("s", F.lit(1))
    part, every = F.pmod(F.xxhash64("lo", F.lit(1)), s).cast("int"), F.sequence(F.lit(0), s - 1)
    # an edge is listed in the tasks (its part, any) and looked up in (any, its part)
    to = F.concat(F.transform(every, lambda q: F.struct(part.alias("p"), q.alias("q"), F.lit(0).alias("side"))),
                  F.transform(every, lambda p: F.struct(p.alias("p"), part.alias("q"), F.lit(1).alias("side"))))
    split = triples.join(full, of, "left").withColumn("to", F.explode(to))
    return alone.unionByName(split.select("bucket", *of, "to.p", "to.q", G, "lo", "hi", "i", "j", "to.side").select(*TASK, *edge))


def found_triangles(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: np.ndarray, lookups: int = LOOKUPS):
    """Triangles among a task's edges, some at a time: positions of the edges
    (a, b) and (a, c), with (b, c) an edge to look up.  ``code``: of the graph."""
    ids, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    n = max(1, len(ids))
    a, b = code * n + at[:len(lo)], code * n + at[len(lo):]
    space, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(lo)], at[len(lo):]
    n = max(1, len(space))
    known = np.unique((a * n + b)[side != 0])
    lists = np.flatnonzero(side != 1)
    order = lists[np.lexsort((b[lists], a[lists]))]
    once = np.ones(len(order), bool)
    once[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    order = order[once]  # an edge may come to a task by both its sides
    first = np.searchsorted(a[order], a[order], side="left")
    size = np.searchsorted(a[order], a[order], side="right") - first  # of the list that an edge is in
    start = 0
    ends = np.cumsum(size)
    while start < len(order):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + lookups, side="right")))
        one = np.repeat(np.arange(start, stop), size[start:stop])
        other = np.arange(len(one)) - np.repeat(np.cumsum(size[start:stop]) - size[start:stop], size[start:stop]) + first[one]
        key = b[order[one]] * n + b[order[other]]
        place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = known[place] == key if len(known) else np.zeros(len(key), bool)
        yield order[one[hit]], order[other[hit]]
        start = stop


def _each(g: Graph, result: str, listed, make, triple_edges: int, wedges: int, keys: list[str] | None = None) -> DataFrame:
    """A frame of ``result`` from all triangles: ``listed(closed)`` of those that
    lists close, ``make(names, code, a, b, c)`` of each task's by colours.  ``keys``:
    the caller sums n by them, so lists may be moved in passes, each summed and written."""
    dense, w = _dense(g, triple_edges, wedges)
    passes = max(1, -(-8 * w // max(PASS_BYTES, PASS_EDGE * g.n_edges))) if keys else 1

    def by_lists(lists: DataFrame) -> DataFrame:
        if passes == 1:
            return listed(_closed(g, lists))
        sums = [written(listed(_closed(g, lists, passes, p)).groupBy(*keys).agg(F.sum("n").alias("n"))) for p in range(passes)]
        return reduce(DataFrame.unionByName, sums)

    if dense.isEmpty():
        return by_lists(g.out_lists)
    send_package(g.edges.sparkSession)
    lists = g.out_lists.join(dense.select(G), G, "left_anti")

    def run(key, table):
        name = table.column(G).combine_chunks().dictionary_encode()
        code = np.asarray(name.indices.fill_null(len(name.dictionary)), np.int64)
        names = pa.concat_arrays([name.dictionary, pa.nulls(1, name.dictionary.type)])
        lo, hi, i, j, side = (np.asarray(table.column(c), np.int64) for c in ("lo", "hi", "i", "j", "side"))
        want = [k.as_py() for k in key[2:5]]
        parts = [[np.zeros(0, np.int64)] * 4]
        for p, q in found_triangles(code, lo, hi, side):
            # a triangle of fewer colours is also seen by other triples; this one counts its own
            own = (np.sort(np.stack([i[p], j[p], j[q]]), axis=0) == np.array(want)[:, None]).all(axis=0)
            parts.append([code[p[own]], lo[p[own]], hi[p[own]], hi[q[own]]])
        return make(names, *(np.concatenate(c) for c in zip(*parts)))

    return by_lists(lists).unionByName(_dealt(g, dense, triple_edges).groupBy(*TASK).applyInArrow(run, result))


def triangles(edges: DataFrame | Graph, triple_edges: int = TRIPLE_EDGES, wedges: int = WEDGES) -> DataFrame:
    """All triangles once each: ``(graph_name, a, b, c)`` (vertex ids, not sorted)."""
    def make(names, code, a, b, c):
        return pa.table({G: names.take(pa.array(code)), "a": pa.array(a), "b": pa.array(b), "c": pa.array(c)})

    return _each(graph(edges), f"{G} string, a bigint, b bigint, c bigint",
                 lambda closed: closed.select(G, "a", "b", F.explode("cs").alias("c")), make, triple_edges, wedges)


def split(g: Graph, limit: int = TRIPLE_EDGES) -> tuple[DataFrame | None, Graph | None]:
    """The graphs of at most ``limit`` edges as (graph_name, vertex, degree,
    triangles), written, for each end of their edges, degrees without loops;
    and a ``Graph`` of the others.  None where there are none."""
    if limit not in g.parts:
        g.parts[limit] = _split(g, limit)
    return g.parts[limit]


def _split(g: Graph, limit: int) -> tuple[DataFrame | None, Graph | None]:
    buckets = max(1, -(-g.n_edges // limit))
    canon = g.canon.withColumn("bucket", F.pmod(F.xxhash64(G), F.lit(buckets)).cast("int"))
    # a graph of more than its share shows in its bucket; at most half of the buckets
    full = [r.bucket for r in canon.groupBy("bucket").count().where(F.col("count") > 2 * limit).collect()]
    rest = None
    if full:
        # at most edges / limit
        large = written(canon.where(F.col("bucket").isin(full)).groupBy(G).count().where(F.col("count") > limit)
                        .select(F.col(G).alias("_g")))
        if not large.isEmpty():
            is_large = F.col(G).eqNullSafe(F.col("_g"))
            canon = canon.join(F.broadcast(large), is_large, "left_anti")
            if canon.isEmpty():
                return None, g
            rest = Graph.of_canonical(g.canon.join(F.broadcast(large), is_large, "left_semi"))
    send_package(g.edges.sparkSession)
    dealt = canon.repartition(buckets, "bucket").groupBy("bucket")
    return written(dealt.applyInArrow(counted_whole, f"{G} string, vertex bigint, degree bigint, triangles bigint")), rest


def counted_whole(table: pa.Table) -> pa.Table:
    """Degree and triangles of each end of the canonical edges of whole graphs.
    Graphs without a name have no triangles, as names are joined by."""
    name = table.column(G).combine_chunks().dictionary_encode()
    nameless = len(name.dictionary)
    code = np.asarray(name.indices.fill_null(nameless), np.int64)
    names = pa.concat_arrays([name.dictionary, pa.nulls(1, name.dictionary.type)])
    src, dst = table.column("src").combine_chunks(), table.column("dst").combine_chunks()
    valid = np.asarray(src.is_valid()) & np.asarray(dst.is_valid())
    none = np.unique(code[~valid])  # graphs with a vertex that has no id
    code, src, dst = code[valid], *(np.asarray(x.fill_null(0), np.int64)[valid] for x in (src, dst))
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = max(1, len(ids))
    keys, at = np.unique(np.tile(code, 2) * n + at, return_inverse=True)
    a, b = at[:len(src)], at[len(src):]
    edge = a != b
    code, a, b = code[edge], a[edge], b[edge]
    degree = np.bincount(np.concatenate([a, b]), minlength=len(keys))
    low = (degree[a] < degree[b]) | ((degree[a] == degree[b]) & (a < b))
    named = code != nameless
    lo, hi = np.where(low, a, b)[named], np.where(low, b, a)[named]
    triangles_ = np.zeros(len(keys), np.int64)
    for p, q in found_triangles(np.zeros(len(lo), np.int64), lo, hi, np.full(len(lo), 2)):
        triangles_ += np.bincount(np.concatenate([lo[p], hi[p], hi[q]]), minlength=len(keys))
    zeros = np.zeros(len(none), np.int64)
    return pa.table({
        G: names.take(pa.array(np.concatenate([keys // n, none]))),
        "vertex": pa.concat_arrays([pa.array(ids[keys % n], pa.int64()), pa.nulls(len(none), pa.int64())]),
        "degree": pa.array(np.concatenate([degree, zeros]).astype(np.int64)),
        "triangles": pa.array(np.concatenate([triangles_, zeros]))})


def _union(frames: list[DataFrame | None]) -> DataFrame:
    found = [f for f in frames if f is not None]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def triangle_count(edges: DataFrame | Graph, graphs: DataFrame | None = None, triple_edges: int = TRIPLE_EDGES,
                   wedges: int = WEDGES) -> DataFrame:
    """``(graph_name, triangles)``; 0 for graphs without triangles, of
    ``graphs`` (any frame with ``graph_name``) or else of the edges."""
    def make(names, code, a, b, c):
        which, n = np.unique(code, return_counts=True)
        return pa.table({G: names.take(pa.array(which)), "n": pa.array(n, pa.int64())})

    g = graph(edges)
    counted, rest = split(g, triple_edges)
    t = [None, None]
    if counted is not None:
        t[0] = counted.groupBy(G).agg(F.expr("sum(triangles) div 3").alias("triangles"))
    if rest is not None:
        t[1] = _each(rest, f"{G} string, n bigint", lambda closed: closed.select(G, F.size("cs").cast("bigint").alias("n")),
                     make, triple_edges, wedges, [G]).groupBy(G).agg(F.sum("n").alias("triangles"))
    if graphs is not None:
        return _zero_filled(graphs.select(G).distinct(), _union(t), [G])
    return _union([t[0], None if rest is None else _zero_filled(rest.names, t[1], [G])])


def triangles_per_vertex(edges: DataFrame | Graph, verts: DataFrame | None = None, triple_edges: int = TRIPLE_EDGES,
                         wedges: int = WEDGES) -> DataFrame:
    """``(graph_name, vertex, triangles)``, 0 for vertices in none."""
    def listed(closed):
        n = F.size("cs").cast("bigint")
        each = F.concat(F.array(F.struct(F.col("a").alias("vertex"), n.alias("n")), F.struct(F.col("b").alias("vertex"), n.alias("n"))),
                        F.transform("cs", lambda c: F.struct(c.alias("vertex"), F.lit(1).cast("bigint").alias("n"))))
        return closed.select(G, F.explode(each).alias("x")).select(G, "x.vertex", "x.n")

    def make(names, code, a, b, c):
        ids, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        which, n = np.unique(np.tile(code, 3) * max(1, len(ids)) + at, return_counts=True)
        return pa.table({G: names.take(pa.array(which // max(1, len(ids)))), "vertex": pa.array(ids[which % max(1, len(ids))], pa.int64()),
                         "n": pa.array(n, pa.int64())})

    g = graph(edges, verts)
    counted, rest = split(g, triple_edges)
    t = [None if counted is None else counted.select(G, "vertex", "triangles"), None]
    if rest is not None:
        t[1] = (_each(rest, f"{G} string, vertex bigint, n bigint", listed, make, triple_edges, wedges, [G, "vertex"])
                .groupBy(G, "vertex").agg(F.sum("n").alias("triangles")))
    if not g.own_vertices:
        return _zero_filled(g.vertices, _union(t), [G, "vertex"])
    return _union([t[0], None if rest is None else _zero_filled(rest.vertices, t[1], [G, "vertex"])])


def _zero_filled(of: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``of`` with the counts, 0 where there is none; null names are names."""
    c = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "triangles")
    same = F.lit(True)
    for k in keys:
        same = same & of[k].eqNullSafe(c[f"_{k}"])
    return of.join(c, same, "left").select(*keys, F.coalesce("triangles", F.lit(0)).cast("bigint").alias("triangles"))


def local_clustering(edges: DataFrame | Graph, verts: DataFrame | None = None) -> DataFrame:
    """G16 per vertex: ``2T / (k (k-1))`` with k the degree without loops;
    0 for k < 2."""
    g = graph(edges, verts)
    counted, rest = split(g)
    degree_ = F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")
    if g.own_vertices:
        t = [counted, None if rest is None else _with_degree(triangles_per_vertex(rest), rest.simple_degree).select(G, "vertex", degree_, "triangles")]
    else:
        k = [None if counted is None else counted.select(G, "vertex", "degree"), None if rest is None else rest.simple_degree]
        t = [_with_degree(triangles_per_vertex(g), _union(k)).select(G, "vertex", degree_, "triangles")]
    return (_union(t).select(G, "vertex", "degree", "triangles",
                             F.when(F.col("degree") >= 2, 2.0 * F.col("triangles") / (F.col("degree").cast("double") * (F.col("degree") - 1)))
                             .otherwise(F.lit(0.0)).alias("clustering")))


def _with_degree(t: DataFrame, degrees: DataFrame) -> DataFrame:
    k = degrees.select(F.col(G).alias("_g"), F.col("vertex").alias("_v"), "degree")
    return t.join(k, t[G].eqNullSafe(k["_g"]) & (t["vertex"] == k["_v"]), "left")


def average_clustering(edges: DataFrame | Graph, verts: DataFrame | None = None) -> DataFrame:
    """``(graph_name, avg_clustering)`` -- mean over all vertices."""
    return (local_clustering(edges, verts).groupBy(G)
            .agg(F.avg("clustering").alias("avg_clustering")))


def triangle_estimate(edges: DataFrame | Graph, threshold: int | None = None, sample_size: int = 10000,
                      exponent: float = 1.4, extrapolate: bool = True) -> DataFrame:
    """Exact counts; with a ``threshold``, graphs of more vertices are
    counted on the subgraph of their ``sample_size`` lowest ids, scaled by
    ``(n / k) ** exponent`` (truncated) unless ``extrapolate=False``.
    Returns ``(graph_name, nodes, sampled, triangles)``."""
    g = graph(edges)
    n = _nodes(g)
    if threshold is None:
        return (triangle_count(g, n).join(n, G)
                .select(G, "nodes", F.lit(False).alias("sampled"), "triangles"))
    sampled = F.col("nodes") > threshold
    small, sub = _sampled(g, n, sampled, sample_size)
    counts = triangle_count(small, n.where(~sampled)).withColumn("k", F.lit(None).cast("bigint"))
    if sub is not None:
        k = sub.vertices.groupBy(G).agg(F.count(F.lit(1)).alias("k"))
        counts = counts.unionByName(triangle_count(sub, n.where(sampled)).join(k, G))
    scaled = F.floor(F.col("triangles") * F.pow(F.col("nodes") / F.col("k"), F.lit(exponent))).cast("bigint")
    return counts.join(n, G).select(G, "nodes", sampled.alias("sampled"),
                                    F.when(sampled & F.lit(extrapolate), scaled).otherwise(F.col("triangles")).alias("triangles"))


def _vertices(g: Graph) -> DataFrame:
    if not g.own_vertices:
        return g.vertices
    counted, rest = split(g)
    return _union([None if counted is None else counted.select(G, "vertex"), None if rest is None else rest.vertices])


def _nodes(g: Graph) -> DataFrame:
    """(graph_name, nodes) of the graphs that have a name."""
    return written(_vertices(g).where(F.col(G).isNotNull()).groupBy(G).agg(F.count(F.lit(1)).alias("nodes")))


def _sampled(g: Graph, n: DataFrame, big, sample_size: int) -> tuple[Graph, Graph | None]:
    """The graphs that aren't ``big``, whole; and of those that are, the
    subgraph of their ``sample_size`` lowest vertices, with these."""
    names = written(n.where(big).select(G))
    if names.isEmpty():
        return g, None
    sv = written(first_k_vertices(_vertices(g).join(names, G, "left_semi"), sample_size))
    return g.without(names), Graph.of_canonical(written(induced_subgraph(g.canon.join(names, G, "left_semi"), sv)), sv)


def sampled_average_clustering(edges: DataFrame | Graph, threshold: int | None = None,
                               sample_size: int = 5000) -> DataFrame:
    """Average clustering; with a ``threshold``, graphs of at least that
    many vertices are measured on the subgraph of their ``sample_size`` lowest
    ids.  ``(graph_name, avg_clustering, sampled)``."""
    g = graph(edges)
    if threshold is None:
        return average_clustering(g).withColumn("sampled", F.lit(False))
    n = _nodes(g)
    big = F.col("nodes") >= threshold
    small, sub = _sampled(g, n, big, sample_size)
    means = _union([average_clustering(small), None if sub is None else average_clustering(sub)])
    return means.join(n, G).select(G, "avg_clustering", big.alias("sampled"))
