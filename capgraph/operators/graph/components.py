"""Connected components (G11, G12): union-find contraction inside each
partition, and alternating large-star / small-star rounds between them (Kiveris
et al., "Connected Components in MapReduce and Beyond", SoCC 2014).

*Contraction.*  A task merges the edges it reads with union-find and sends a
star for each component that it sees, so never more edges than vertices less
one, whatever its edges; edges may repeat and need no order, so none is made
canonical first.  The edges are written once and dealt to tasks as they come:
graphs of at most ``FINISH_EDGES`` whole, several to a task, which settles
them; the edges of a larger one by their greater ends, and the stars of these
by theirs.  What moves is compressed arrays of ends, a few for each task and
target, no row for an edge (``dealt``).

*Rounds*, for graphs whose stars don't fit a task then, grow with log(n), not with
the graph's diameter: two aggregations keyed by vertex (partial ``min``
map-side) plus a join back, and a contraction.
The root of a giant component is a hub of that join in the large-star step: its
rows are salted (``skew``).  Small-star has no hub, as each vertex keeps few
smaller neighbours.  The edge set is checkpointed to the reliable folder every
round and the former round's files are deleted; the loop stops when each
vertex has one edge, to one that has none to a lesser (``settled``), and raises
if that isn't so after ``max_rounds``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import Rounds, send_package, written
from .edges import G
from .prepared import Graph, graph
from .skew import find_hubs, hub_join

#: A graph of so many edges or fewer is finished by one task (24 bytes each).
FINISH_EDGES = 1_000_000
#: Edges of a larger graph that a task gets, about.
SHARD_EDGES = 2_000_000
#: A contracting task merges so many edges at a time.
MERGE_EDGES = 2_000_000


def least_of_component(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the least one it is joined with by the edges
    (a, b): roots are hooked to lesser roots and paths halved until no edge
    joins two roots."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``ids`` ascending and the place of each; without a sort
    where they lie close together."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    low, high = int(ids.min()), int(ids.max())
    if high - low >= 8 * len(ids) + (1 << 16):
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[ids - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[ids - low]


def _stars(table: pa.Table, kept: str = "") -> pa.Table:
    """The edges of ``table`` as a star for each component: (vertex, its least).
    ``kept``: "alone" also gives (vertex, itself) for vertices that have loops
    only, "all" for each least; both give (null, null) for ends without an id."""
    name = table.column(G).combine_chunks()
    name = name if pa.types.is_dictionary(name.type) else name.dictionary_encode()
    code = np.asarray(name.indices.fill_null(len(name.dictionary)), np.int64)
    src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
    none = np.zeros(0, np.int64)
    if src.null_count or dst.null_count:
        valid = np.asarray(src.is_valid()) & np.asarray(dst.is_valid())
        none = np.unique(code[~valid])  # graphs with a vertex that has no id
        code, src, dst = code[valid], src.filter(pa.array(valid)), dst.filter(pa.array(valid))
    ids, at = places(np.concatenate([np.asarray(x, np.int64) for x in (src, dst)]))
    n = max(1, len(ids))
    own, at = places(np.tile(code, 2) * n + at)  # by graph, then id
    label = least_of_component(len(own), at[:len(code)], at[len(code):])
    sent = label != np.arange(len(own))
    if kept == "all":
        sent[:] = True
    elif kept:
        alone = np.ones(len(own), bool)
        alone[label[sent]] = False
        sent |= alone
    moved = np.flatnonzero(sent)
    if not kept:
        none = none[:0]
    names = pa.concat_arrays([name.dictionary, pa.nulls(1, name.dictionary.type)])
    ends = [pa.concat_arrays([pa.array(ids[own[x] % n], pa.int64()), pa.nulls(len(none), pa.int64())]) for x in (moved, label[moved])]
    return pa.table({G: names.take(pa.array(np.concatenate([own[moved] // n, none]))), "src": ends[0], "dst": ends[1]})


def _contract(tables, kept: str = ""):
    """The batches of stars of all edges in ``tables``, merged ``MERGE_EDGES`` at a time."""
    held, n = [], 0
    # what waits for more edges keeps its loops, as they may be all that there is of a vertex
    waiting = "alone" if kept else ""
    for t in tables:
        if t.num_rows:
            held.append(t)
            n += t.num_rows
        if n >= MERGE_EDGES:
            held = [_stars(pa.concat_tables(held), waiting)]
            n = min(held[0].num_rows, MERGE_EDGES // 2)  # room for as many new ones
    if held:
        yield from _stars(pa.concat_tables(held), kept).to_batches()


def _bigint(e: DataFrame) -> DataFrame:
    return e.select(G, F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def contracted(e: DataFrame) -> DataFrame:
    """``e`` with each task's edges replaced by a spanning forest of stars."""
    e = _bigint(e)

    def run(batches):
        # by columns: a batch's schema may call them not null, that of stars doesn't
        yield from _contract(pa.table({c: b.column(c) for c in (G, "src", "dst")}) for b in batches)

    return e.mapInArrow(run, e.schema)


def _packed(table: pa.Table):
    """(bucket, edges) of ``table`` (bucket, graph_name, src, dst): the edges of
    a bucket as one compressed Arrow stream."""
    bucket = np.asarray(table.column("bucket"), np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    name = table.column(G).combine_chunks().dictionary_encode()
    code = np.asarray(name.indices.fill_null(len(name.dictionary)), np.int32)[order]
    names = pa.concat_arrays([name.dictionary, pa.nulls(1, name.dictionary.type)])
    src, dst = (table.column(c).combine_chunks().take(pa.array(order)) for c in ("src", "dst"))
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
    packs = []
    for a, b in zip(cuts, cuts[1:]):
        used, at = np.unique(code[a:b], return_inverse=True)
        of = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), names.take(pa.array(used)))
        batch = pa.RecordBatch.from_arrays([of, src[a:b], dst[a:b]], [G, "src", "dst"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_batch(batch)
        packs.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "edges"])


#: Edges that a task packs at a time.
PACKED_EDGES = 1_000_000


def dealt(e: DataFrame, bucket, buckets: int, kept: str = "alone") -> DataFrame:
    """``e`` contracted in ``buckets`` tasks, of the edges with each value of the
    column ``bucket``; ``kept`` as for ``_stars``."""
    e = e.select(bucket.cast("int").alias("bucket"), G, *[F.col(c).cast("bigint").alias(c) for c in ("src", "dst")])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACKED_EDGES:
                yield _packed(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield _packed(pa.Table.from_batches(held))

    def run(batches):
        def tables():
            for b in batches:
                for x in b.column("edges"):
                    t = pa.ipc.open_stream(x.as_py()).read_all()
                    yield t.set_column(0, G, t.column(0).cast(pa.string()))

        yield from _contract(tables(), kept)

    send_package(e.sparkSession)
    return (e.mapInArrow(pack, "bucket int, edges binary").repartitionById(buckets, F.col("bucket"))
            .select("edges").mapInArrow(run, f"{G} string, src bigint, dst bigint"))


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(G, F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(e: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """For each u: m = min(N(u) + u); link every larger neighbour v > u to m."""
    both = _both_ways(e)
    m = both.groupBy(G, "src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    # No distinct here: the small-star step groups by vertex and ends with one.
    return (hub_join(both.filter(F.col("dst") > F.col("src")), m, hubs, "src", ["dst"])
            .select(G, F.col("dst").alias("src"), F.col("m").alias("dst")))


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point high -> low.  For each u: m = min(smaller neighbours + u);
    link u and each smaller neighbour v to m (dropping v = m)."""
    lo = e.select(G, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    m = lo.groupBy(G, "src").agg(F.min("dst").alias("m"))
    j = lo.join(m, [G, "src"])
    linked = j.select(G, F.col("dst").alias("src"), F.col("m").alias("dst"))
    own = m.select(G, "src", F.col("m").alias("dst"))
    return (linked.unionByName(own).filter(F.col("src") != F.col("dst")).distinct())


def settled(e: DataFrame) -> bool:
    """Whether each vertex of the edges ``e`` (src > dst) has one edge to a lesser
    vertex, or none where it is another's lesser one."""
    ends = e.select(G, F.col("src").alias("vertex"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(G, F.col("dst").alias("vertex"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by_vertex = ends.groupBy(G, "vertex").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_vertex.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _whole(e: DataFrame, n: int) -> DataFrame:
    """(graph_name, src, dst) with dst the least that is joined with src, for each
    vertex of the ``n`` edges ``e``; a graph goes to one task."""
    buckets = max(1, -(-n // FINISH_EDGES))
    return written(dealt(e, F.pmod(F.xxhash64(G), F.lit(buckets)), buckets, "all"))


def _of_larger(e: DataFrame, larger: DataFrame, how: str) -> DataFrame:
    return e.join(F.broadcast(larger), e[G].eqNullSafe(larger["_g"]), how)


def _larger(e: DataFrame, limit: int) -> DataFrame | None:
    """(_g, n, shards, first) of the graphs with ``n`` > ``limit`` edges, of which
    there are at most edges / limit, or None; shards are numbered through."""
    found = e.groupBy(G).count().where(F.col("count") > limit).collect()
    if not found:
        return None
    rows, first = [], 0
    for r in sorted(found, key=lambda r: (r[0] is not None, r[0])):
        shards = -(-r["count"] // SHARD_EDGES)
        rows.append((r[0], r["count"], shards, first))
        first += shards
    return e.sparkSession.createDataFrame(rows, "_g string, n bigint, shards int, first int")


def _dealt_by_end(e: DataFrame, larger: DataFrame) -> DataFrame:
    """``e`` of the graphs ``larger`` contracted, all edges with the same ``src`` in one task."""
    buckets = larger.agg(F.max(F.col("first") + F.col("shards"))).first()[0]
    of = _of_larger(e, larger, "inner")
    return dealt(of, F.col("first") + F.pmod(F.xxhash64("src"), F.col("shards")), buckets)


def connected_components(edges: DataFrame | Graph, verts: DataFrame | None = None,
                         max_rounds: int = 100, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """``(graph_name, vertex, component)``, component = smallest vertex
    id in the component; isolated vertices are their own component.  Raises
    ``RuntimeError`` if ``max_rounds`` rounds don't settle the components."""
    g = graph(edges, verts)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    kind = g.edges.select(low.alias("v")).schema["v"].dataType
    e = g.canon if isinstance(edges, Graph) else g.edges
    e = _bigint(e.select(G, high.alias("src"), low.alias("dst")))
    if not isinstance(edges, Graph):
        e = written(e)  # repeats and all
    rounds = Rounds(g.edges.sparkSession)
    done, larger, in_rounds = [], _larger(e, finish_edges), False
    small = e if larger is None else _of_larger(e, larger, "left_anti")
    n = small.count()
    if n or larger is None:
        done.append(_whole(small, n))
    if larger is not None:
        e = _of_larger(e, larger, "left_semi")
        if larger.where("shards > 1").isEmpty():
            e = written(e)
        else:
            e = written(_dealt_by_end(_dealt_by_end(e, larger), larger))
            larger = _larger(e, finish_edges)
            small = e if larger is None else _of_larger(e, larger, "left_anti")
            n = small.count()
            if n:
                done.append(_whole(small, n))
            e = None if larger is None else _of_larger(e, larger, "left_semi")
        if in_rounds := e is not None:
            done += [e.filter(F.col("src").eqNullSafe(F.col("dst"))), *_rounds(e.filter(F.col("src") != F.col("dst")), rounds, max_rounds)]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    parent = found.select(G, F.col("src").alias("vertex"), F.col("dst").alias("p"))
    if in_rounds:  # its vertices: by loops, by their star, as the least of one
        parent = parent.groupBy(G, "vertex").agg(F.min("p").alias("p"))
    if g.own_vertices:
        out = parent.select(G, F.col("vertex").cast(kind).alias("vertex"), F.col("p").alias("component"))
    else:
        v, p = g.vertices, parent.select(F.col(G).alias("_g"), F.col("vertex").alias("_v"), "p")
        out = (v.join(p, v[G].eqNullSafe(p["_g"]) & (v["vertex"] == p["_v"]), "left")
               .select(G, "vertex", F.coalesce("p", "vertex").alias("component")))
    if in_rounds or not g.own_vertices:
        out = written(out)
    rounds.clear()
    return out


def _rounds(e: DataFrame, rounds: Rounds, max_rounds: int) -> list[DataFrame]:
    """The settled stars of ``e``, and (least, least) of each."""
    # rounds join by name, which a missing one must not get lost in
    e = e.withColumn(G, F.coalesce(F.concat(F.lit("="), G), F.lit("")))
    name = F.when(F.col(G) != "", F.expr(f"substring({G}, 2)")).alias(G)
    for _ in range(max_rounds):
        if settled(e):
            return [e.select(name, "src", "dst"), e.select(G, "dst").distinct().select(name, F.col("dst").alias("src"), "dst")]
        hubs = find_hubs(_both_ways(e).select(G, F.col("src").alias("vertex")), e.count())
        e = rounds.write(contracted(_small_star(_large_star(e, hubs))))
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def component_summary(comps: DataFrame) -> DataFrame:
    """Per graph the number of components and ``is_connected``."""
    return (comps.groupBy(G).agg(F.count_distinct("component").alias("num_components"))
            .withColumn("is_connected", F.col("num_components") == 1))


def component_sizes(comps: DataFrame) -> DataFrame:
    """``(graph_name, component, size)``."""
    return comps.groupBy(G, "component").agg(F.count(F.lit(1)).alias("size"))
