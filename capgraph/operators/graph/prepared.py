"""One prepared graph for several operators.

``Graph`` holds what the operators need of an edge frame, each part written
once when first asked for: canonical edges, vertices, degrees, oriented edges.
Every graph operator takes an edge frame or a ``Graph``; given a frame it
prepares its own, so the frame's plan runs once either way.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import written
from .edges import G, canonical_edges, degree, vertices
from .skew import hubs_of

#: Edges of a task that lists out-neighbours, about.
LIST_EDGES = 250_000
#: A vertex of fewer edge ends is ordered by its id alone; and so many are ordered
#: by degree at most, so no edge is joined with a degree by a shuffle.
LIGHT, MOST_HEAVY = 256, 250_000


def vertices_of_ends(edges: DataFrame) -> DataFrame:
    """One row ``(graph_name, vertex)`` for each edge end."""
    return edges.select(G, F.explode(F.array("src", "dst")).alias("vertex"))


def oriented_edges(canon: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """Canonical edges without loops, oriented low -> high by (degree, id), with
    the degree of the high end; the degree counts as 0 but for the vertices
    ``heavy`` (graph_name, vertex, degree), which are few enough to broadcast."""
    canon = canon.filter((F.col("src") != F.col("dst")) & F.col(G).isNotNull())
    if heavy is None:
        return canon.select(G, F.col("src").alias("lo"), F.col("dst").alias("hi"), F.lit(0).cast("bigint").alias("hi_degree"))
    for end, degree_ in (("src", "ds"), ("dst", "dd")):
        of = heavy.select(G, F.col("vertex").alias(end), F.col("degree").alias(degree_))
        canon = canon.join(F.broadcast(of), [G, end], "left").fillna(0, [degree_])
    src_low = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return canon.select(G,
                        F.when(src_low, F.col("src")).otherwise(F.col("dst")).alias("lo"),
                        F.when(src_low, F.col("dst")).otherwise(F.col("src")).alias("hi"),
                        F.greatest("ds", "dd").alias("hi_degree"))


class Graph:
    """``edges`` (graph_name, src, dst), in any direction and with repeats."""

    def __init__(self, edges: DataFrame, verts: DataFrame | None = None):
        self.edges, self._verts = edges, verts
        #: What ``triangles.split`` made of it.
        self.parts: dict = {}

    @classmethod
    def of_canonical(cls, canon: DataFrame, verts: DataFrame | None = None) -> Graph:
        """A graph of edges that are canonical already."""
        out = cls(canon, verts)
        out.canon = canon
        return out

    @property
    def own_vertices(self) -> bool:
        """Whether the vertices are the edges' ends."""
        return self._verts is None

    def without(self, names: DataFrame) -> Graph:
        """All graphs but those in ``names``; parts of graphs that were split are kept."""
        left = lambda frame: None if frame is None else frame.join(names, G, "left_anti")
        out = Graph.of_canonical(left(self.canon), left(self._verts))
        for limit, (counted, rest) in self.parts.items():
            out.parts[limit] = (left(counted), None if rest is None else out if rest is self else rest.without(names))
        return out

    @cached_property
    def canon(self) -> DataFrame:
        """G2."""
        return written(canonical_edges(self.edges))

    @cached_property
    def simple(self) -> DataFrame:
        """G2 without loops."""
        return self.canon.filter(F.col("src") != F.col("dst"))

    @cached_property
    def n_edges(self) -> int:
        return self.canon.count()

    @cached_property
    def vertices(self) -> DataFrame:
        """G1, or the vertices that were given."""
        return written(vertices(self.canon) if self._verts is None else self._verts.select(G, "vertex"))

    @cached_property
    def names(self) -> DataFrame:
        """The graphs' names."""
        return written(self.canon.select(G).distinct())

    @cached_property
    def simple_degree(self) -> DataFrame:
        """G3 without loops."""
        return written(degree(self.canon, loops=False))

    @cached_property
    def hubs(self) -> DataFrame | None:
        return hubs_of(self.simple_degree, "degree", self.n_edges)

    @cached_property
    def heavy(self) -> DataFrame | None:
        """(graph_name, vertex, degree) of the vertices that are ordered by degree, or None."""
        found = self.simple_degree.where(F.col("degree") > max(LIGHT, 2 * self.n_edges // MOST_HEAVY))
        found = written(found.where(F.col(G).isNotNull()))
        return None if found.isEmpty() else found

    @cached_property
    def oriented(self) -> DataFrame:
        """(graph_name, lo, hi, hi_degree)."""
        return oriented_edges(self.canon, self.heavy)

    @cached_property
    def list_tasks(self) -> int:
        """Tasks that lists of out-neighbours are dealt to."""
        return max(1, -(-self.n_edges // LIST_EDGES))

    @cached_property
    def out_lists(self) -> DataFrame:
        """(graph_name, lo, outs): the out-neighbours of each vertex that has
        any, in the order that edges are oriented by; at most ``LIGHT``, sqrt(2m) or
        2m / ``MOST_HEAVY`` each."""
        if self.heavy is None:
            by_vertex = self.oriented.select(G, "lo", "hi").repartition(self.list_tasks, G, "lo").groupBy(G, "lo")
            return written(by_vertex.agg(F.sort_array(F.collect_list("hi")).alias("outs")))
        by_vertex = self.oriented.repartition(self.list_tasks, G, "lo").groupBy(G, "lo")
        ranked = by_vertex.agg(F.sort_array(F.collect_list(F.struct("hi_degree", "hi"))).alias("ranked"))
        return written(ranked.select(G, "lo", F.col("ranked.hi").alias("outs")))


def graph(edges: DataFrame | Graph, verts: DataFrame | None = None) -> Graph:
    if isinstance(edges, Graph):
        return edges if verts is None else Graph.of_canonical(edges.canon, verts)
    return Graph(edges, verts)
