"""Similarity join on word n-grams: exact Jaccard behind Bayesian pruning.

1. Each text's set of ``SHINGLE``-word sequences is hashed; texts with equal
   sets are one *class* and compared once, however many copies it has.
2. MinHash values are cut into bands; classes that agree in a band are
   candidates.  A pair at the threshold 0.8 is missed with probability
   (1 - 0.8^8)^64, below 1e-5; above it far less.  Band and class meet in an
   aggregate (least and greatest class of a band's value), so neither a value
   held by a single class nor a hot value makes a large group.
3. Components of the candidate graph are clusters.  A cluster's classes are
   dealt to blocks and every pair of blocks is one task's work, whatever the
   cluster's size, so no cluster has to fit in one task.
4. In a pair of blocks MinHash values are compared a few at a time.  With m of
   n values equal, the posterior that the likeness reaches the threshold
   (uniform prior) is P(Binomial(n + 1, threshold) <= m); pairs for which it
   falls below ``TOLERANCE`` drop out.  The rest are verified exactly.
5. Tasks send counts of links and a spanning forest, not pairs.

Result: for every row its class (the least doc_id that it is connected to by
links) and its number of links: other rows, copies included, whose likeness
reaches the threshold.

Defined cases: null text is empty; texts without words are copies of one
another; a text of fewer than ``SHINGLE`` words has the sequence of all its
words; repeated rows are copies; null ids belong to classes but don't name
one unless all ids of a class are null; an empty table gives no rows.  Hashes
of sequences are 64-bit.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph.components import connected_components
from . import common
from .op8_substring_dedup import sequence_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 64, 8
TOLERANCE = 1e-7
STEP = 16
COMPARED = 128
BLOCK = 1024
#: Sets that are sent to pairs of blocks at a time; more where there are more sets.
PASS_SETS = 500_000
TILE = 512

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RANDOM = np.random.default_rng(10)
_FACTOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _MIX1
    h = (h ^ h >> np.uint64(27)) * _MIX2
    return h ^ h >> np.uint64(31)


def shingles(body: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word sequences."""
    words = word_hashes(body)
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(sequence_hashes(words, min(size, len(words))))


def class_of(found: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    total = np.array([mixed(found).sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)
    return int(mixed(total).view(np.int64)[0])


def minhashes(found: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    h = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    work = np.empty((256, count), np.uint32)
    for at in range(0, len(h), 256):
        part = h[at:at + 256, None]
        w = work[:len(part)]
        np.multiply(part, _FACTOR[:count], out=w)
        w += _SHIFT[:count]
        np.minimum(least, w.min(axis=0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float, steps) -> dict[int, int]:
    """For n values compared, the fewest equal ones a pair may have."""
    out = {}
    for n in steps:
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


class Block:
    def __init__(self, names: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]):
        self.names, self.copies, self.sets = names, copies, sets
        self.sizes = np.array([len(s) for s in sets])
        self.least = np.array([minhashes(s, COMPARED) for s in sets], np.uint32).reshape(len(sets), COMPARED)


def alike(a: Block, b: Block, same: bool, threshold: float, tolerance: float):
    """Index pairs (of ``a``, of ``b``) whose likeness reaches the threshold."""
    fewest = least_matches(threshold, tolerance, range(STEP, COMPARED + 1, STEP))
    for x in range(0, len(a.sets), TILE):
        for y in range(x if same else 0, len(b.sets), TILE):
            i, j = _survivors(a, b, slice(x, x + TILE), slice(y, y + TILE), same, threshold, fewest)
            if len(i):
                common_ = _common(a.sets, b.sets, i, j)
                union = a.sizes[i] + b.sizes[j] - common_
                good = common_ >= threshold * union - 1e-9
                if good.any():
                    yield i[good], j[good]


def _survivors(a: Block, b: Block, xs: slice, ys: slice, same: bool, threshold: float, fewest: dict[int, int]):
    na, nb = a.sizes[xs, None], b.sizes[None, ys]
    ok = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
    if same:
        ok &= np.arange(xs.start, xs.start + len(na))[:, None] < np.arange(ys.start, ys.start + nb.shape[1])[None, :]
    i, j = np.nonzero(ok)
    equal = np.zeros(len(i), np.int32)
    left, right = a.least[xs], b.least[ys]
    for n, m in fewest.items():
        for at in range(0, len(i), 1 << 15):
            p = slice(at, at + (1 << 15))
            equal[p] += (left[i[p], n - STEP:n] == right[j[p], n - STEP:n]).sum(axis=1, dtype=np.int32)
        go = equal >= m
        i, j, equal = i[go], j[go], equal[go]
        if not len(i):
            break
    return i + xs.start, j + ys.start


def _common(left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    rows, at_i = np.unique(i, return_inverse=True)
    columns, at_j = np.unique(j, return_inverse=True)
    if len(i) < 4 * (len(rows) + len(columns)):
        out = np.empty(len(i), np.int64)
        for k, (p, q) in enumerate(zip(i, j)):
            s, t = (left[p], right[q]) if len(left[p]) < len(right[q]) else (right[q], left[p])
            out[k] = (t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum() if len(s) else 0
        return out
    # many pairs among few sets: one product of 0/1 matrices counts them all
    l_sets, r_sets = [left[p] for p in rows], [right[q] for q in columns]
    words, place = np.unique(np.concatenate(l_sets + r_sets), return_inverse=True)
    l_row = np.repeat(np.arange(len(rows)), [len(s) for s in l_sets])
    r_row = np.repeat(np.arange(len(columns)), [len(s) for s in r_sets])
    l_at, r_at = place[:len(l_row)], place[len(l_row):]
    shared = np.flatnonzero((np.bincount(l_at, minlength=len(words)) > 0) & (np.bincount(r_at, minlength=len(words)) > 0))
    to = np.full(len(words), -1)
    to[shared] = np.arange(len(shared))
    l_at, r_at = to[l_at], to[r_at]
    total = np.zeros((len(rows), len(columns)), np.float32)
    width = 4096
    for at in range(0, len(shared), width):
        x, y = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
        use = (l_at >= at) & (l_at < at + width)
        x[l_row[use], l_at[use] - at] = 1
        use = (r_at >= at) & (r_at < at + width)
        y[r_row[use], r_at[use] - at] = 1
        total += x @ y.T
    return total[at_i, at_j].astype(np.int64)


class Forest:
    """Union by least index."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, left, right) -> None:
        for i, j in zip(left, right):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


SIGNED = "doc_id bigint, text_hash bigint, cls bigint, bands array<bigint>"


def by_shingles():
    """How this operator makes a text's set, and the set's candidate keys."""
    return shingles, lambda found: bands_of(minhashes(found))


def signed(docs: DataFrame, make=by_shingles) -> DataFrame:
    """``docs`` (doc_id, body) as (doc_id, text_hash, cls, bands).  ``make()``, called in
    each task, gives the functions body -> set and set -> candidate keys."""

    def run(batches):
        common.begin()
        set_of, keys_of = make()
        for b in batches:
            names, keys = [], []
            for body in b.column("body"):
                found = set_of(body.as_py())
                names.append(class_of(found))
                keys.append(keys_of(found) if len(found) else np.zeros(0, np.int64))
            ends = np.cumsum([0] + [len(k) for k in keys])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(names, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc_id", "text_hash", "cls", "bands"])

    return docs.withColumn("text_hash", F.xxhash64("body")).mapInArrow(run, SIGNED)


def _components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of edges (src, dst)."""
    return connected_components(edges.withColumn("graph_name", F.lit("all"))).select("vertex", "component")


def clusters(rows: DataFrame) -> DataFrame:
    """(cls, cluster) of the classes that share a band with another class."""
    banded = rows.select("cls", F.explode("bands").alias("band"))
    met = (banded.groupBy("band").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
           .where("low < high").select("band", "low"))
    edges = (banded.join(common.written(met), "band").where("cls <> low")
             .select(F.col("cls").alias("src"), F.col("low").alias("dst")).distinct())
    return _components(edges).select(F.col("vertex").alias("cls"), F.col("component").alias("cluster"))


def class_texts(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``texts`` with the id and the text hash of a class."""
    return texts.join(chosen, (F.xxhash64("body") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")))


def linked_classes(texts: DataFrame, rows: DataFrame, threshold: float, tolerance: float, block: int,
                   make=by_shingles) -> DataFrame:
    """For each class of equal sets: cls, first (its least id), text_hash (of the
    row that it is read from), copies, links (to rows of other classes) and component.  ``texts``: doc_id, body;
    ``rows``: the same as ``signed`` gives them.  A tolerance of 0 leaves all
    candidates to the exact comparison."""
    # the text that a class is read from: of its least id (null: last) the one with the least hash
    head = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("head")
    classes = common.written(rows.groupBy("cls").agg(head, F.count(F.lit(1)).alias("copies")).select(
        "cls", F.col("head.doc_id").alias("first"), F.col("head.text_hash").alias("text_hash"), "copies"))
    found = common.written(clusters(rows))
    sizes = found.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    chosen = (found.join(common.written(sizes), "cluster").join(classes, "cls")
              .select("cls", "cluster", "copies", "first", F.col("text_hash").alias("own"), "blocks",
                      F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block")))

    def read(batches):
        set_of, _ = make()
        for b in batches:
            sets = [set_of(x.as_py()) for x in b.column("body")]
            right = pa.array([class_of(s) == c for s, c in zip(sets, b.column("cls").to_pylist())])
            names = ["cls", "cluster", "copies", "blocks", "block"]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "found"])
            yield out.filter(right)

    kept = "cls bigint, cluster bigint, copies bigint, blocks int, block int"
    # rows that share an id may hold other texts, which their hash leaves out; ``read`` keeps the class's own
    sets = (class_texts(texts, chosen).select("body", "cls", "cluster", "copies", "blocks", "block")
            .mapInArrow(read, f"{kept}, found binary"))
    # a set is sent once for each block of its cluster: as many at a time as there are, or ``PASS_SETS``
    sent = found.groupBy("cluster").count().select("count", (F.col("count") * F.ceil(F.col("count") / block)).alias("sent")).agg(
        F.sum("count").alias("n"), F.sum("sent").alias("sent")).first()
    passes = max(1, -(-(sent.sent or 0) // max(PASS_SETS, sent.n or 0)))
    if passes > 1:
        sets = common.written(sets)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("*", other).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})

    def compare(key, table):
        _, p, q = (k.as_py() for k in key)
        names = np.asarray(table.column("cls"))
        order = np.argsort(names, kind="stable")
        order = order[np.append(True, names[order][1:] != names[order][:-1])]  # copies of a row with one id
        names, block_ = names[order], np.asarray(table.column("block"))[order]
        copies = np.asarray(table.column("copies"))[order]
        found = table.column("found").to_pylist()
        sets = [np.frombuffer(found[i], np.uint64) for i in order]

        def part(number):
            at = np.flatnonzero(block_ == number)
            return at, Block(names[at], copies[at], [sets[i] for i in at])

        at_a, a = part(p)
        at_b, b = (at_a, a) if p == q else part(q)
        links, forest = np.zeros(len(names), np.int64), Forest(len(names))
        for i, j in alike(a, b, p == q, threshold, tolerance):
            i, j = at_a[i], at_b[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            forest.join(i.tolist(), j.tolist())
        roots = np.array([forest.root(i) for i in range(len(names))])
        lead = np.flatnonzero((links > 0))
        return pa.table({"cls": pa.array(names[lead], pa.int64()), "links": pa.array(links[lead], pa.int64()),
                         "root": pa.array(names[roots[lead]], pa.int64()),
                         "whole": pa.array([p == q == 0 and int(table.column("blocks")[0].as_py()) == 1] * len(lead), pa.bool_())})

    def compared(some: DataFrame) -> DataFrame:
        return common.written(some.groupBy("cluster", "p", "q").applyInArrow(
            compare, "cls bigint, links bigint, root bigint, whole boolean"))

    if passes == 1:
        linked = compared(pairs)
    else:
        in_pass = F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(passes))
        linked = reduce(DataFrame.unionByName, [compared(pairs.where(in_pass == k)) for k in range(passes)])
    # a cluster of one block has its components; those of several are joined up
    torn = linked.where("NOT whole AND cls <> root").select(F.col("cls").alias("src"), F.col("root").alias("dst"))
    comps = linked.where("whole").select("cls", F.col("root").alias("component"))
    if not torn.isEmpty():
        comps = comps.unionByName(_components(torn).select(F.col("vertex").alias("cls"), "component"))
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    named = (classes.join(links, "cls", "left").join(comps, "cls", "left")
             .select("cls", "first", "text_hash", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                     F.coalesce("component", "cls").alias("component")))
    return common.written(named)


def near_links(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK,
               id_col: str = "doc_id", text_col: str = "text", make=by_shingles) -> DataFrame:
    """doc_id, class_id, n_links of every row."""
    texts = common.id_text(docs, id_col, text_col)
    rows = common.written(signed(texts, make))
    named = linked_classes(texts, rows, threshold, tolerance, block, make)
    heads = common.written(named.groupBy("component").agg(F.min("first").alias("class_id")))
    by_class = common.written(named.join(heads, "component").select(
        "cls", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    return rows.select("doc_id", "cls").join(by_class, "cls").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that stand for their group: of each group
    of rows connected by links the one with the least id (a null id last; of
    rows with that id, the one with the least text hash; of equal ones any)."""
    texts = common.id_text(docs, id_col, text_col)
    rows = common.written(signed(texts))
    named = linked_classes(texts, rows, threshold, tolerance, block)
    order = F.struct(F.col("first").isNull().alias("n"), "first", "cls", "text_hash")
    heads = common.written(named.groupBy("component").agg(F.min(order).alias("h")).select(
        F.col("h.first").alias("head"), F.col("h.text_hash").alias("own")))
    id_, own = common.free_name("id", docs.columns), common.free_name("own", docs.columns)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    hashed = docs.withColumns({id_: F.col(id_col).cast("bigint"), own: F.xxhash64(body)})

    def of(side: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        return side.join(chosen, side[id_].eqNullSafe(chosen["head"]) & (side[own] == chosen["own"]), how)

    # rows that share id and text: of each such head one stays
    same = rows.groupBy(F.col("doc_id").alias("head"), F.col("text_hash").alias("own")).count().where("count > 1").drop("count")
    kept, same = of(hashed, heads, "left_semi"), common.written(same)
    if not same.isEmpty():
        first = F.row_number().over(Window.partitionBy(id_, own).orderBy(F.lit(1)))
        n = common.free_name("n", hashed.columns)
        one = of(kept, same, "left_semi").withColumn(n, first).where(F.col(n) == 1).drop(n)
        kept = of(kept, same, "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(common.table(spark, sf_dir, "documents"))
