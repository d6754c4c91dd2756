"""Exact top-k search by inner product in norm buckets.

Vectors are grouped by length into buckets; a query meets buckets, not rows.
For each query and bucket the best score so far gives a local cosine threshold
t = theta / (|q| * greatest length in the bucket):

* t > 1: nothing in the bucket can reach theta, it is skipped;
* small t: *length pruning*: only vectors of length >= theta / |q| (the start
  of the bucket, as it is sorted) are verified, by one matrix product;
* large t: *coordinate pruning*: on each of the query's ``FOCUS`` largest
  coordinates a unit vector with cosine >= t has an angle to the axis that is
  at most arccos(t) off the query's; only vectors inside all these intervals
  are verified.

theta starts from the longest vectors (``SEED_BUCKETS`` buckets) and rises
from bucket to bucket.  Bounds carry a small slack, and products are exact
(float64 on integers below 2^53, Python integers beyond), so the result is
exact.  Queries and candidates meet in blocks of bounded size; a block pair
whose bounds rule each other out is dropped by the join condition.

Defined cases: vectors that are null or empty, or hold a null or non-finite
component, and rows with a null id, take no part; nor do those with a component
whose floor(1024 * x) is no 64-bit integer, as none can be scored;
vectors of another dimension than the query's are no candidates; rows with the
query's id are its own; every other row counts, repeated ones as well; scores
beyond 64 bits stop at the limits; zero vectors are ordinary ones; an empty
table or one without queries gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
K = 10
BUCKET = 4096
QUERY_BLOCK = 256
SEED_BUCKETS = 2
FOCUS = 3
#: Below this local threshold intervals of coordinates hold nearly everything.
COORDINATES_FROM = 0.35
SLACK = 1e-9
EXACT = float(1 << 53)


def scaled_vectors(rows: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v array<bigint>, dim, norm of the rows that take part."""
    x = F.col(vector_col)
    fine = (x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (c.cast("double") * scale >= F.lit(-float(1 << 63)))
                                               & (c.cast("double") * scale < F.lit(float(1 << 63))), F.lit(False))))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)
    return (rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
            .withColumns({"dim": F.size("v"), "norm": F.sqrt(square)}))


BLOCKS = "dim int, top double, ids binary, vectors binary"


def in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Runs of at most ``size`` neighbouring rows of one dimension as one row
    each: ids, vectors (int64), and the greatest length."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim):
            rows = held.pop(dim)
            ids, vs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([max(r[2] for r in rows)], pa.float64()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([vs.tobytes()], pa.binary())],
                ["dim", "top", "ids", "vectors"])

        for b in batches:
            v = b.column("v")
            flat, ends = np.asarray(v.flatten()), np.cumsum([0] + b.column("dim").to_pylist())
            for i, (vec_id, dim, norm) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("dim").to_pylist(),
                                                        b.column("norm").to_pylist())):
                held.setdefault(dim, []).append((vec_id, flat[ends[i]:ends[i + 1]], norm))
                if len(held[dim]) == size:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.select("vec_id", "v", "dim", "norm").mapInArrow(run, BLOCKS)


class Bucket:
    """Vectors sorted by falling length."""

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.ints = np.frombuffer(vectors, np.int64).reshape(-1, dim)
        self.v = self.ints.astype(np.float64)
        self.norms = np.sqrt((self.v * self.v).sum(axis=1))
        order = np.argsort(-self.norms, kind="stable")
        self.ids, self.ints, self.v, self.norms = self.ids[order], self.ints[order], self.v[order], self.norms[order]
        self.unit = (self.v / np.maximum(self.norms, 1e-300)[:, None]).T.copy()

    def products(self, at, query: int, other: "Bucket") -> np.ndarray:
        if other.norms[query] * self.norms[0] < EXACT:
            return (self.v[at] @ other.v[query]).astype(np.int64)
        q = [int(x) for x in other.ints[query]]
        top = (1 << 63) - 1
        return np.array([max(-top - 1, min(top, sum(a * b for a, b in zip(q, map(int, row)))))
                         for row in self.ints[at]], np.int64)


def best(bucket: Bucket, queries: Bucket, theta: np.ndarray, k: int):
    """For each query the k best of the bucket that reach ``theta``; theta rises
    to the k-th best where the bucket holds that many."""
    top = bucket.norms[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(queries.norms * top > 0, theta / (queries.norms * top), np.where(theta > 0, np.inf, -np.inf))
    live = np.flatnonzero(local <= 1 + SLACK)
    by_length = live[(local[live] < COORDINATES_FROM) & (queries.norms[live] * top < EXACT)]
    whole = {}
    if len(by_length):
        need = np.where(queries.norms[by_length] > 0, theta[by_length] / np.maximum(queries.norms[by_length], 1e-300), -np.inf)
        longest = int(np.searchsorted(-bucket.norms, -(need.min() * (1 - SLACK) - SLACK), side="right"))
        products = bucket.v[:longest] @ queries.v[by_length].T
        whole = {q: products[:, n] for n, q in enumerate(by_length)}
    for q in live:
        if q in whole:
            at, scores = np.arange(len(whole[q])), whole[q].astype(np.int64)
        else:
            at = _by_coordinates(bucket, queries, q, local[q]) if local[q] >= COORDINATES_FROM else np.arange(len(bucket.ids))
            scores = bucket.products(at, q, queries)
        good = (scores >= theta[q]) & (bucket.ids[at] != queries.ids[q])
        at, scores = at[good], scores[good]
        if len(at) > k:
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= edge], scores[scores >= edge]
            order = np.lexsort((bucket.ids[at], -scores))[:k]
            at, scores = at[order], scores[order]
        if len(at) == k:
            least = float(scores.min())
            theta[q] = max(theta[q], least if abs(least) < EXACT else np.nextafter(least, -np.inf))
        if len(at):
            yield q, bucket.ids[at], scores


def _by_coordinates(bucket: Bucket, queries: Bucket, q: int, t: float) -> np.ndarray:
    unit = np.clip(queries.v[q] / queries.norms[q], -1, 1)
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    spread = np.arccos(min(1.0, t)) + 1e-7
    own = np.arccos(unit[focus])
    low, high = np.cos(np.minimum(np.pi, own + spread)), np.cos(np.maximum(0, own - spread))
    at = np.arange(len(bucket.ids))
    for f, least, most in zip(focus, low, high):
        c = bucket.unit[f][at]
        at = at[(c >= least - 1e-7) & (c <= most + 1e-7)]
    return at


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k rows of
    ``rows`` with the greatest inner product."""
    vectors = scaled_vectors(rows, scale, id_col, vector_col)
    n = rows.count()
    sliced = vectors.repartitionByRange(max(1, -(-n // (4 * BUCKET))), F.desc("norm"), "vec_id")
    buckets = common.written(in_blocks(sliced.sortWithinPartitions(F.desc("norm"), "vec_id"), BUCKET))
    asked = common.written(in_blocks(scaled_vectors(queries, scale, id_col, vector_col), QUERY_BLOCK))
    seed = [(r.dim, bytes(r.ids), bytes(r.vectors)) for r in
            buckets.orderBy(F.desc("top"), F.xxhash64("ids")).limit(SEED_BUCKETS).collect()]
    sent = rows.sparkSession.sparkContext.broadcast(seed)

    def start(batches):
        """Adds each query's first theta, and the least bucket length that can
        still help a query of the block."""
        for b in batches:
            thetas, reach = [], []
            for dim, ids, vectors_ in zip(b.column("dim").to_pylist(), b.column("ids").to_pylist(), b.column("vectors").to_pylist()):
                q = Bucket(ids, vectors_, dim)
                theta = np.full(len(q.ids), -np.inf)
                for d, seed_ids, seed_vectors in sent.value:
                    if d == dim:
                        for _ in best(Bucket(seed_ids, seed_vectors, d), q, theta, k):
                            pass
                thetas.append(theta.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = np.where(q.norms > 0, theta / q.norms, np.where(theta > 0, np.inf, -np.inf))
                reach.append(float(r.min()) * (1 - SLACK) - SLACK if np.isfinite(r.min()) else -1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("dim"), b.column("ids"), b.column("vectors"), pa.array(thetas, pa.binary()), pa.array(reach, pa.float64())],
                ["q_dim", "q_ids", "q_vectors", "thetas", "reach"])

    started = common.written(asked.mapInArrow(start, "q_dim int, q_ids binary, q_vectors binary, thetas binary, reach double"))

    def search(batches):
        risen: dict[bytes, np.ndarray] = {}
        last = (None, None)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                q = Bucket(r["q_ids"], r["q_vectors"], r["q_dim"])
                if last[0] != r["ids"]:
                    last = (r["ids"], Bucket(r["ids"], r["vectors"], r["dim"]))
                if r["q_ids"] not in risen:
                    if len(risen) > 256:
                        risen.clear()
                    risen[r["q_ids"]] = np.frombuffer(r["thetas"]).copy()
                found = list(best(last[1], q, risen[r["q_ids"]], k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(ids), q.ids[at]) for at, ids, _ in found]), pa.int64()),
                         pa.array(np.concatenate([ids for _, ids, _ in found]), pa.int64()),
                         pa.array(np.concatenate([scores for *_, scores in found]), pa.int64())],
                        ["query_id", "vec_id", "score"])

    # blocks meet blocks; written so that the dimension, one hot key, is no key to shuffle by
    met = started.join(buckets, (F.abs(F.col("q_dim") - F.col("dim")) < 1) & (F.col("top") >= F.col("reach")))
    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
