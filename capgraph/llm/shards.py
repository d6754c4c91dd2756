"""Documents in ordered shards, and the exchange of hashes between shards.

Finding equal windows of text over a whole corpus needs only the windows'
hashes to meet.  Documents are cut by (id, text) into ranges of at most
``shard_bytes`` bytes, once, into a bucketed table (``cuts``): only a text that
is longer than an eighth of that by itself makes a shard larger, by its own
length.  In each round

1. a shard sends its *distinct* hashes, sorted and cut by their upper bits
   into parts (``send``).  However often a passage repeats inside a shard, and
   however many documents share it, each shard sends it once, so no hash makes
   a group larger than the number of shards;
2. a part compares what it got from all shards and answers every shard with
   one bit for each hash sent (``answers``);
3. the next round reads shard and answers together (``with_answers``).  The
   shard's texts are never shuffled again, as the table's buckets are the
   partitions; only hashes and bits move.

Shards follow the order of ids, then texts, so "does it occur earlier" is "did
a lower shard send it".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bucketed_table, written
from . import common

SHARD_BYTES = 16 << 20
PART_HASHES = 1 << 20
#: Hashes that a part compares at a time, about.
COMPARED = 1 << 19
LOWEST = -(1 << 63)
#: How many bytes of their texts tell the rows of a large id apart; each next try reads so many times more.
HEAD_BYTES, HEAD_GROWTH = 64, 8


def _running(groups: DataFrame, parts: int, large: int, width: int) -> DataFrame:
    """``groups`` (key, head, bytes, n, same), one row each, with ``at``: the
    bytes before it in order; and ``big``: too large to stay one group.  A big
    one counts for ``width`` at least, so what follows it starts a new range."""
    big = (F.col("bytes") > large) & (F.col("n") > 1)
    weighed = groups.withColumn("big", big).withColumn(
        "weight", F.when(big, F.greatest("bytes", F.lit(width))).otherwise(F.col("bytes")))
    ranged = written(weighed.repartitionByRange(parts, "key", "head").withColumn("part", F.spark_partition_id()))
    starts, total = [], 0
    for r in sorted(ranged.groupBy("part").agg(F.sum("weight").alias("w")).collect()):
        starts.append((r.part, total))
        total += r.w
    before = Window.partitionBy("part").orderBy("key", "head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = ranged.sparkSession.createDataFrame(starts, "part int, start bigint")
    return (ranged.join(F.broadcast(firsts), "part")
            .withColumn("at", F.col("start") + F.sum("weight").over(before) - F.col("weight")))


def cuts(groups: DataFrame, keyed: DataFrame, parts: int, large: int, width: int) -> list[tuple[int, bytes, int]]:
    """Where ranges of (key, body) start, in order, and over how many shards
    the rows of each are spread: 1, or more for equal rows.

    ``groups``: the rows' groups by key.  Ranges of at most ``width`` bytes
    begin where the running sum passes a multiple of it.  A group of more than
    ``large`` bytes is cut in the same way by the beginnings of its texts, longer
    ones as far as they are equal; only equal rows, which have no order, are
    dealt out."""
    found: dict[tuple[int, bytes], int] = {}
    size = 0
    while True:
        rows = written(_running(groups, parts, large, width))
        for r in rows.groupBy(F.floor(F.col("at") / width)).agg(F.min(F.struct("key", "head")).alias("c")).collect():
            found.setdefault((r.c.key, bytes(r.c["head"])), 1)
        bigs = rows.where("big").collect()  # each has more than ``large`` bytes, so there are few
        for r in bigs:
            found[r.key, bytes(r["head"])] = -(-r.bytes // width) if r.same else 1
        bigs = [(r.key, r["head"]) for r in bigs if not r.same]
        if not bigs:
            return [(*at, n) for at, n in sorted(found.items())]
        named = keyed.sparkSession.createDataFrame(bigs, "key bigint, head binary")
        rest = (keyed.withColumn("head", F.substring("body", 1, size))
                .join(F.broadcast(named), ["key", "head"], "left_semi"))
        size = size * HEAD_GROWTH or HEAD_BYTES
        groups = grouped(rest.withColumn("head", F.substring("body", 1, size)))


def grouped(rows: DataFrame) -> DataFrame:
    """key, head, bytes, n rows, and whether they are all the same."""
    name = F.xxhash64("body")
    return rows.groupBy("key", "head").agg(
        F.sum(F.octet_length("body").cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("n"),
        (F.min(name) == F.max(name)).alias("same"))


def shard_of(found: list[tuple[int, bytes, int]]):
    """The shard of a row (key, body): binary search in ``cuts``' result."""
    keys = F.split(F.lit(",".join(str(k) for k, *_ in found)), ",").cast("array<bigint>")
    heads = F.array(*[F.lit(bytearray(h)) for _, h, _ in found]) if any(h for _, h, _ in found) else None
    firsts = np.cumsum([0] + [n for *_, n in found])
    step_sizes = F.array(*[F.lit(1 << k) for k in reversed(range(len(found).bit_length()))])

    def walk(at, step):
        key = F.get(keys, at + step - 1)
        passed = key <= F.col("key") if heads is None else (key < F.col("key")) | (
            (key == F.col("key")) & (F.get(heads, at + step - 1) <= F.col("body")))
        return F.when(passed, at + step).otherwise(at)

    at = F.aggregate(step_sizes, F.lit(0), walk) - 1
    if all(n == 1 for *_, n in found):
        return at
    first, n = (F.get(F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>"), at)
                for x in (firsts[:-1].tolist(), [n for *_, n in found]))
    return (first + F.pmod(F.xxhash64(F.monotonically_increasing_id()), n)).cast("int")


class Shards:
    """``frame``: shard, key and the columns of ``docs`` (doc_id, body, perhaps
    others); ``bytes``: of all bodies."""

    def __init__(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES):
        keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
        groups = written(grouped(keyed.withColumn("head", F.lit(b""))))
        self.bytes = groups.agg(F.sum("bytes")).first()[0] or 0
        # as many as Spark's own shuffles have, or the planner would deal the table anew
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        large = max(1, shard_bytes // 8)
        width = max(1, min(shard_bytes - large, -(-self.bytes // parts)))
        found = cuts(groups, keyed, parts, large, width) if self.bytes else []
        shard = shard_of(found) if found else F.lit(0)
        self.count = max(parts, sum(n for *_, n in found))
        placed = keyed.withColumn("shard", shard).repartitionById(self.count, F.col("shard"))
        self.frame = bucketed_table(placed.select("shard", *keyed.columns), self.count, ["shard"], compression="zstd")

    def parts(self, hashes: int) -> int:
        """How many parts ``hashes`` hashes are dealt to; a power of two."""
        return 1 << max(3, (hashes // PART_HASHES).bit_length())


def bodies_of(shard: pa.Table):
    """A shard's (doc_id, body) pairs by id, then text; equal rows stay."""
    return ordered(shard)[0]


def ordered(shard: pa.Table):
    """``bodies_of`` and the rows' places in ``shard``."""
    keys, ids, bodies = (shard.column(c).to_pylist() for c in ("key", "doc_id", "body"))
    order = sorted(range(len(keys)), key=lambda i: (keys[i], bodies[i]))
    return [(ids[i], bodies[i]) for i in order], order


SENT = "part int, shard int, hashes binary, again binary"
ANSWER = "shard int, part int, bits binary"


def cut_points(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted ``hashes`` are cut: by their upper bits."""
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(64 - (parts.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)


def send(shard: int, hashes: np.ndarray, again: np.ndarray, parts: int) -> pa.Table:
    """Rows of ``SENT``.  ``hashes``: sorted and distinct; ``again``: whether
    the shard itself has the hash more than once."""
    at = cut_points(hashes, parts)
    full = [p for p in range(parts) if at[p] < at[p + 1]]
    return pa.table({
        "part": pa.array(full, pa.int32()), "shard": pa.array([shard] * len(full), pa.int32()),
        "hashes": pa.array([hashes[at[p]:at[p + 1]].tobytes() for p in full], pa.binary()),
        "again": pa.array([np.packbits(again[at[p]:at[p + 1]]).tobytes() for p in full], pa.binary())})


def compared(part: int, table: pa.Table, parts: int, earlier: bool, size: int = COMPARED) -> pa.Table:
    """``answers`` of one part, ``size`` hashes at a time, about: what a part
    holds besides what it got doesn't grow with it."""
    shards = np.asarray(table.column("shard"))
    order = np.argsort(shards, kind="stable")
    blobs, flags = table.column("hashes"), table.column("again")
    got = [np.frombuffer(blobs[i].as_buffer(), np.uint64) for i in order.tolist()]
    ends = np.cumsum([len(x) for x in got])
    cuts = max(1, -(-int(ends[-1]) // size))
    # the part's range of hashes in equal steps
    width = (1 << 64) // parts
    edges = np.array([part * width + width * k // cuts for k in range(1, cuts)], np.uint64)
    at = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]).astype(np.int64) for x in got]
    bit = np.empty(int(ends[-1]), bool)
    for k in range(cuts):
        flat = np.concatenate([x[c[k]:c[k + 1]] for x, c in zip(got, at)])
        ranked = np.argsort(flat, kind="stable")  # equal hashes stay in the order of shards
        same = np.zeros(len(flat), bool)
        sorted_ = flat[ranked]
        equal = sorted_[1:] == sorted_[:-1]
        same[1:] = equal
        if not earlier:
            same[:-1] |= equal
        back = np.empty(len(flat), bool)
        back[ranked] = same
        done = 0
        for x, c, e in zip(got, at, ends):
            n = c[k + 1] - c[k]
            bit[e - len(x) + c[k]:e - len(x) + c[k + 1]] = back[done:done + n]
            done += n
    bits = []
    for i, x, e in zip(order.tolist(), got, ends):
        mine = bit[e - len(x):e]
        if not earlier:
            mine = mine | np.unpackbits(np.frombuffer(flags[i].as_buffer(), np.uint8), count=len(x)).astype(bool)
        bits.append(np.packbits(mine).tobytes())
    return pa.table({"shard": pa.array(shards[order], pa.int32()), "part": pa.array([part] * len(order), pa.int32()),
                     "bits": pa.array(bits, pa.binary())})


def answers(sent: DataFrame, parts: int, earlier: bool) -> DataFrame:
    """One bit for each hash sent: whether a lower shard sent it too
    (``earlier``), or whether it occurs more than once anywhere."""

    def run(key, table):
        common.begin()
        out = compared(key[0].as_py(), table, parts, earlier)
        common.release()
        return out

    return sent.repartition(parts, "part").groupBy("part").applyInArrow(run, ANSWER)


def answered(table: pa.Table, hashes: np.ndarray, parts: int) -> np.ndarray:
    """The answer to each of a shard's ``hashes``, as they were sent."""
    at = cut_points(hashes, parts)
    out = np.zeros(len(hashes), bool)
    for part, bits in zip(table.column("part").to_pylist(), table.column("bits").to_pylist()):
        out[at[part]:at[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8),
                                                   count=at[part + 1] - at[part]).astype(bool)
    return out


def with_answers(shards: Shards, replies: DataFrame, run, schema: str) -> DataFrame:
    """``run(shard table, answers table)`` for each shard."""
    return shards.frame.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(run, schema)
