"""Sharding by histogram sort: contiguous key ranges of near-equal bytes.

1. Every row gets a key: 56 bits of its text's md5, so equal texts stand side
   by side, then its id, then its number in the written table, so no two rows
   have the same key.
2. The ``shards - 1`` splitters are found on histograms, not on a sample.  A
   round takes, for every splitter still open, the 256 cells of the next key
   byte as candidate boundaries, counts the exact bytes in each across all
   partitions (a map-side aggregate: at most 256 rows an open splitter leave
   the tasks), and so knows the exact bytes below each.  A splitter closes at
   the boundary nearest its target once that is within ``tolerance`` of a shard's
   mean bytes, or its cell holds one row; else the next round refines the cell
   that the target lies in.  Keys are hashes, so rounds grow with log256 of
   the number of rows, until a cell holds one row: at 10^11 rows six.
3. The rows are exchanged once, by the ranges of (shard, key); a row's slot is
   its rank in its shard.

Equal texts share a shard, except where a group is larger than the tolerance
and a target lies inside it: a third of all rows can't lie in one of eight equal
shards, so such a group is cut between two rows.

Defined cases: a null text has no bytes and is keyed like an empty one; sizes
are bytes plus 1, so empty texts count as rows; null ids come before others;
equal rows may trade places; an empty table gives no rows.  Fewer rows than
shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ranks import ranked

SHARDS = 8
TOLERANCE = 0.001
#: The parts of a key, first to last, and their bits (whole bytes, below 2^62).
KEY = (("key", 56), ("id_high", 32), ("id_low", 32), ("row_high", 32), ("row_low", 32))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the key's parts of every row, without the texts."""
    texts = common.id_text(docs, id_col, text_col)
    rows = texts.select(
        "doc_id", F.when(F.octet_length("body") > 0, F.octet_length("body") + 1).otherwise(1).cast("bigint").alias("size"),
        F.crc32("body").alias("text_crc32"), F.conv(F.substring(F.md5("body"), 1, 14), 16, 10).cast("bigint").alias("key"),
        F.monotonically_increasing_id().alias("row"))
    # ids as unsigned numbers in the same order
    place = F.coalesce("doc_id", F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return rows.select("doc_id", "size", "text_crc32", "key", *_halves(place, "id"), *_halves(F.col("row"), "row"))


def _halves(x: Column, name: str) -> list[Column]:
    return [F.shiftrightunsigned(x, 32).cast("bigint").alias(f"{name}_high"), x.bitwiseAND((1 << 32) - 1).alias(f"{name}_low")]


class Splitter:
    """One boundary on its way: ``target`` bytes shall lie below it."""

    def __init__(self, target: int):
        self.target, self.below, self.at, self.bits = target, 0, [], 0  # the open cell's parts so far, the last of ``bits`` bits
        self.key: tuple[int, ...] | None = None

    def refine(self, cells: list[tuple[int, int, int]], width: int, allowed: int) -> None:
        """``cells``: (byte, bytes, rows) of the open cell's filled cells in
        order; ``width``: bits of the present key part."""
        below = self.below
        for byte, size, n in cells:
            if below + size > self.target:
                break
            below += size
        part = (self.at[-1] if self.bits else 0) << 8 | byte
        before = self.at[:-1] if self.bits else self.at
        self.bits += 8
        short, over = self.target - below, below + size - self.target
        if min(short, over) <= allowed or n == 1:
            first = part if short <= over else part + 1  # may pass the part's bits: then above all of the cell
            self.key = (*before, first << (width - self.bits), *[0] * (len(KEY) - len(before) - 1))
        self.below, self.at = below, [*before, part]
        if self.bits == width:
            self.bits = 0


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The keys at which shards 1, 2, ... begin.  ``rows``: as ``keyed`` gives
    them, written."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    allowed = int(tolerance * total / shards)
    all_ = [Splitter(k * total // shards) for k in range(1, shards)] if total else []
    for name, width in KEY:
        for shift in range(width - 8, -1, -8):
            open_ = [s for s in all_ if s.key is None]
            if not open_:
                return [s.key for s in all_]
            cells = sorted({tuple(s.at) for s in open_})
            cell = _cell(cells, open_[0].bits, name, width)
            byte = F.shiftright(name, shift).bitwiseAND(255)
            found = (rows.select(cell.alias("cell"), byte.alias("byte"), "size").where("cell IS NOT NULL")
                     .groupBy("cell", "byte").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect())
            filled = {c: [] for c in cells}
            for r in sorted(found):
                filled[cells[r.cell]].append((r.byte, r.bytes, r.n))
            for s in open_:
                s.refine(filled[tuple(s.at)], width, allowed)
    return [s.key for s in all_]


def _cell(cells: list[tuple[int, ...]], bits: int, name: str, width: int) -> Column:
    """The number of the cell that a row is in; null outside all of them."""
    out = F.lit(None).cast("int")
    for i, at in enumerate(cells):
        inside = F.lit(True)
        for (part, _), x in zip(KEY, at):
            inside = inside & ((F.shiftright(part, width - bits) if bits and part == name else F.col(part)) == x)
        out = F.when(inside, i).otherwise(out)
    return out


def shard_of(keys: list[tuple[int, ...]]) -> Column:
    """How many splitters a row's key has reached."""
    own = F.struct(*[F.col(n).cast("bigint") for n, _ in KEY])
    out = F.lit(0)
    for k in keys:
        out = out + (own >= F.struct(*[F.lit(x).cast("bigint").alias(n) for (n, _), x in zip(KEY, k)])).cast("int")
    return out.cast("int")


def placed(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = common.written(keyed(docs, id_col, text_col))
    sharded = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)))
    order = ranked(sharded, "shard", [n for n, _ in KEY], ["doc_id", "size", "text_crc32"])
    return order.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
