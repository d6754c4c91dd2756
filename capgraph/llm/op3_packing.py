"""Best-fit packing of tokenised documents into fixed-length sequences.

1. Arrow tasks turn each whole text into token ids, add the closing id, and
   cut only documents longer than a sequence into sequence-long pieces.  Only
   the pieces' numbers (not the ids) go on.
2. Pieces are dealt to shards by a hash of document, piece and row number, so
   no source, key or equal rows can make a shard large; the number of shards
   follows from the number of pieces.  Each shard is sorted by falling length and packed by itself.
3. The packer is a bounded-space online best fit: a fixed number of open bins
   in a bitset keyed by free space.  A piece goes to the open bin that it
   fills best; when a new bin is needed and all are open, the fullest closes.

Feeding the longest pieces first makes the bins that close early the ones
with least room, so closing them costs little; a shard's short pieces fill
what is left.  Order and shards depend on the rows alone, so a task that is
run again gives the same sequences.

Rows: one for each piece; repeated rows are packed each by itself; a null or
empty text is one piece of just the closing id; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizer

SEQUENCE = 4096
CLOSING_ID = 1
OPEN_BINS = 4096
SHARD_PIECES = 32_768

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    end = closing_id.to_bytes(4, "little")

    def cut(batches):
        tok = tokenizer.load(path)
        for b in batches:
            out = ([], [], [], [], [])
            for doc, body in zip(b.column(0).to_pylist(), b.column(1)):
                ids = memoryview(tok.ids_of(body.as_py()) + end)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, sequence)):
                    part = ids[4 * at:4 * (at + sequence)]
                    for column, value in zip(out, (doc, k, at, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.id_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


class Packer:
    """Bounded-space best fit for bins of ``size``; at most ``open_bins`` open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0            # bit f is set while an open bin has f places free
        self.at = [[] for _ in range(size)]
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin for the next piece, and the piece's place in it."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if length < self.size and self.open == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, room = self.made, self.size
            self.made += 1
        if room > length:
            left = room - length
            self.at[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.size - room

    def _take(self, room: int) -> int:
        number = self.at[room].pop()
        if not self.at[room]:
            self.free &= ~(1 << room)
        self.open -= 1
        return number


def pack(parts: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``parts`` (as ``pieces`` gives them) with sequence_id and offset."""
    n = parts.count()
    shards = max(1, -(-n // shard_pieces))

    def fill(batches):
        shard = packer = None
        for b in batches:
            numbers, offsets = [], []
            for s, length in zip(b.column("shard").to_pylist(), b.column("length").to_pylist()):
                if s != shard:
                    shard, packer = s, Packer(sequence, open_bins)
                number, offset = packer.put(length)
                numbers.append(s << 40 | number)
                offsets.append(offset)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                names + ["sequence_id", "offset"])

    # equal rows would hash alike, so a row's number in the written pieces deals it out
    number = F.monotonically_increasing_id()
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", number), F.lit(shards)))
    return (dealt.repartition(shards, "shard")
            .sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece", "ids_crc32")
            .mapInArrow(fill, f"{PIECES}, sequence_id bigint, offset bigint"))


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID,
                   open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents into sequences.  The pieces are written once, as both
    their number and their rows are needed."""
    parts = common.written(pieces(docs, path, sequence, closing_id, id_col, text_col))
    return pack(parts, sequence, open_bins, shard_pieces)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer.default_path())
