"""Dedup of repeated byte strings by prefix-free parsing.

Every byte covered by a ``window``-byte string that also starts anywhere else
in the corpus goes; strings never cross documents, and all are judged on the
input.

1. *Parse.*  A rolling hash over ``TRIGGER_BYTES`` bytes triggers about every
   ``PERIOD``-th position; a phrase reaches from one trigger to the end of
   the next, so phrases overlap by a trigger (prefix-free) and equal text
   parses equally wherever it stands.
2. *Dictionary.*  The distinct phrases of all shards meet in one exchange and
   each shard learns which of its phrases occur twice (``shards``).  A window
   can repeat only if every phrase inside it does: unique text, nearly all of
   a corpus, ends here, at one hash for ``PERIOD`` bytes.
3. *Corpus order.*  What is left are the suffixes that start inside repeated
   phrases.  They are put in order by the hash of their first ``window``
   bytes (the phrase's tail, the phrases after it, the head of the last) in a
   second exchange; suffixes that agree that far stand side by side.  Order
   among unequal suffixes doesn't matter here, so hashes stand in for the
   ranks that suffix arrays of dictionary and parse would give, and no task
   has to hold the dictionary or the parse of the corpus.
4. The marked windows' union is cut out of each text.

Hashes are 64-bit polynomials over random byte values, mixed; two different
strings must agree in a window's and in all its phrases' hashes to be
confused.  Giant texts are read in overlapping strips.

Defined cases: null text is empty; a text shorter than the window loses
nothing; repeated rows are texts like any others, so each makes the other's
windows repeat; overlapping occurrences in one text count; null ids come
first in order and stay null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import common
from .shards import SENT, SHARD_BYTES, Shards, answered, answers, bodies_of, ordered, send, with_answers

WINDOW = 400
TRIGGER_BYTES = 16
PERIOD = 48
STRIP = 1 << 18
#: Half of what other operators take: a shard may hold a hash for each byte.
TEXT_BYTES = SHARD_BYTES // 2
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_VALUES = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Strip:
    """Concatenated pieces of texts.  A piece owns its first positions; the
    bytes after them are the start of the text's next piece."""

    def __init__(self, pieces, window: int, period: int = PERIOD):
        # pieces: (document index, first position, owned positions, bytes)
        self.pieces, self.window, self.period = pieces, window, period
        self.bytes = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        self.lengths = np.array([len(p[3]) for p in pieces])
        self.ends = np.cumsum(self.lengths)
        n = len(self.bytes)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.bytes] * up[:n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes at positions ``at``."""
        h = (self.sums[at + size] - self.sums[at]) * self.down[at]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h

    def _run(self, size: int) -> np.ndarray:
        """Hashes of all strings of ``size`` bytes, pieces' ends included."""
        h = (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h

    def let_go(self) -> None:
        """Drop what takes eight times the text's room."""
        self.bytes = self.sums = None
        self.pieces = [(doc, at, own, b"") for doc, at, own, _ in self.pieces]

    def parse(self):
        """Triggers, and for each the phrase's hash to the next trigger of
        the same piece, or 0 where there is none within a window."""
        if len(self.bytes) < TRIGGER_BYTES:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero((self._run(TRIGGER_BYTES) >> np.uint64(32)) % np.uint64(self.period) == 0)
        piece = np.searchsorted(self.ends, at, side="right")
        inside = at + TRIGGER_BYTES <= self.ends[piece]
        at, piece = at[inside], piece[inside]
        phrase = np.zeros(len(at), np.uint64)
        if len(at) > 1:
            size = at[1:] - at[:-1] + TRIGGER_BYTES
            whole = np.flatnonzero((piece[1:] == piece[:-1]) & (size <= self.window))
            phrase[whole] = self.hashes(at[whole], size[whole]) | np.uint64(1)
        return at, phrase

    def candidates(self, at: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Owned window starts without a phrase inside that is ``alone``."""
        starts = []
        for (_, _, own, _), n, end in zip(self.pieces, self.lengths.tolist(), self.ends.tolist()):
            first = end - n
            last = first + min(own, n - self.window + 1)  # starts in [first, last)
            if last <= first:
                continue
            lo, hi = np.searchsorted(at, [first, end])
            lone = at[lo:hi][alone[lo:hi]]
            if not len(lone):
                starts.append(np.arange(first, last))
                continue
            # a phrase [t, u + TRIGGER_BYTES) lies inside windows from u + TRIGGER_BYTES - window to t
            until = at[np.flatnonzero(alone[lo:hi]) + lo + 1] + TRIGGER_BYTES - self.window
            change = np.zeros(last - first + 1, np.int32)
            a = np.clip(until - first, 0, last - first)
            b = np.clip(lone + 1 - first, 0, last - first)
            use = a < b
            np.add.at(change, a[use], 1)
            np.add.at(change, b[use], -1)
            starts.append(np.flatnonzero(np.cumsum(change[:-1]) == 0) + first)
        return np.concatenate(starts) if starts else np.zeros(0, np.int64)


def strips(bodies: list[bytes], window: int, period: int = PERIOD, size: int = STRIP):
    """All texts in strips of about ``size`` bytes."""
    pieces, held = [], 0
    for i, body in enumerate(bodies):
        for at in range(0, max(1, len(body)), size):
            part = body[at:at + size + window + TRIGGER_BYTES]
            if held and held + len(part) > size:
                yield Strip(pieces, window, period)
                pieces, held = [], 0
            pieces.append((i, at, min(size, len(body) - at), part))
            held += len(part)
    if held:
        yield Strip(pieces, window, period)


def distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and which of them occur again."""
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    flat.sort()
    first = np.ones(len(flat) + 1, bool)  # and of what would come after
    np.not_equal(flat[1:], flat[:-1], out=first[1:-1])
    return flat[first[:-1]], ~first[1:][first[:-1]]


def known(sorted_: np.ndarray, bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(hashes), bool)
    return bits[np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)]


class Reader:
    """What each round works out anew from a shard's texts."""

    def __init__(self, bodies: list[bytes], window: int, period: int = PERIOD):
        self.bodies, self.window, self.period = bodies, window, period

    def phrases(self):
        found = []
        for strip in strips(self.bodies, self.window, self.period):
            _, phrase = strip.parse()
            found.append(phrase[phrase != 0])
        # a piece's overlap repeats the next piece's phrases; a text in several pieces is rare, so
        # these count as occurring again, which can only leave more windows to the second exchange
        return distinct(found)

    def windows(self, phrases: np.ndarray, twice: np.ndarray):
        """(strip, window starts, their hashes) of the suffixes left."""
        for strip in strips(self.bodies, self.window, self.period):
            at, phrase = strip.parse()
            alone = (phrase != 0) & ~known(phrases, twice, phrase)
            starts = strip.candidates(at, alone)
            if len(starts):
                hashes = strip.hashes(starts, self.window)
                strip.let_go()
                yield strip, starts.astype(np.int32), hashes


def covered_spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The union of the windows at sorted ``starts``, as maximal runs."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + window).tolist()))


def joined(spans: list[tuple[int, int]], later: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of a text's pieces as runs of the text."""
    if spans and spans[-1][1] >= later[0][0]:
        later[0] = (spans.pop()[0], later[0][1])
    return spans + later


def without(body: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(body[at:a])
        at = b
    kept.append(body[at:])
    return b"".join(kept)


def without_characters(body: bytes, spans) -> bytes:
    """``without``, each kept part rid of what is left of cut characters."""
    ends = [0, *(x for span in spans for x in span), len(body)]
    return b"".join(body[a:b].decode("utf-8", "ignore").encode() for a, b in zip(ends[::2], ends[1::2])) if spans else body


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = TEXT_BYTES, carry: bool = False, period: int = PERIOD,
                   keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, the removed spans and the kept bytes of every row; with
    ``carry`` also a struct ``row`` of the input's other columns, and of a
    character that a cut goes through nothing is kept.  ``keep_first``: windows
    that occur for the first time (lowest id, or in a text the first place) stay."""
    cut = without_characters if carry else without
    texts = common.id_text(docs, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    if carry:
        texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                            F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
                            F.struct(*others).alias("row"))
        row_type = common.nullable(texts.schema["row"].dataType)
    schema = common.with_fields(
        texts.select("doc_id").schema, n_bytes=LongType(), spans=ArrayType(SPAN), kept=BinaryType(),
        **({"row": row_type} if carry else {}))
    corpus = Shards(texts, shard_bytes)
    phrase_parts, window_parts = corpus.parts(corpus.bytes // period), corpus.parts(corpus.bytes // 8)

    def dictionary(key, shard):
        common.begin()
        phrases, again = Reader([b for _, b in bodies_of(shard)], window, period).phrases()
        out = send(key[0].as_py(), phrases, again, phrase_parts)
        common.release()
        return out

    def suffixes(key, shard, replies):
        common.begin()
        out = send(key[0].as_py(), *left_over(shard, replies), window_parts)
        common.release()
        return out

    def left_over(shard, replies):
        reader = Reader([b for _, b in bodies_of(shard)], window, period)
        phrases, _ = reader.phrases()
        return distinct([h for _, _, h in reader.windows(phrases, answered(replies, phrases, phrase_parts))])

    def removed(key, shard, replies):
        common.begin()
        out = cut_out(shard, replies)
        common.release()  # of what is no longer held
        return out

    def cut_out(shard, replies):
        rows, order = ordered(shard)
        reader = Reader([b for _, b in rows], window, period)
        kinds = np.asarray(replies.column("kind"))
        phrases, _ = reader.phrases()
        left = list(reader.windows(phrases, answered(replies.filter(pa.array(kinds == 1)), phrases, phrase_parts)))
        hashes, _ = distinct([h for _, _, h in left])
        again = answered(replies.filter(pa.array(kinds == 2)), hashes, window_parts)
        marked: dict[int, list] = {}
        seen = np.zeros(len(hashes), bool)
        for n, (strip, starts, h) in enumerate(left):
            left[n] = None
            node = np.searchsorted(hashes, h)
            repeat = again[node]
            if keep_first:
                first = np.zeros(len(h), bool)
                first[np.unique(node, return_index=True)[1]] = True
                repeat = repeat | ~first | seen[node]
                seen[node] = True
            starts = starts[repeat]
            cuts = np.searchsorted(starts, strip.ends)
            for (doc, at, _, _), lo, hi, first in zip(strip.pieces, np.append(0, cuts), cuts, strip.ends - strip.lengths):
                if lo < hi:
                    marked[doc] = joined(marked.get(doc, []), covered_spans(starts[lo:hi] - first + at, window))
        spans = [marked.get(i, []) for i in range(len(rows))]
        out = pa.table({
            "doc_id": pa.array([d for d, _ in rows], pa.int64()),
            "n_bytes": pa.array([len(b) for _, b in rows], pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array([cut(b, s) for (_, b), s in zip(rows, spans)], pa.binary())})
        if not carry:
            return out
        return out.append_column("row", shard.column("row").take(pa.array(order, pa.int64())).cast(to_arrow_type(row_type)))

    one = common.written(answers(corpus.frame.groupBy("shard").applyInArrow(dictionary, SENT), phrase_parts, False))
    two = common.written(answers(with_answers(corpus, one, suffixes, SENT), window_parts, keep_first))
    both = one.withColumn("kind", F.lit(1)).unionByName(two.withColumn("kind", F.lit(2)))
    return with_answers(corpus, both, removed, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    length_col: str | None = "n_chars", period: int = PERIOD, keep_first: bool = False) -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts (null: empty).
    A character that a cut goes through goes whole; ``length_col``, where
    ``docs`` has it, is counted anew."""
    found = repeated_spans(docs, window, id_col, text_col, carry=True, period=period, keep_first=keep_first)
    kept = F.col("kept").cast("string")
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(kept.alias(c))
        elif c == length_col:
            columns.append(F.length(kept).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return found.select(*columns)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
