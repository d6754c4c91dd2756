"""Dedup of repeated word sequences by prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one text.  Every word covered by a
window whose words also start earlier (lower id, or same text, earlier start)
goes; all windows are judged on the input.  These windows are the internal
nodes of depth ``window`` or more in the corpus's suffix tree: each such node
keeps its first leaf, and all its other leaves are repeats.

The tree is never built whole.  Suffixes are split by prefixes of growing
length into groups that fit in memory, and a group's subtree is read off the
sorted group:

1. prefixes of ``PREFIX`` words, taken at each window's minimiser (the start
   with the least hash among those in the window, the same one wherever the
   window stands), so about one suffix in seven is looked at.  A prefix that
   occurs once has no internal node below it: its windows drop out;
2. the other prefixes are extended to ``window`` words.  Suffixes that agree
   that far form one deep node; the lowest one is kept.

Both steps run as exchanges of distinct hashes between id-ordered shards
(``shards``): a shard sends a prefix once, however often it has it, so hot
passages make no large group.

Hashes are 64-bit; two sequences must agree in both lengths' hashes to be
confused.  Defined cases: null text has no words; texts shorter than a window
lose nothing; rows with equal ids count in the order of their texts; of equal
rows one counts as the earlier; null ids come first; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op6_suffix_dedup import covered_spans, distinct, known, powers
from .shards import SENT, SHARD_BYTES, Shards, answered, answers, bodies_of, send, with_answers

WINDOW = 20
PREFIX = 8
STRIP_WORDS = 1 << 16
STRIP_BYTES = 1 << 18
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
#: ASCII white space, as [^\x20\x09-\x0D]+ has it.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text`` start, and their hashes."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return starts, h


def word_hashes(body: bytes) -> np.ndarray:
    """The hashes of a text's words, read in strips that end at white space."""
    if len(body) <= STRIP_BYTES:
        return _hashed(body)[1]
    found, at = [], 0
    while at < len(body):
        end = at + STRIP_BYTES
        if end < len(body):
            cuts = [body.rfind(bytes([c]), at, end) for c in np.flatnonzero(_SPACE).tolist()]
            end = max(cuts) + 1
            if end <= at:  # one word longer than a strip
                later = [i for c in np.flatnonzero(_SPACE).tolist() if (i := body.find(bytes([c]), at)) >= 0]
                end = min(later, default=len(body) - 1) + 1
        found.append(_hashed(body[at:end])[1])
        at = end
    return np.concatenate(found)


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of ``size`` words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, n - size + 1, STRIP_WORDS):  # bounded tables of powers
        w = words[at:at + STRIP_WORDS + size - 1]
        up, down = powers(STRIP_WORDS + WINDOW + size)
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * up[:len(w)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * down[:len(w) - size + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


def minimisers(prefixes: np.ndarray, reach: int) -> np.ndarray:
    """For each window, the position of the least of its ``reach`` prefixes."""
    n = len(prefixes) - reach + 1
    best, at = prefixes[:n].copy(), np.arange(n)
    for k in range(1, reach):
        less = prefixes[k:k + n] < best
        best[less] = prefixes[k:k + n][less]
        at[less] = np.flatnonzero(less) + k
    return at


class Strip:
    """The words of some texts in a row, their windows and minimisers; windows
    that would reach into the next text are left out."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, window: int, prefix: int):
        self.words, self.counts, self.window = words, counts, window
        self.firsts = np.cumsum(counts) - counts
        n = len(words) - window + 1
        if n <= 0:
            self.starts, self.prefix = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        text = np.repeat(np.arange(len(counts)), counts)
        self.starts = np.flatnonzero(text[:n] == text[window - 1:])
        prefixes = sequence_hashes(words, prefix)
        at = minimisers(prefixes, window - prefix + 1)[self.starts]
        self.prefix = prefixes[at]
        self.sampled = self.prefix[np.append(True, at[1:] != at[:-1])] if len(at) else self.prefix

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return sequence_hashes(self.words, self.window)[self.starts[which]]


def strips(bodies: list[bytes], window: int, prefix: int):
    """(first text, ``Strip``) of all texts, some at a time."""
    i = 0
    while i < len(bodies):
        j, size = i, 0
        while j < len(bodies) and (j == i or size + len(bodies[j]) < STRIP_BYTES):
            size += len(bodies[j]) + 1
            j += 1
        if j == i + 1:
            words = word_hashes(bodies[i])
            counts = np.array([len(words)])
        else:
            ends = np.cumsum([len(b) + 1 for b in bodies[i:j]])
            starts, words = _hashed(b" ".join(bodies[i:j]))
            counts = np.diff(np.append(0, np.searchsorted(starts, ends)))
        yield i, Strip(words, counts, window, prefix)
        i = j


RESULT = "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def repeated_sequences(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id",
                       text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, the removed spans of words, and the kept words joined
    by single spaces, of every row."""
    corpus = Shards(common.id_text(docs, id_col, text_col), shard_bytes)
    prefix_parts, window_parts = corpus.parts(corpus.bytes // 40), corpus.parts(corpus.bytes // 20)

    def sampled(bodies):
        return distinct([s.sampled for _, s in strips(bodies, window, prefix) if len(s.starts)])

    def left(bodies, prefixes: np.ndarray, twice: np.ndarray):
        """Each strip with its windows whose prefix repeats, and their hashes."""
        for i, s in strips(bodies, window, prefix):
            which = np.flatnonzero(known(prefixes, twice, s.prefix))
            yield i, s, which, s.hashes(which) if len(which) else np.zeros(0, np.uint64)

    def split(key, shard):
        return send(key[0].as_py(), *sampled([b for _, b in bodies_of(shard)]), prefix_parts)

    def extend(key, shard, replies):
        bodies = [b for _, b in bodies_of(shard)]
        prefixes, _ = sampled(bodies)
        twice = answered(replies, prefixes, prefix_parts)
        found = distinct([h for *_, h in left(bodies, prefixes, twice)])
        common.release()
        return send(key[0].as_py(), *found, window_parts)

    def removed(key, shard, replies):
        kinds = np.asarray(replies.column("kind"))
        rows = bodies_of(shard)
        bodies = [b for _, b in rows]
        prefixes, _ = sampled(bodies)
        twice = answered(replies.filter(pa.array(kinds == 1)), prefixes, prefix_parts)
        found = list(left(bodies, prefixes, twice))
        flat = np.concatenate([h for *_, h in found])
        nodes, first, node = np.unique(flat, return_index=True, return_inverse=True)
        earlier = answered(replies.filter(pa.array(kinds == 2)), nodes, window_parts)
        repeat = earlier[node] | (first[node] != np.arange(len(flat)))
        counts, spans, kept, at = [], [], [], 0
        for i, s, which, h in found:
            starts = s.starts[which[repeat[at:at + len(h)]]]
            at += len(h)
            cuts = np.searchsorted(starts, s.firsts)
            for k, (count, lo, hi) in enumerate(zip(s.counts.tolist(), cuts, np.append(cuts[1:], len(starts)))):
                words = bodies[i + k].split()
                runs = covered_spans(starts[lo:hi] - s.firsts[k], window) if lo < hi else []
                counts.append(count)
                spans.append([{"start": a, "end": b} for a, b in runs])
                ends = [0, *(x for run in runs for x in run), len(words)]
                kept.append(b" ".join(w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]) if runs else b" ".join(words))
        return pa.table({
            "doc_id": pa.array([d for d, _ in rows], pa.int64()), "n_words": pa.array(counts, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary())})

    one = common.written(answers(corpus.frame.groupBy("shard").applyInArrow(split, SENT), prefix_parts, False))
    two = common.written(answers(with_answers(corpus, one, extend, SENT), window_parts, True))
    both = one.withColumn("kind", F.lit(1)).unionByName(two.withColumn("kind", F.lit(2)))
    return with_answers(corpus, both, removed, RESULT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_sequences(common.table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
