"""Document fingerprints: SpotSigs.

A signature is an anchor (a common word) and the chain of the next
``chain`` content words after it; a text's fingerprint is the set of its
signatures.  Anchors sit in prose, so what surrounds it hardly counts.  Words
that no anchored chain covers (text of other languages, code, junk) are read as
plain chains of neighbouring words, of which each run of ``REACH`` starts keeps
the one with the least hash: which ones is decided by the words around them
alone, so a fingerprint grows with its text, and texts that differ by a word
differ by a few signatures.  Scripts without white space are read by
characters.  Two
fingerprints are compared by Jaccard likeness with pruning: sets whose
lengths alone rule the threshold out are never intersected.

Signatures are hashed to 32 bits; the fingerprint string is the sorted set in
base64, so equal texts have equal fingerprints and ``likeness`` needs nothing
but the strings.

Defined cases: a null text is an empty one; a text with neither an anchored nor
a plain chain has one signature of all its words; a text without words has the
empty fingerprint, which is like itself (1) and unlike all others (0).  Texts of any
length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import op10_ngram_join as near
from .tokenizer import Memo

#: Common words of four languages that start a signature.
ANCHORS = """a an the is was be that this
le la un une est que dans pour
der die das ist ein und mit von
el los una es que con por del""".split()
#: Further common words that chains pass over.
PASSED = """of and in to or on for it he as at by with from are you we not
de les des et en au il elle du par sur ce
den dem des zu im auf für nicht eine es
y de la las en un se no su al lo""".split()
CHAIN = 3
#: Plain chains: one of so many neighbouring starts stays.
REACH = 4
#: An anchored chain that reaches over more words than this covers none of them.
MOST_COVERED = 16

MARKS = re.compile(r"[\W_]+")
#: UTF-8 of characters whose scripts put no space between words: Thai, Lao,
#: Tibetan, Myanmar, Khmer, kana, bopomofo, Han.
UNSPACED = re.compile(rb"(?:\xE0[\xB8-\xBF]|\xE1[\x80-\x82\x9E\x9F]|\xE2[\xBA-\xBF]|[\xE3-\xE9][\x80-\xBF]"
                      rb"|\xEF[\xA4-\xAB]|\xF0[\xA0-\xB3][\x80-\xBF])[\x80-\xBF]")
GAP, ANCHOR, CONTENT = 0, 1, 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word(chunk: bytes) -> int:
    """A chunk's word hash; its lowest two bits tell what it is."""
    word = MARKS.sub("", chunk.decode("utf-8", "replace").lower())
    kind = GAP if not word or word in _PASSED else ANCHOR if word in _ANCHORS else CONTENT
    h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return (h & ~3 | (kind if word else 3)) & 0x7FFFFFFFFFFFFFFF


_ANCHORS, _PASSED = frozenset(ANCHORS), frozenset(PASSED) - frozenset(ANCHORS)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _M2
    return h ^ h >> np.uint64(29)


def least_of_runs(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each ``REACH`` neighbours of one group the one with the least hash (of
    a group with fewer all together one), as a mask."""
    n = len(h)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.append(begin[1:], n)
    size = np.repeat(end - begin, end - begin)
    offset = np.arange(n) - np.repeat(begin, end - begin)
    first = np.flatnonzero(offset <= np.maximum(size - REACH, 0))
    most = np.minimum(REACH, size[first])
    best = first.copy()
    for k in range(1, REACH):
        less = (k < most) & (h[np.minimum(first + k, n - 1)] < h[best])
        best[less] = first[less] + k
    out = np.zeros(n, bool)
    out[best] = True
    return out


#: The first bytes of the characters that ``UNSPACED`` is about.
HIGH = re.compile(rb"[\xE0-\xF4]")


def spaced(body: bytes) -> bytes:
    """``body`` with white space around each character of an unspaced script."""
    return UNSPACED.sub(rb" \g<0> ", body) if HIGH.search(body) else body


class Signatures:
    """The sorted signature hashes of texts."""

    def __init__(self, chain: int = CHAIN):
        self.chain, self.words = chain, Memo(_word)

    def hashed(self, chunks: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, chunks), np.int64, len(chunks))

    def chained(self, words: np.ndarray, at: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The hashes of each word ``at`` and the chain from place ``first`` of ``after``."""
        h = words[at] * _M1
        for k in range(min(self.chain, len(after))):
            h = _mixed((h ^ words[after[first + k]]) * _M1)
        return h

    def __call__(self, body: bytes) -> np.ndarray:
        return self.of([self.hashed(spaced(body).split())])[0]

    def of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The signatures of each of ``texts``, as hashed chunks; all of them in
        one pass, in which no chain or run goes from one text to the next."""
        words = np.concatenate(texts).view(np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        kind = words & np.uint64(3)
        real = kind != 3  # chunks without a letter or digit are no words
        words, text, kind = words[real], text[real], kind[real]
        n, chain = len(words), self.chain
        found, owners = [], []
        at, after = np.flatnonzero(kind == ANCHOR), np.flatnonzero(kind == CONTENT)
        first = np.searchsorted(after, at)
        whole = first + chain <= len(after)
        at, first = at[whole], first[whole]
        change = np.zeros(n + 1, np.int32)
        if len(at):
            last = after[first + chain - 1]
            inside = text[last] == text[at]
            at, first, last = at[inside], first[inside], last[inside]
            found.append(self.chained(words, at, after, first))
            owners.append(text[at])
            near_ = last - at < MOST_COVERED
            change[:-1] += np.bincount(at[near_], minlength=n).astype(np.int32)
            change -= np.bincount(last[near_] + 1, minlength=n + 1).astype(np.int32)
        covered = np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))
        if n > chain:
            starts = np.flatnonzero((covered[chain + 1:] == covered[:n - chain]) & (text[chain:] == text[:n - chain]))
            if len(starts):
                plain = self.chained(words, starts, np.arange(n), starts + 1)
                least = least_of_runs(plain, covered[starts] + text[starts] * (n + 1))
                found.append(plain[least])
                owners.append(text[starts[least]])
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        both = owner.astype(np.uint64) << np.uint64(32)
        if found:
            both |= np.concatenate(found) >> np.uint64(32)
        both = np.unique(both)
        ends = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
        signatures = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out = [signatures[a:b] for a, b in zip(ends, ends[1:])]
        for i in np.flatnonzero(ends[1:] == ends[:-1]).tolist():  # texts with neither kind of chain
            own = words[np.searchsorted(text, i):np.searchsorted(text, i, side="right")]
            if len(own):
                h = self.chained(own, np.zeros(1, np.int64), np.arange(len(own)), np.zeros(1, np.int64))
                out[i] = (h >> np.uint64(32)).astype(np.uint32)
        return out


def packed(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 where their lengths, or what can
    still be common after one half of the shorter, rule ``threshold`` out."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    if len(a) < threshold * len(b):
        return 0.0
    if threshold:
        half = len(a) // 2
        common_now = int((b[np.minimum(np.searchsorted(b, a[:half]), len(b) - 1)] == a[:half]).sum())
        most = common_now + len(a) - half
        if most < threshold * (len(a) + len(b) - most):
            return 0.0
    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return same / (len(a) + len(b) - same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, fingerprint, n_signatures of every row."""

    def run(batches):
        signatures = Signatures(chain)
        for b in batches:
            found = [signatures(x.as_py()) for x in b.column("body")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(packed, found), pa.string()),
                 pa.array(map(len, found), pa.int32())], ["doc_id", "fingerprint", "n_signatures"])

    return common.id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, fingerprint string, n_signatures int")


# -- near duplicates -----------------------------------------------------------

def length_partition(n: int, threshold: float) -> int:
    """The partition of sets of ``n`` signatures: the lengths of a partition lie
    within a factor ``threshold``, so sets that reach the threshold are in the
    same partition or in neighbours."""
    return int(np.floor(np.log(n) / -np.log(threshold) + 1e-9))


#: Signatures whose texts are counted for the order, at most; others count as rare.
MOST_COUNTED = 1 << 21
#: Signatures that a task counts at a time.
COUNTED = 1 << 20
#: Texts for each part of all signatures that a task counts, about.
BUCKET_TEXTS = 5000


def frequent(texts: DataFrame, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """The signatures held by the most of ``texts`` (doc_id, body), ascending, and
    their numbers of texts: those with more than one in ``MOST_COUNTED`` of all
    texts' signatures, so at most that many."""

    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // BUCKET_TEXTS))

    def run(batches):
        signatures, held, size = Signatures(chain), [], 0

        def counted():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(found, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                own = slice(cuts[k], cuts[k + 1])
                yield k, zlib.compress(np.stack([np.diff(found[own].astype(np.int64), prepend=0), n[own]]).astype("<u4").tobytes(), 1)

        def packed_():
            parts = list(counted())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())],
                                              ["bucket", "counts"])

        for b in batches:
            for body in b.column("body"):
                held.append(signatures(body.as_py()))
                size += len(held[-1])
                if size >= COUNTED:
                    yield packed_()
                    held, size = [], 0
        if size:
            yield packed_()

    def summed(batches):
        names, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged():
            every = np.concatenate([names, *(h[0] for h in held)])
            found, at = np.unique(every, return_inverse=True)
            return found, np.bincount(at, np.concatenate([n, *(h[1] for h in held)]), len(found)).astype(np.int64)

        for b in batches:
            for x in b.column("counts"):
                gaps, times = np.frombuffer(zlib.decompress(x.as_py()), "<u4").reshape(2, -1).astype(np.int64)
                held.append((np.cumsum(gaps), times))
                size += len(times)
                if size >= COUNTED:
                    names, n = merged()
                    held, size = [], 0
        names, n = merged()
        often = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(names[often], -1)), pa.array(np.append(n[often], n.sum()))], ["signature", "n"])

    # signatures of one text each, most of all, are only counted; -1: of how many texts a bucket's are
    counts = common.written(texts.mapInArrow(run, "bucket int, counts binary").repartitionById(buckets, F.col("bucket"))
                            .select("counts").mapInArrow(summed, "signature bigint, n bigint"))
    total = counts.where("signature = -1").agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("signature") >= 0) & (F.col("n") > F.lit(max(1, total // MOST_COUNTED)))).toArrow()
    names, n = (found.column(c).to_numpy() for c in ("signature", "n"))
    order = np.argsort(names)
    return names[order].astype(np.uint64), n[order].astype(np.int32)


def candidate_keys(found: np.ndarray, threshold: float, counts: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Keys of which two sets that reach the threshold share one: the first
    n - ceil(threshold * n) + 1 signatures in one fixed order, rare ones first by
    ``counts`` (signatures ascending, numbers of texts), for the set's own length
    partition and the next one."""
    n = len(found)
    keys = near.mixed(found)
    texts = np.zeros(n, np.int64)
    if counts is not None and len(counts[0]):
        at = np.minimum(np.searchsorted(counts[0], found), len(counts[0]) - 1)
        texts = np.where(counts[0][at] == found, counts[1][at], 0)
    first = keys[np.lexsort((keys, texts))][:n - int(np.ceil(threshold * n - 1e-9)) + 1]
    own = length_partition(n, threshold)
    parts = [own, own + 1]
    return np.concatenate([near.mixed(first + np.uint64(p * int(_M1) & 0xFFFFFFFFFFFFFFFF)) for p in parts]).view(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                    chain: int = CHAIN) -> DataFrame:
    """doc_id, class_id (the least id connected to it) and n_links (rows whose
    fingerprint's likeness reaches ``threshold``) of every row.

    Sets are partitioned by length and meet by their rarest signatures inside a
    partition and the next one, so that texts with only a frequent passage in
    common don't meet; pairs that lengths rule out are dropped, the others are
    counted exactly, in blocks (see ``op10_ngram_join``)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(common.id_text(docs, id_col, text_col), chain))

    def make():
        signatures = Signatures(chain)
        return ((lambda body: signatures(body).astype(np.uint64)),
                (lambda found: candidate_keys(found, threshold, sent.value)))

    return near.near_links(docs, threshold, 0.0, id_col=id_col, text_col=text_col, make=make)


# -- the comparison of each document with its edited text and its successor --

ROWS_PER_RANGE = 8192
MOST_RANGES = 4096
LOWEST = -(1 << 63)


def in_falling_order(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs`` (doc_id, body) in ranges of falling ids: columns range, ahead,
    key, doc_id, body, sorted within each partition.

    The first document of each range is also sent, marked ``ahead``, to the
    end of the range before it, and the very first one to the end of the last
    range, so every document meets its successor in one shuffle of the texts.
    A null id comes last.
    """
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    ids = keyed.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top")).first()
    ranges = min(MOST_RANGES, max(1, ids.n // rows_per_range))
    tops = []
    if ranges > 1:
        cuts = [1 - k / ranges for k in range(1, ranges)]
        found = keyed.agg(F.percentile_approx("key", cuts, 10_000).alias("cut")).first().cut
        tops = sorted({x for x in found if x < ids.top}, reverse=True)
    starts = F.array(*[F.lit(x).cast("bigint") for x in tops]) if tops else F.array().cast("array<bigint>")
    own = F.size(F.filter(starts, lambda x: x >= F.col("key")))
    before = F.when(F.col("key") == F.lit(ids.top), F.lit(len(tops))).when(
        F.array_contains(starts, F.col("key")), F.col("own") - 1)
    to = F.array_compact(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("ahead")),
                                 F.when(F.col("before").isNotNull(),
                                        F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead")))))
    placed = (keyed.withColumn("own", own).withColumn("before", before)
              .select("key", "doc_id", "body", F.explode(to).alias("to")).select("to.*", "key", "doc_id", "body"))
    return (placed.repartitionById(len(tops) + 1, F.col("range"))
            .sortWithinPartitions("range", "ahead", F.desc("key"), F.xxhash64("body"), "body"))


EDITED = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


#: Texts whose signatures are made in one pass: so many rows, or bytes.
PASS_ROWS, PASS_BYTES = 256, 1 << 20


class Text:
    """A document's text and the hashes of its chunks."""

    def __init__(self, doc_id, body: bytes, signatures: Signatures):
        self.doc_id, self.body = doc_id, body
        self.points = None if body.isascii() else body.decode("utf-8", "replace")
        self.n = len(body) if self.points is None else len(self.points)
        self.words = signatures.hashed(spaced(body).split())

    def first(self, n: int) -> bytes:
        """The first ``n`` code points."""
        return self.body[:n] if self.points is None else self.points[:n].encode("utf-8", "replace")

    def edited(self, after: "Text", signatures: Signatures) -> tuple[str, np.ndarray]:
        """The edited text's digest, and the hashes of its chunks: those of both
        texts but for the chunks at the cuts."""
        head, tail = self.first(self.n - self.n // 2), after.first(self.n // 2)
        digest = hashlib.sha256(head + tail).hexdigest()
        head, tail = spaced(head), spaced(tail)
        left, right = head.split(), tail.split()
        seam = left[-1:] + right[:1]
        if left and right and not (head[-1:].isspace() or tail[:1].isspace()):
            seam = [b"".join(seam)]
        return digest, np.concatenate([self.words[:max(0, len(left) - 1)], signatures.hashed(seam),
                                       after.words[1:max(1, len(right) - 1)], signatures.hashed(right[1:][-1:])])


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (its second
    half replaced by the start of the next document in falling order of ids)
    and of the next document."""

    def run(batches):
        signatures = Signatures()
        last = None  # (range, text) that waits for its successor
        pairs, size = [], 0

        def settled():
            digests, edits = zip(*(a.edited(b, signatures) for a, b in pairs))
            texts = {id(t): t for pair in pairs for t in pair}  # a text is in two pairs, or ahead of its range
            found = signatures.of([*edits, *(t.words for t in texts.values())])
            changed, own = found[:len(edits)], dict(zip(texts, found[len(edits):]))
            rows = [(a.doc_id, a.n, d, packed(own[id(a)]), packed(c), likeness(own[id(a)], c), likeness(own[id(a)], own[id(b)]))
                    for (a, b), d, c in zip(pairs, digests, changed)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], t) for i, t in enumerate((
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in batches:
            for r, ahead, doc_id, body in zip(b.column("range").to_pylist(), b.column("ahead").to_pylist(),
                                              b.column("doc_id").to_pylist(), b.column("body")):
                if ahead and (last is None or last[0] != r):
                    continue  # only the first row ahead is a successor
                text = Text(doc_id, body.as_py(), signatures)
                if last is not None:
                    pairs.append((last[1], text))
                    size += len(text.body)
                last = None if ahead else (r, text)
                if len(pairs) >= PASS_ROWS or size >= PASS_BYTES:
                    yield settled()
                    pairs, size = [], 0
        if pairs:
            yield settled()

    return in_falling_order(common.id_text(docs, id_col, text_col), rows_per_range).mapInArrow(run, EDITED)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(common.table(spark, sf_dir, "documents"))


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links of every document: fingerprints compared by
    length partitions and pruned Jaccard at 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
