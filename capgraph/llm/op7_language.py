"""Language identification by compression.

One raw-content zstandard dictionary for each language holds sample text of
that language.  Texts and dictionaries are lower-cased and keep letters only,
so case and marks don't vote.  A text is cut into short pieces, each piece is compressed
with each language's dictionary, and the language with the smallest total
wins: the pieces keep a long text from becoming its own dictionary, so the
whole text votes.  Where the best two totals lie close together the text is
rejected (``reliable`` false).

Learning rows: for each language a sample of at most ``sample_docs`` documents
(lowest md5 of the id in each of as many hash slots).  Their whole texts are
cut into pieces of some words where a word's hash says so, so equal passages
give equal pieces wherever they stand, and each piece is learned once.  Each
row gives its pieces in the order of their hashes, all rows in turn, until the
language's dictionary has ``dictionary_bytes`` or its rows have no more text.
The sample of rows is the only bounded part; every whole text is classified.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and not reliable; languages tied for the smallest total (very short texts) are
told apart by how many of the text's words their dictionaries have, which is
reliable if one has most, then by alphabetic order; a null
id is classified like any other; null languages, and languages whose sample
has no letter, are not learned from; with no learned language every text is
``und``; of rows with one id the text with the lowest hash is sampled.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICTIONARY_BYTES = 1 << 17
SAMPLE_DOCS = 400
#: Learned pieces: a word in so many ends one, which has at most so many words
#: and bytes; longer words are cut.
PIECE_WORDS = 16
MOST_WORDS = 64
MOST_BYTES = 512
PIECE_BYTES = 3072
LEVEL = 6
#: Least margin, as a share of the best total, of a reliable answer.
MIN_MARGIN = 0.002
#: Margin (same measure) at which the score is 0.73.
MARGIN_SCALE = 0.03
UNKNOWN = "und"
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, joined by single spaces."""
    return OTHER.sub(" ", text.lower()).strip()


def learning_pieces(text: str) -> set[bytes]:
    """The distinct pieces of a whole text."""
    found, held, size = set(), [], 0
    for word in OTHER.sub(" ", text.lower()).split():
        parts = [word] if len(word) * 4 <= MOST_BYTES else [
            word[k:k + MOST_BYTES // 4] for k in range(0, len(word), MOST_BYTES // 4)]
        for part in parts:
            part = part.encode("utf-8", "replace")
            if held and size + len(part) >= MOST_BYTES:
                found.add(b" ".join(held))
                held, size = [], 0
            held.append(part)
            size += len(part) + 1
            if len(held) == MOST_WORDS or zlib.crc32(part) % PIECE_WORDS == 0:
                found.add(b" ".join(held))
                held, size = [], 0
    if held:
        found.add(b" ".join(held))
    return found


def piece_order(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=8).digest()


def sampled_rows(docs: DataFrame, lang_col: str, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """lang, text of the learning rows, whole."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"),
                       F.col(text_col).alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    key = F.struct(F.md5(F.coalesce("id", F.lit("")).cast("binary")).alias("k"), F.xxhash64("text").alias("t"))
    rows = rows.select("lang", F.pmod(F.xxhash64("id"), F.lit(sample_docs)).alias("slot"), key.alias("key"), "text")
    least = rows.groupBy("lang", "slot").agg(F.min("key").alias("key"))  # at most ``sample_docs`` rows a language
    return rows.join(F.broadcast(least), ["lang", "slot", "key"]).dropDuplicates(["lang", "slot"]).select("lang", "text")


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          dictionary_bytes: int = DICTIONARY_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """The raw dictionary of each non-null language.  ``docs`` holds what may
    be learned from.  The driver receives about ``dictionary_bytes`` a language."""

    def run(batches):
        for b in batches:
            langs, turns, pieces = [], [], []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                size = 0
                for turn, piece in enumerate(sorted(learning_pieces(text.as_py()), key=piece_order)):
                    if size >= dictionary_bytes:
                        break  # these alone fill the dictionary
                    langs.append(lang)
                    turns.append(turn)
                    pieces.append(piece)
                    size += len(piece) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(turns, pa.int32()), pa.array(pieces, pa.binary())],
                ["lang", "turn", "piece"])

    found = sampled_rows(docs, lang_col, id_col, text_col, sample_docs).mapInArrow(
        run, "lang string, turn int, piece binary")
    pieces = common.written(found.groupBy("lang", "piece").agg(F.min("turn").alias("turn")))
    sums = pieces.groupBy("lang", "turn").agg(F.sum(F.octet_length("piece") + 1).alias("n")).collect()
    last, filled = {}, {}
    for r in sorted(sums):
        if filled.get(r.lang, 0) < dictionary_bytes:
            last[r.lang], filled[r.lang] = r.turn, filled.get(r.lang, 0) + r.n
    if not last:
        return {}
    turns = docs.sparkSession.createDataFrame(sorted(last.items()), "lang string, last int")
    parts: dict[str, list] = {}
    for r in pieces.join(F.broadcast(turns), "lang").where("turn <= last").select("lang", "turn", "piece").collect():
        parts.setdefault(r.lang, []).append((r.turn, piece_order(r.piece), bytes(r.piece)))
    return {lang: b" ".join(p for *_, p in sorted(parts[lang]))[:dictionary_bytes] for lang in sorted(parts)}


def piece_ends(body: bytes, size: int):
    """Ends of pieces of about ``size`` bytes, not inside a character."""
    at, n = 0, len(body)
    while n - at > size + size // 2:
        cut = at + size
        while cut > at + 1 and body[cut] & 0xC0 == 0x80:
            cut -= 1
        yield at, cut
        at = cut
    yield at, n


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece_bytes: int = PIECE_BYTES):
        import zstandard
        self.langs, self.piece_bytes = sorted(dictionaries), piece_bytes
        self.words = [set(dictionaries[lang].split()) for lang in self.langs]
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(
                level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, body: bytes) -> tuple[str, float, bool]:
        """(language, score, reliable)."""
        body = letters(body.decode("utf-8", "replace")).encode()
        if not self.langs or not body:
            return UNKNOWN, 0.0, False
        parts = [body[a:b] for a, b in piece_ends(body, self.piece_bytes)]
        totals = [sum(len(c.compress(p)) for p in parts) for c in self.compressors]
        tied = [i for i, t in enumerate(totals) if t == min(totals)]
        best, decided = tied[0], False
        if len(tied) > 1:
            words = body.split()
            votes = [sum(w in self.words[i] for w in words) for i in tied]
            best, decided = tied[votes.index(max(votes))], votes.count(max(votes)) == 1
        second = min((t for i, t in enumerate(totals) if i != best), default=2 * totals[best])
        margin = (second - totals[best]) / max(1, totals[best])
        return self.langs[best], 1 / (1 + math.exp(-min(margin / MARGIN_SCALE, 500))), decided or margin >= MIN_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, reliable of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        classify = Classifier(sent.value)
        for b in batches:
            found = [classify(x.as_py()) for x in b.column("body")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([f[i] for f in found], t)
                                       for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))],
                ["doc_id", "lang_pred", "score", "reliable"])

    return common.id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, reliable boolean")


def reliable_rows(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose language is told reliably."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        classify = Classifier(sent.value)
        return lambda body: classify(body)[2]

    return common.rows_where(docs, make, text_col)


def held_out(col):
    return F.coalesce(common.remainder_of_id(col, 5) == 0, F.lit(False))


def learned(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries of the rows whose crc32(doc_id as text) mod 5 is not 0."""
    return learn(docs.where(~held_out(F.col("doc_id"))))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learned(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
