"""Toxicity: a linear classifier over character n-grams, whose features are
scaled by naive Bayes log-count ratios (NB-SVM with the logistic loss).

* Features: the lower-cased text's n-grams of 3 to 5 code points, hashed to
  2^18 places; a feature is present or absent.  Words of a lexicon show in any
  inflection or joint, and no language needs a word list of its own.
* Scale: r = log of the ratio of the (smoothed) shares of toxic and clean
  training documents that have the feature.  Features whose r lies within
  ``least_z`` standard errors of 0 say nothing and are left out, so a long
  text's chance n-grams don't dilute the few that matter.
* Fit: logistic regression on r * f / sqrt(number of features), classes
  weighted to one half each.  Every step of the fit is a Spark job over the
  training features: tasks send one gradient each, the driver holds only
  vectors of the feature space.

Training rows are a bounded sample of the labelled rows, ``sample_per_class``
documents of each label, lowest md5 of the id first, so it is the same sample
however the tables are partitioned.  Scoring covers every whole text.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; a null label is no label; a document labelled both ways counts as
toxic; without a training row of both classes every score is the share of
toxic training rows (0 without any); null ids are scored and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import common

BITS = 18
SIZES = (3, 4, 5)
SAMPLE_PER_CLASS = 3000
STEPS = 24
RATE = 0.4
LEAST_Z = 3.0
#: Tasks of a step of the fit; each sends a vector of the feature space.
FIT_TASKS = 8
RIDGE = 3e-5
THRESHOLD = 0.7
#: Code points hashed at a time; a longer text is read in overlapping parts.
PART = 1 << 20


class Features:
    """The places of the n-grams that a text has."""

    def __init__(self, sizes=SIZES, bits: int = BITS):
        self.sizes, self.bits = sizes, bits
        self.seen = np.zeros(1 << bits, bool)

    def __call__(self, body: bytes) -> np.ndarray:
        text = body.decode("utf-8", "replace").lower()
        longest = max(self.sizes)
        for at in range(0, max(1, len(text) - longest + 1), PART):
            self._mark(text[at:at + PART + longest - 1])
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32)

    def _mark(self, part: str) -> None:
        points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
        h, shift = points, np.uint32(32 - self.bits)
        for n in range(2, max(self.sizes) + 1):
            if len(points) < n:
                break
            h = h[:-1] * np.uint32(0x01000193)
            h += points[n - 1:]
            if n in self.sizes:
                g = h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
                g *= np.uint32(0x85EBCA6B)
                g ^= g >> np.uint32(15)
                g *= np.uint32(0xC2B2AE35)
                self.seen[g >> shift] = True


def features(docs: DataFrame, keep: list[str], sizes=SIZES, bits: int = BITS) -> DataFrame:
    """``keep`` columns and ``found``, the int32 feature places, of each row
    of ``docs`` (which has a binary column body)."""
    schema = common.with_fields(docs.select(*keep).schema, found=BinaryType())

    def extract(batches):
        common.begin()
        f = Features(sizes, bits)
        for b in batches:
            rows = b.select(keep)
            found = pa.array([f(x.as_py()).tobytes() for x in b.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns, found], [*keep, "found"])

    return docs.select(*keep, "body").mapInArrow(extract, schema)


def training_sample(labels: DataFrame, sample_per_class: int, label_col: str = "toxic",
                    id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of at most ``sample_per_class`` labelled documents a class."""
    one = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
           .where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")))
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    of = lambda y: one.where(F.col("y") == y).orderBy(key, "doc_id").limit(sample_per_class)
    return of(1).unionByName(of(0))


class Model:
    """Weights (already times the log-count ratio) of the feature ``places``
    that count, in ascending order."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float, size: int = 1 << BITS):
        self.places, self.weights, self.bias, self.size = places, weights, bias, size
        self.slot = np.full(size, -1, np.int32)
        self.slot[places] = np.arange(len(places), dtype=np.int32)

    @property
    def kept(self) -> np.ndarray:
        """Which feature places count, as a mask."""
        return self.slot >= 0

    def sent(self) -> tuple:
        """What a task makes the model from."""
        return self.places, self.weights, self.bias, self.size

    def score(self, found: np.ndarray) -> float:
        slots = self.slot[found]
        slots = slots[slots >= 0]
        z = self.bias + (float(self.weights[slots].sum()) / np.sqrt(len(slots)) if len(slots) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counted(sample: DataFrame) -> DataFrame:
    """(place, toxic, clean): in how many documents of each label a feature is."""
    def run(batches):
        for b in batches:
            y = np.asarray(b.column("y"), np.int64)
            found = [np.frombuffer(x.as_py(), np.int32) for x in b.column("found")]
            at = np.concatenate(found) if found else np.zeros(0, np.int32)
            y = np.repeat(y, [len(f) for f in found])
            places, where = np.unique(at, return_inverse=True)
            toxic = np.bincount(where, weights=y, minlength=len(places)).astype(np.int64)
            n = np.bincount(where, minlength=len(places))
            yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int32()), "toxic": pa.array(toxic, pa.int64()),
                                              "clean": pa.array(n - toxic, pa.int64())})

    return (sample.mapInArrow(run, "place int, toxic bigint, clean bigint")
            .groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _chosen(counts: DataFrame, toxic: int, clean: int, least_z: float) -> DataFrame:
    """(place, ratio) of the features that say something."""
    t, c = F.col("toxic") + 1.0, F.col("clean") + 1.0
    ratio = F.log(t / (toxic + 2)) - F.log(c / (clean + 2))
    error = F.sqrt(1 / t - 1.0 / (toxic + 2) + 1 / c - 1.0 / (clean + 2))
    return counts.select("place", ratio.alias("ratio"), error.alias("error")).where(F.abs("ratio") >= least_z * F.col("error"))


def _only(sample: DataFrame, slot: np.ndarray) -> DataFrame:
    """``sample`` with the features that are kept, by their slots."""
    def run(batches):
        for b in batches:
            found = [slot[np.frombuffer(x.as_py(), np.int32)] for x in b.column("found")]
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), pa.array([f[f >= 0].tobytes() for f in found], pa.binary())], ["y", "found"])

    return sample.mapInArrow(run, "y int, found binary")


def _gradient(sample: DataFrame, scaled: np.ndarray, bias: float, ratio: np.ndarray, share: dict[int, float]) -> np.ndarray:
    """The loss's gradient by weight and, last, by bias; each task sends one
    vector of the kept features, at most ``FIT_TASKS`` in all."""
    size = len(ratio)
    sent = sample.sparkSession.sparkContext.broadcast((scaled, bias))

    def run(batches):
        total = np.zeros(size + 1)
        scaled, bias = sent.value
        for b in batches:
            y = np.asarray(b.column("y"), np.int64)
            found = [np.frombuffer(x.as_py(), np.int32) for x in b.column("found")]
            y, found = y[[len(f) > 0 for f in found]], [f for f in found if len(f)]
            if not found:
                continue
            lengths, at = np.array([len(f) for f in found]), np.concatenate(found)
            first = np.cumsum(lengths) - lengths
            z = np.add.reduceat(scaled[at], first) / np.sqrt(lengths) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * np.where(y == 1, share[1], share[0])
            total[:-1] += np.bincount(at, weights=np.repeat(g / np.sqrt(lengths), lengths), minlength=size)
            total[-1] += g.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    out = np.zeros(size + 1)
    for r in sample.mapInArrow(run, "total binary").collect():
        out += np.frombuffer(r.total)
    sent.destroy()
    out[:-1] *= ratio
    return out


def fit(sample: DataFrame, bits: int = BITS, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE,
        least_z: float = LEAST_Z) -> Model:
    """``sample``: (y, found).  The driver holds vectors of the features that
    are kept, at most 2^bits numbers and usually a few thousand."""
    size = 1 << bits
    sample = sample.coalesce(FIT_TASKS)
    n = dict(sample.groupBy("y").count().collect())
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))), size)

    kept = _chosen(_counted(sample), n[1], n[0], least_z).select("place", "ratio").coalesce(1).sortWithinPartitions("place").toArrow()
    places, ratio = np.asarray(kept.column("place")).astype(np.int32), np.asarray(kept.column("ratio"))
    slot = np.full(size, -1, np.int32)
    slot[places] = np.arange(len(places), dtype=np.int32)
    sample = common.written(_only(sample, slot)).coalesce(FIT_TASKS)
    share = {y: 0.5 / n[y] for y in (0, 1)}
    w, bias = np.zeros(len(places)), 0.0
    m = v = np.zeros(len(places) + 1)
    for k in range(1, steps + 1):
        g = _gradient(sample, w * ratio, bias, ratio, share)
        g[:-1] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(places, w * ratio, float(bias), size)


def train(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, label_col: str = "toxic",
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``docs`` and ``labels`` hold what may be learned from."""
    sample = training_sample(labels, sample_per_class, label_col, id_col)
    # at most 2 * sample_per_class rows of two numbers
    rows = common.id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")
    return fit(common.written(features(rows, ["y"])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())

    def run(batches):
        f, m = Features(), Model(*sent.value)
        for b in batches:
            scores = pa.array([m.score(f(x.as_py())) for x in b.column("body")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], ["doc_id", "score"])

    return common.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def clean_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that score below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.sent())

    def make():
        f, m = Features(), Model(*sent.value)
        return lambda body: m.score(f(body)) < threshold

    return common.rows_where(docs, make, text_col)


def held_out(col):
    return F.coalesce(common.remainder_of_id(col, 3) == 1, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows whose crc32(doc_id as text) mod 3 is not 1."""
    return train(docs, labels.where(~held_out(F.col("doc_id"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, learned(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
