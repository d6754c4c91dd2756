"""Ranked lexical search on K2-treaps over the term-document grid.

*Index.*  Arrow tasks cut their documents into blocks of at most
``BLOCK_DOCS`` documents and ``BLOCK_BYTES`` bytes.  A block is a grid: rows are
its terms, frequent ones first, columns its documents, short ones first, and a
point is a term's impact in a document.  The grid is halved in both directions
until cells hold one point; a cell keeps a mask of its filled quadrants and the
greatest impact inside it, a cell of one point just that point.  So a block's
tree has fewer than two cells a point, whatever the grid's width.  Every term of
every document is indexed; no row or column is left out, nothing is sampled.

*Search.*  An item's terms are rows of a block's grid.  From the root, the
paths of all its rows go down together: a state is a range of documents with
each row's cell there, bounded by the sum of the cells' maxima times the terms'
weights.  States are opened best first, ``WIDTH`` at a time, until no bound
reaches the item's k-th best score; a range of one document has its exact
score as its bound.  A task keeps an item's best over all its blocks, so later
blocks end sooner; the tasks' lists of k are merged by a window.

Counts (documents, terms, documents a term) are taken over all documents: the
first two before the index is built, as impacts depend on them; the last from
the index.  Items are searched in batches of at most ``BATCH_BYTES`` of text,
which is what goes to the tasks; more items mean more batches.

Defined cases: null and empty texts, and texts without a term, are no
documents with terms and are never found; an item without terms, or none that
occurs, has no rows; repeated items are ranked each; repeated documents each
have a rank; equal scores go by ascending id, null ids last; a document of any
length is one column; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MOST = 20
BLOCK_DOCS = 8192
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
#: Blocks searched first, so that all tasks know a score to reach.
SEED_BLOCKS = 2
#: States opened at a time.
WIDTH = 64
#: Bytes of a term: ASCII letters and digits and all of other scripts; only A-Z are lower-cased.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int8)
LAST = (1 << 63) - 1


def terms(body: bytes) -> list[bytes]:
    return body.translate(TERM_BYTES).split()


class Treap:
    """A block's points as a compressed quadtree of maxima.

    ``mask``: filled quadrants of each cell, 0 for a cell of one point;
    ``most``: the greatest impact inside; ``row``, ``column``: of the cells of
    one point, in the cells' order.  Cells go level by level, in Morton order,
    so a cell's first child follows from the masks before it."""

    def __init__(self, height: int, mask: np.ndarray, most: np.ndarray, row: np.ndarray, column: np.ndarray):
        self.height, self.row, self.column = height, row, column
        n = len(mask)
        self.mask, self.most = np.append(mask, np.uint8(0)), np.append(most, most.dtype.type(0))  # the last is no cell
        self.none = n
        children = _ONES[mask]
        inner = mask != 0
        # for a cell of one point: its place among these
        upto = lambda x: np.cumsum(x, dtype=np.int32)
        self.first = np.append(np.where(inner, upto(children) - children + np.int32(1), upto(~inner) - np.int32(1)), np.int32(-1))
        self.single = np.append(~inner, False)

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From points in 32-bit arrays, each (row, column) once."""
        height = max(1, int(max(rows.max(), columns.max())).bit_length()) if len(rows) else 1
        code = _spread(rows)
        code <<= np.uint64(1)
        code |= _spread(columns)
        order = np.argsort(code).astype(np.int32)
        code, rows, columns, values = code[order], rows[order], columns[order], values[order]
        del order
        masks, mosts, points = [], [], []
        for level in range(height + 1):
            if not len(code):
                break
            cell = code >> np.uint64(2 * (height - level))
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            size = np.diff(np.append(start, len(cell)))
            mosts.append(np.maximum.reduceat(values, start))
            alone = size == 1
            mask = np.zeros(len(start), np.uint8)
            points.append(start[alone])
            if level < height and not alone.all():
                child = code >> np.uint64(2 * (height - level - 1))
                new = np.append(True, child[1:] != child[:-1])
                quadrant = np.left_shift(new.view(np.uint8), (child & np.uint64(3)).astype(np.uint8))
                mask = np.bitwise_or.reduceat(quadrant, start)
                mask[alone] = 0
            masks.append(mask)
            points[-1] = (rows[points[-1]], columns[points[-1]])
            keep = np.repeat(~alone, size)
            code, rows, columns, values = code[keep], rows[keep], columns[keep], values[keep]
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return cls(height, joined(masks, np.uint8), joined(mosts, np.int32), joined([p[0] for p in points], np.int32),
                   joined([p[1] for p in points], np.int32))

    def search(self, rows: np.ndarray, weights: np.ndarray, tops: np.ndarray, least: int, give) -> None:
        """``give(columns, scores)`` of documents, best ranges first, until no
        bound reaches the k-th best score; ``give`` returns that score (0 while
        fewer are known).  ``tops``: the rows' own maxima; ``least``: the k-th
        best score before."""
        if not len(rows) or not self.none:
            return
        shape = self.mask, self.first, self.most
        heap = [(-int((tops * weights).sum()), 0, 0, 0, self._arrived(np.zeros((1, len(rows)), np.int64), rows)[0])]
        made = 1
        while heap and -heap[0][0] >= max(least, 1):
            taken = []
            while heap and len(taken) < WIDTH and -heap[0][0] >= max(least, 1):
                taken.append(heapq.heappop(heap))
            level = np.array([x[2] for x in taken])
            column = np.array([x[3] for x in taken])
            at = np.stack([x[4] for x in taken])
            # ranges of one document, and those in which every row has one point at most, have exact scores
            done = (level == self.height) | (self.single[at] | (at == self.none)).all(axis=1)
            if done.any():
                least = give(*self._scores(at[done], column[done], level[done], weights))
            level, column, at = level[~done], column[~done], at[~done]
            if not len(level):
                continue
            shift = (self.height - 1 - level)[:, None]
            mask, first = shape[0][at].astype(np.int64), shape[1][at]
            single = self.single[at]
            own_column = self.column[np.where(single, first, 0)] if len(self.column) else first
            high = rows[None, :] >> shift & 1
            for side in (0, 1):
                quadrant = 2 * high + side
                filled = mask >> quadrant & 1
                child = np.where(filled == 1, first + _ONES[mask & (1 << quadrant) - 1], self.none)
                child = self._arrived(child, rows)
                child = np.where(single & ((own_column >> shift & 1) == side), at, child)
                bound = (np.minimum(self.most[child], tops).astype(np.int64) * weights).sum(axis=1)
                for i in np.flatnonzero(bound >= max(least, 1)).tolist():
                    heapq.heappush(heap, (-int(bound[i]), made, int(level[i]) + 1, 2 * int(column[i]) + side, child[i]))
                    made += 1

    def _arrived(self, cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """``cells`` without the single points of other rows."""
        if not len(self.row):
            return cells
        single = self.single[cells]
        other = single & (self.row[np.where(single, self.first[cells], 0)] != rows)
        return np.where(other, self.none, cells)

    def _scores(self, at, column, level, weights):
        """Documents and exact scores of ranges whose cells hold one point a row."""
        state, term = np.nonzero(at != self.none)
        cells = at[state, term]
        single = self.single[cells]
        where = column[state] << (self.height - level[state])
        where = np.where(single, self.column[np.where(single, self.first[cells], 0)], where) if len(self.column) else where
        documents, place = np.unique(where, return_inverse=True)
        total = np.zeros(len(documents), np.int64)
        np.add.at(total, place, self.most[cells].astype(np.int64) * weights[term])
        return documents, total


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^32, a gap after each."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x |= x << np.uint64(shift)
        x &= np.uint64(keep)
    return x


# -- the index -----------------------------------------------------------------

BLOCK = ("ids array<bigint>, terms binary, df binary, tops binary, height int, mask binary, most binary, row binary, column binary")


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms, of ``docs`` (doc_id, body)."""

    def run(batches):
        common.begin()
        for b in batches:
            found = [len(terms(x.as_py())) for x in b.column("body")]
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(x > 0 for x in found)], pa.int64()),
                                              "length": pa.array([sum(found)], pa.int64())})

    # two numbers
    r = docs.select("body").mapInArrow(run, "n bigint, length bigint").agg(F.sum("n"), F.sum("length")).first()
    return r[0] or 0, r[1] or 0


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def block_of(ids: list, bodies: list[bytes], n_docs: int, length: int) -> dict:
    """A block's row of the index."""
    numbers: dict[bytes, int] = {}
    found, counts = [], []
    for body in bodies:
        words = terms(body)
        new = dict.fromkeys(words)
        for w in new:
            if w not in numbers:
                numbers[w] = len(numbers)
        place = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        place.sort()
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
        found.append(place[first])
        counts.append(np.diff(np.append(first, len(place))).astype(np.int32))
    n = np.array([c.sum() for c in counts], np.int64)
    order = np.argsort(n, kind="stable")
    rows = np.concatenate([found[i] for i in order]) if len(order) else np.zeros(0, np.int32)
    tf = np.concatenate([counts[i] for i in order]) if len(order) else rows
    columns = np.repeat(np.arange(len(order), dtype=np.int32), [len(found[i]) for i in order])
    del found, counts
    df = np.bincount(rows, minlength=len(numbers))
    frequent = np.argsort(-df, kind="stable")
    to = np.empty(len(df), np.int32)
    to[frequent] = np.arange(len(df))
    rows = to[rows]
    m = 100 - 25 + 25 * n[order] * n_docs // max(1, length)
    values = impact(tf.astype(np.int64), m[columns]).astype(np.int32)  # below 10^6
    del tf
    tops = np.zeros(len(df), np.int32)
    np.maximum.at(tops, rows, values)
    t = Treap.build(rows, columns, values)
    del rows, columns, values
    words = list(numbers)
    squeeze = zstandard.ZstdCompressor(level=1).compress  # rows of a few MB, through the JVM and back
    return {"ids": [ids[i] for i in order], "terms": squeeze(b" ".join([words[i] for i in frequent])),
            "df": df[frequent].astype(np.int32).tobytes(), "tops": tops.tobytes(), "height": t.height, "mask": squeeze(t.mask[:-1].tobytes()),
            "most": squeeze(t.most[:-1].tobytes()), "row": squeeze(t.row.tobytes()), "column": squeeze(t.column.tobytes())}


def index(docs: DataFrame, n_docs: int, length: int, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, body): a row for each block."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.binary()), ("tops", pa.binary()), ("height", pa.int32()),
                        *((c, pa.binary()) for c in ("mask", "most", "row", "column"))])

    def run(batches):
        ids, bodies, size = [], [], 0
        for b in batches:
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body")):
                body = body.as_py()
                if ids and (len(ids) >= block_docs or size + len(body) > block_bytes):
                    yield pa.RecordBatch.from_pylist([block_of(ids, bodies, n_docs, length)], schema)
                    ids, bodies, size = [], [], 0
                    common.release()
                ids.append(doc)
                bodies.append(body)
                size += len(body)
        if ids:
            yield pa.RecordBatch.from_pylist([block_of(ids, bodies, n_docs, length)], schema)
            common.release()

    return docs.select("doc_id", "body").mapInArrow(run, BLOCK)


# -- search --------------------------------------------------------------------

class Best:
    """The k best (score, id) of an item so far; null ids go last.  ``least``: what
    the k-th best score of all is known to reach."""

    def __init__(self, k: int, least: int = 0):
        self.k, self.least, self.score, self.id = k, least, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> int:
        """Take in more; the k-th best score, or ``least`` while that is more."""
        good = scores > 0
        score, id_ = np.append(self.score, scores[good]), np.append(self.id, ids[good])
        order = np.lexsort((id_, -score))[:self.k]
        self.score, self.id = score[order], id_[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))
        return self.least


def document_counts(blocks: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted terms occurs."""
    sent = blocks.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        common.begin()
        total: dict[bytes, int] = {}
        for b in batches:
            for words, df in zip(b.column("terms"), b.column("df")):
                df = np.frombuffer(df.as_py(), np.int32)
                for i, w in enumerate(zstandard.decompress(words.as_py()).split(b" ")):
                    if w in sent.value:
                        total[w] = total.get(w, 0) + int(df[i])
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.binary()), "df": pa.array(list(total.values()), pa.int64())})

    # as many rows as the batch of items has terms
    found = blocks.select("terms", "df").mapInArrow(run, "term binary, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    sent.destroy()
    return {bytes(r.term): r.df for r in found}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def first_scores(blocks: DataFrame, items: list[dict[bytes, int]], k: int) -> list[int]:
    """For each item a score that its k-th best document reaches: that of the
    first blocks of one of the index's files."""
    least = [0] * len(items)  # one number an item of the batch
    files = blocks.inputFiles()
    if not files:
        return least
    some = blocks.sparkSession.read.schema(blocks.schema).parquet(min(files))
    found = searched(some, items, least, k, SEED_BLOCKS)
    for r in found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect():
        least[r.item] = r.s
    return least


def searched(blocks: DataFrame, items: list[dict[bytes, int]], least: list[int], k: int, most: int | None = None) -> DataFrame:
    """(item, doc_id, score): of each task the k best of each of ``items``
    (term: weight times repeats), as far as they reach ``least``; ``most``: of the
    first so many blocks of a task only."""
    sent = blocks.sparkSession.sparkContext.broadcast((items, least))

    def run(batches):
        common.begin()
        items, least = sent.value
        wanted = set().union(*items)
        best = [Best(k, x) for x in least]
        done = 0
        for batch in batches:
            for i in range(batch.num_rows):
                done += 1
                if most is not None and done > most:
                    break
                b = {c: batch.column(c)[i] for c in batch.schema.names}
                t = Treap(b["height"].as_py(), *(np.frombuffer(zstandard.decompress(b[c].as_py()), kind) for c, kind in (
                    ("mask", np.uint8), ("most", np.int32), ("row", np.int32), ("column", np.int32))))
                ids = np.asarray(b["ids"].values.fill_null(LAST))
                tops = np.frombuffer(b["tops"].as_py(), np.int32)
                place = {w: p for p, w in enumerate(zstandard.decompress(b["terms"].as_py()).split(b" ")) if w in wanted}
                for item, found in zip(items, best):
                    here = [(place[w], x) for w, x in item.items() if w in place]
                    rows, weights = (np.array([h[j] for h in here], np.int64) for j in (0, 1))
                    t.search(rows, weights, tops[rows].astype(np.int64), found.least, lambda columns, scores, to=found: to.add(scores, ids[columns]))
            common.release()
        number = np.repeat(np.arange(len(best)), [len(x.id) for x in best])
        ids = np.concatenate([x.id for x in best])
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(number, pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=ids == LAST),
            "score": pa.array(np.concatenate([x.score for x in best]), pa.int64())})

    return blocks.drop("df").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = MOST, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_docs: int = BLOCK_DOCS,
           block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    texts = common.id_text(docs, id_col, text_col)
    n_docs, length = sizes(texts)
    blocks = common.written(index(texts, n_docs, length, block_docs, block_bytes))
    asked = common.written(common.id_text(items, item_col, item_text_col).withColumn("row", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("body").cast("bigint") + 64)).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    out = None
    for part in range(batches):
        # about ``batch_bytes`` of items
        some = asked.where(F.pmod(F.xxhash64("row", "body"), F.lit(batches)) == part).collect()
        counted = []
        for r in some:
            c: dict[bytes, int] = {}
            for w in terms(bytes(r.body)):
                c[w] = c.get(w, 0) + 1
            counted.append(c)
        df = document_counts(blocks, set().union(*counted)) if counted else {}
        weights = [{w: n * weight(n_docs, df[w]) for w, n in c.items() if w in df} for c in counted]
        if not counted:
            continue
        weights = [{w: x for w, x in c.items() if x} for c in weights]
        found = searched(blocks, weights, first_scores(blocks, weights, k), k)
        named = blocks.sparkSession.createDataFrame([(i, r.doc_id) for i, r in enumerate(some)], "item bigint, item_id bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
               .join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
        top = common.written(top) if batches > 1 else top
        out = top if out is None else out.unionByName(top)
    if out is None:
        return blocks.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
