"""Token counts of whole texts.

Batch encoding in Arrow functions that return lengths only.  Arrow batches
are cut anew into batches of about equal bytes, and a long text is split at
safe boundaries, so that neither a batch of long texts nor one giant text
sets a task's memory.

Safe boundaries:

* a file that drops white space (``tokenizer.drops_space``): any ASCII white
  space, as no token or special string crosses it;
* any other file: none is proven safe for every pattern, so texts stay whole.
  A batch still closes at ``batch_bytes``.

Rows: one for each input row, repeated rows included; a null text counts as
empty (0 bytes, 0 tokens); a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, tokenizer

BATCH_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 16
SPACE = b" \t\n\r\x0b\x0c"


def segments(body: bytes, size: int) -> list[bytes]:
    """``body`` cut at white space into parts of ``size`` bytes or, where no
    white space comes in time, up to the next one."""
    parts, at, n = [], 0, len(body)
    while n - at > size:
        cut = max(body.rfind(bytes([c]), at, at + size) for c in SPACE)
        if cut < at:
            later = [i for c in SPACE if (i := body.find(bytes([c]), at + size)) >= 0]
            cut = min(later, default=n - 1)
        parts.append(body[at:cut + 1])
        at = cut + 1
    parts.append(body[at:])
    return parts


def balanced(pieces, batch_bytes: int):
    """(owner, bytes) pairs in lists of about ``batch_bytes`` bytes."""
    batch, size = [], 0
    for owner, body in pieces:
        if batch and size + len(body) > batch_bytes:
            yield batch
            batch, size = [], 0
        batch.append((owner, body))
        size += len(body)
    if batch:
        yield batch


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = BATCH_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of each row."""

    def count(batches):
        tok = tokenizer.load(path)
        cuttable = isinstance(tok, tokenizer.WordTokenizer)
        for b in batches:
            ids, bodies = b.column(0), b.column(1)
            sizes, totals = [], [0] * len(bodies)

            def pieces(bodies=bodies, sizes=sizes):
                for i, body in enumerate(bodies):
                    body = body.as_py()
                    sizes.append(len(body))
                    for part in segments(body, segment_bytes) if cuttable else [body]:
                        yield i, part

            for batch in balanced(pieces(), batch_bytes):
                for (i, _), n in zip(batch, tok.counts_of([part for _, part in batch])):
                    totals[i] += n
            n = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), n, pa.array([x > limit for x in totals], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.id_text(docs, id_col, text_col).mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), tokenizer.default_path(), limit=2048)
