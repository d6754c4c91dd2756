"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from ..session import ensure_checkpoint_dir, send_package, written  # noqa: F401  (operators use common.written)


def prepare(spark: SparkSession) -> None:
    """What every query of this subpackage needs of a session."""
    ensure_checkpoint_dir(spark)
    send_package(spark)


#: What Python workers keep between tasks, by the operator that needs it.
_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    return _CACHES.setdefault(owner, {})


def begin(owner: str | None = None) -> None:
    """Called where a task's Python code starts: a worker that served another
    operator before lets go of that one's caches, so several operators run in
    the memory of one."""
    for name, held in _CACHES.items():
        if name != owner and held:
            held.clear()
            release()


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id bigint, body binary); a
    null text is an empty one.  All other columns are left behind here, so
    none of them can clash with the operator's own."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


def remainder_of_id(col, by: int):
    """crc32(doc_id as text) mod ``by``; null where the id is null."""
    return F.crc32(col.cast("string").cast("binary")) % by


def rows_where(docs: DataFrame, make, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, for whose UTF-8 text (null:
    empty) the test that ``make()`` builds in each task holds."""

    def run(batches):
        begin()
        test = make()
        for b in batches:
            texts = b.column(text_col).cast(pa.binary())
            yield b.filter(pa.array([test(x.as_py() or b"") for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def runs_of(bodies, size: int):
    """``bodies`` in order, in lists of about ``size`` bytes."""
    held, n = [], 0
    for body in bodies:
        held.append(body)
        n += len(body)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def nullable(kind: DataType) -> DataType:
    """``kind`` with nulls allowed everywhere, as Arrow tasks give it back."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, MapType):
        return MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def free_name(wanted: str, columns) -> str:
    """``wanted``, lengthened until it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_fields(schema: StructType, **types) -> StructType:
    """A copy of ``schema`` with more nullable fields."""
    return StructType([*schema.fields, *(StructField(n, t, True) for n, t in types.items())])
