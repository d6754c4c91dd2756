"""File sources and sinks.

Edge-list files are whitespace-separated text with ``#`` comments and two
integer ids per line; many files are one scan whose graph name is the file
stem, and the part files of a graph (``name.part-00003.txt``) are one graph.
Lines that do not parse are not fatal: they go to a reject table, with their
file, line number and byte, and are counted per graph.

A line's place is (file, block, id): the block of the file that a task read it
in, and its number in the task, which only tells lines of one block apart.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The runs table schema (26 columns of the reference's CSV).
RUNS_SCHEMA = T.StructType([
    T.StructField("graph_name", T.StringType()),
    T.StructField("nodes", T.LongType()),
    T.StructField("edges", T.LongType()),
    T.StructField("density", T.DoubleType()),
    T.StructField("is_connected", T.BooleanType()),
    T.StructField("num_components", T.LongType()),
    T.StructField("avg_clustering", T.DoubleType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("actual_time", T.DoubleType()),
    T.StructField("simulated_time", T.DoubleType()),
    T.StructField("num_nodes", T.IntegerType()),
    T.StructField("cores_per_node", T.IntegerType()),
    T.StructField("memory_per_node_gb", T.IntegerType()),
    T.StructField("total_cores", T.IntegerType()),
    T.StructField("total_memory_gb", T.IntegerType()),
    T.StructField("num_iterations", T.IntegerType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("algorithm_category", T.StringType()),
    T.StructField("scaling_reason", T.StringType()),
    T.StructField("algorithm_type", T.StringType()),
    T.StructField("node_cost", T.IntegerType()),
    T.StructField("meets_deadline_20s", T.BooleanType()),
    T.StructField("meets_deadline_60s", T.BooleanType()),
    T.StructField("meets_deadline_30s", T.BooleanType()),
    T.StructField("meets_deadline_45s", T.BooleanType()),
    T.StructField("execution_category", T.StringType()),
])


def _parse(lines: DataFrame) -> DataFrame:
    """Text lines -> tokens; comment and blank lines are dropped."""
    body = F.trim(F.regexp_replace(F.col("value"), "#.*$", ""))
    toks = F.split(body, r"\s+")
    return (lines.withColumn("_body", body).filter(F.col("_body") != "")
            .withColumn("_t", toks)
            .withColumn("src", F.expr("try_cast(_t[0] AS BIGINT)"))
            .withColumn("dst", F.when(F.size("_t") >= 2, F.expr("try_cast(_t[1] AS BIGINT)"))))


#: What a file name has after the graph's name.
SUFFIX = r"(\.part-\d+)?\.[^.]*$"
PLACE = ["file", "block", "id"]


def read_edge_lists(spark: SparkSession, path: str, max_files: int | None = None,
                    places: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read one or many edge-list files (a file, folder or glob).

    Returns ``(edges, rejects)``: ``edges(graph_name, src, dst)``, with
    ``places`` also file, block and id; and ``rejects(graph_name, line)`` for lines
    without two integer ids, with ``places`` also file, line_number (from 1) and
    byte_offset (of lines that end in one byte).
    ``graph_name`` is the file name without its extension and part number.
    ``max_files`` keeps the first graphs by name.
    """
    raw = spark.read.text(path)
    if max_files is not None:
        # names are known from the listing: only the files kept are opened
        if "graph_name" in raw.columns:
            first = raw.select("graph_name").distinct().orderBy("graph_name").limit(max_files)
            raw = raw.where(F.col("graph_name").isin([r[0] for r in first.collect()]))
        else:
            raw = spark.read.text(_first_graphs(raw.inputFiles(), max_files))
    if "graph_name" not in raw.columns:
        # plain files: the graph is the file name without its extension
        # (a folder written by ``write_edge_list`` carries it as a partition)
        # file names come percent-encoded
        name = F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B"))
        raw = raw.withColumn("graph_name", F.regexp_replace(name, SUFFIX, ""))
    if places:
        raw = raw.select("graph_name", "value", F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    p = _parse(raw)
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull()
    edges = p.filter(ok).select("graph_name", "src", "dst", *(PLACE if places else []))
    rejects = p.filter(~ok).select("graph_name", F.col("value").alias("line"), *(PLACE if places else []))
    return edges, (_placed(raw, rejects) if places else rejects)


def _first_graphs(files, graphs: int) -> list[str]:
    """The files of the first graphs by name."""
    name = lambda f: re.sub(SUFFIX, "", unquote(f.rsplit("/", 1)[1]))
    kept = sorted({name(f) for f in files})[:graphs]
    return sorted(f for f in files if name(f) in kept)


def _placed(lines: DataFrame, rejects: DataFrame) -> DataFrame:
    """``rejects`` with their line numbers and byte offsets: what the blocks
    before hold, and what the block holds before the line."""
    size = F.octet_length("value") + 1
    # a block is a piece of a file that a task reads, 128 MB by default
    before = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.select(*PLACE, F.count(F.lit(1)).over(before).alias("n"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("bytes"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"),
                           F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes0"))
    return (rejects.join(inside, PLACE).join(starts, ["file", "block"])
            .select("graph_name", "line", "file", (F.col("n0") + F.col("n") + 1).alias("line_number"),
                    (F.col("bytes0") + F.col("bytes")).cast("bigint").alias("byte_offset")))


def first_k_vertices_by_file(edges: DataFrame, k: int, shards: int = 64) -> DataFrame:
    """The ``k`` vertices of each graph that its files name first.  ``edges``:
    read with ``places``.

    Two levels, like ``edges.first_k_vertices``: shards of a graph keep their
    own ``k`` first ones, so no task sorts a whole graph."""
    ends = edges.select("graph_name", F.posexplode(F.array("src", "dst")).alias("side", "vertex"), *PLACE)
    seen = ends.groupBy("graph_name", "vertex").agg(F.min(F.struct(*PLACE, "side")).alias("place"))

    def first(frame, *keys):
        w = Window.partitionBy("graph_name", *keys).orderBy("place")
        return frame.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)

    cut = seen.withColumn("_shard", F.pmod(F.xxhash64("vertex"), F.lit(shards)))
    return first(first(cut, "_shard").drop("_shard", "_rn")).select("graph_name", "vertex", F.col("_rn").alias("position"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """S3: rejected lines per graph."""
    return rejects.groupBy("graph_name").agg(F.count(F.lit(1)).alias("rejected_lines"))


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Write ``(src, dst)`` as whitespace text, one folder per graph name
    (``read_edge_lists`` on the folder gets the names back)."""
    (edges.select("graph_name", F.concat_ws(" ", F.col("src").cast("string"),
                                            F.col("dst").cast("string")).alias("value"))
     .write.mode("overwrite").partitionBy("graph_name").text(path))


def write_named_edge_lists(lines: DataFrame, path: str, order: list | None = None) -> None:
    """All graphs' ``lines`` (graph_name, value and what they are ordered by) as files
    ``{path}/{graph_name}.part-00000.txt``, ...: in parallel, a graph's parts in
    the order of their numbers.  ``order`` columns put a graph's lines in order
    over its parts; without it they lie as they come.

    The driver only renames files."""
    spark = lines.sparkSession
    held = f"{path}/_parts"
    if order:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartitionByRange(n, "graph_name", *order).sortWithinPartitions("graph_name", *order)
    lines.select("graph_name", "value").write.partitionBy("graph_name").text(held)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{held}/graph_name=*/part-*")):
        folder, file = s.getPath().getParent().getName(), s.getPath().getName()
        name = unquote(folder.split("=", 1)[1])
        fs.rename(s.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.part-{file.split('-')[1]}.txt"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(held), True)


def read_runs_csv(spark: SparkSession, path: str, schema: T.StructType = RUNS_SCHEMA) -> DataFrame:
    """The runs table from CSV with a header and an explicit schema (no
    inference pass over the data)."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite a result table (folder created) as parquet or CSV with a
    header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
