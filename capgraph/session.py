"""Session helpers: building a local session for tests/bench, resolving the
shared checkpoint folder, and cutting lineage inside iterative jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session we build uses.  On a cluster the caller owns the
# session; these are only the defaults for local runs.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "capgraph") -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("CAPGRAPH_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it on the context.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    filesystem path).  Only a local-mode session with the setting unset gets
    a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; iterative graph operators need "
                "a shared folder for reliable checkpoints on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="capgraph-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give this package's modules to the Python workers, which import it by
    name; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="capgraph-"), "capgraph_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SENT.add(app)


#: Rows of a table for each shuffle partition, about, and bytes up to which
#: adaptive execution merges partitions, once a table has more rows than that.
PARTITION_ROWS, MERGED_BYTES = 200_000, 8 << 20


def sized_shuffles(spark: SparkSession, rows: int) -> None:
    """Fit the session's shuffles to a table of ``rows`` rows, so that what one
    task holds doesn't grow with the table: raise the number of partitions, and
    keep adaptive execution from merging them to as few as there are cores.
    Settings that are finer already, and those for small tables, stay."""
    conf, wanted = spark.conf, -(-rows // PARTITION_ROWS)
    if wanted > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(wanted))
    if rows > 8 * PARTITION_ROWS:
        merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(merged))
        if now > MERGED_BYTES:
            conf.set(merged, str(MERGED_BYTES))


def shared_path(spark: SparkSession, prefix: str = "capgraph") -> str:
    """A new path in the shared checkpoint folder."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}_{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession):
    """For a write: its shuffle files go as soon as it is done, as all that is
    read later is written then; they would stay until the driver collects them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back with
    the same schema: for a frame that is read several times."""
    spark, path, schema = df.sparkSession, shared_path(df.sparkSession), df.schema
    with own_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours from the shared file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table of ``bucketed_table`` and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")


class Rounds:
    """The state of an iterative job: each round's frame is written to the
    shared folder and read back; writing a round deletes the last but one, so
    a run keeps two rounds however many it takes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path, schema = shared_path(self.spark, "round"), df.schema
        with own_shuffles(self.spark):
            df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            delete_path(self.spark, self.paths.pop(0))
        return self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        """Delete the rounds that are left, once the result is written."""
        while self.paths:
            delete_path(self.spark, self.paths.pop())


def bucketed_table(df: DataFrame, buckets: int, cols: list[str],
                   compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as an external table bucketed by ``cols`` under the
    checkpoint folder and read it back.

    For a big table joined on the same keys round after round: the bucket
    layout is known to the planner, so only the other side is shuffled, and
    the files survive executor loss.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    name = path.rsplit("/", 1)[1]
    with own_shuffles(spark):
        (df.write.bucketBy(buckets, *cols).option("path", path).option("compression", compression)
         .mode("overwrite").saveAsTable(name))
    return spark.table(name)
