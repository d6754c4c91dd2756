"""Views over the driver's parquet tables (S4 and the fixture views).

Every view is a lazy DataFrame over ``{sf_dir}/{table}.parquet`` so column
pruning and filters reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sized_shuffles

# The deadlines (seconds) the reference sweeps.
DEADLINES = (20.0, 30.0, 45.0, 60.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_parts(spark: SparkSession, sf_dir: str, min_quantity: float | None) -> DataFrame:
    """(okey, parts): each order's distinct parts, ascending.  One shuffle on the
    order key; a part bought twice in one order is one vertex."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    sized_shuffles(spark, li.count())  # from the files' footers
    if min_quantity is not None:
        li = li.filter(F.col("l_quantity") >= F.lit(min_quantity))
    lines = li.select(F.col("l_orderkey").alias("okey"), F.col("l_partkey").alias("part"))
    return (lines.where("okey IS NOT NULL AND part IS NOT NULL").repartition("okey")
            .groupBy("okey").agg(F.sort_array(F.collect_set("part")).alias("parts")))


def _pairs(orders: DataFrame) -> DataFrame:
    """(graph_name, src, dst), distinct, src < dst: every two parts of an order,
    from (graph_name, parts)."""
    after = F.slice("parts", F.col("i") + 2, F.greatest(F.size("parts") - F.col("i") - 1, F.lit(0)))
    return (orders.where(F.size("parts") > 1).select("graph_name", F.posexplode("parts").alias("i", "src"), "parts")
            .select("graph_name", "src", F.explode(after).alias("dst")).distinct())


def copurchase_edges(spark: SparkSession, sf_dir: str, min_quantity: float | None = None,
                     graph_name: str = "copurchase") -> DataFrame:
    """Parts bought in the same order are adjacent.

    ``(graph_name, src, dst)`` with ``src < dst``, distinct; all lines, unless
    ``min_quantity`` asks for large ones only.  The pairs of an order are the
    view's definition: their number is the square of the order's lines, which
    the tables keep small (at most 7), so they are listed from the order's parts.
    """
    op = _order_parts(spark, sf_dir, min_quantity)
    return _pairs(op.select(F.lit(graph_name).alias("graph_name"), "parts"))


def copurchase_edges_multi(spark: SparkSession, sf_dir: str,
                           min_quantity: float | None = None) -> DataFrame:
    """Many graphs in one table: one co-purchase graph per order priority."""
    op = _order_parts(spark, sf_dir, min_quantity)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"), F.col("o_orderpriority").alias("graph_name"))
    return _pairs(op.join(orders, "okey"))


def customer_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One co-purchase graph per customer, named ``g<custkey>``.

    These are the graphs the ``runs`` view refers to (``g<user_id>``).
    """
    op = _order_parts(spark, sf_dir, None)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("okey"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("graph_name"))
    return _pairs(op.join(orders, "okey"))


def bipartite_edges(spark: SparkSession, sf_dir: str, graph_name: str = "cust_supp") -> DataFrame:
    """Customer -- supplier graph (triangle-free).  Supplier ids start at 0,
    so they map to ``-1 - suppkey`` to stay disjoint from customer ids."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return (j.select(F.lit(graph_name).alias("graph_name"),
                     F.col("o_custkey").alias("src"),
                     (F.lit(-1) - F.col("l_suppkey")).alias("dst"))
            .distinct())


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed runs table derived from ``events`` (key ``event_id``)."""
    return runs_from_events(table(spark, sf_dir, "events"))


def runs_from_events(ev: DataFrame) -> DataFrame:
    """Events -> runs (works on batch and streaming frames alike):
    graph ``g<user_id>``, algorithm = event type, runtime = value,
    nodes 1..8 by hour band, 4 cores per node, 8/12/16 GB per node."""
    k = F.regexp_extract(F.col("props"), r"(\d+)", 1).cast("bigint")
    num_nodes = (F.lit(1) + F.floor(F.hour("ts") / 3)).cast("int")
    mem = (F.lit(8) + F.lit(4) * (k % 3)).cast("int")
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("graph_name"),
        F.col("event_type").alias("algorithm_type"),
        F.col("value").alias("simulated_time"),
        num_nodes.alias("num_nodes"),
        F.lit(4).alias("cores_per_node"),
        mem.alias("memory_per_node_gb"),
    ).withColumns({
        "total_cores": F.col("num_nodes") * F.col("cores_per_node"),
        "total_memory_gb": F.col("num_nodes") * F.col("memory_per_node_gb"),
        "node_cost": F.col("num_nodes"),
    })


def deadlines(spark: SparkSession, values=DEADLINES) -> DataFrame:
    """The deadline dimension (a fixed handful of rows)."""
    return spark.createDataFrame([(float(d),) for d in values], "deadline double")


def run_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer co-purchase graphs, only for customers that appear as graphs
    in the ``runs`` view (``g<user_id>``).  The semi-join on the few run
    graphs is applied to ``orders`` before any pair is built."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    op = _order_parts(spark, sf_dir, None)
    orders = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .join(users, "o_custkey", "left_semi")
              .select(F.col("o_orderkey").alias("okey"),
                      F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("graph_name")))
    return _pairs(op.join(orders, "okey"))


# The three algorithms the reference sizes workloads for.
REFERENCE_ALGORITHMS = ("PageRank", "ConnectedComponents", "TriangleCounting")


def workloads(spark: SparkSession, sf_dir: str, algorithms=REFERENCE_ALGORITHMS) -> DataFrame:
    """Sizing-rule input: one part--supplier graph per order priority x
    return flag (edges = distinct (part, supplier) pairs, nodes = distinct
    parts + distinct suppliers), crossed with the algorithms."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    w = F.concat_ws("/", "o_orderpriority", "l_returnflag").alias("workload")
    g = j.groupBy(w).agg(
        F.count_distinct("l_partkey", "l_suppkey").alias("edges"),
        (F.count_distinct("l_partkey") + F.count_distinct("l_suppkey")).alias("graph_nodes"))
    n, m = F.col("graph_nodes"), F.col("edges")
    g = g.withColumn("density", F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(F.lit(0.0)))
    algos = spark.createDataFrame([(a,) for a in algorithms], "algorithm string")
    return g.crossJoin(F.broadcast(algos))
