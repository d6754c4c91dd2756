"""File sources and sinks: edge lists, runs CSV, result tables, model files."""
import os
import tempfile

from pyspark.sql import functions as F

from capgraph.sources import files as S
from capgraph.sources import tables as T
from conftest import SF_SMALL

EDGE_TEXT = """# a comment line
1 2
2\t3   # trailing comment
3 one
4
1 3

"""


def _tmp():
    return tempfile.mkdtemp(prefix="capgraph-test-")


def test_edge_list_scan_and_rejects(spark):
    d = _tmp()
    with open(os.path.join(d, "toy.txt"), "w") as f:
        f.write(EDGE_TEXT)
    with open(os.path.join(d, "other.txt"), "w") as f:
        f.write("7 8\n8 9\n")
    edges, rejects = S.read_edge_lists(spark, os.path.join(d, "*.txt"))
    got = sorted((r["graph_name"], r["src"], r["dst"]) for r in edges.collect())
    assert got == [("other", 7, 8), ("other", 8, 9), ("toy", 1, 2), ("toy", 1, 3), ("toy", 2, 3)]
    rc = {r["graph_name"]: r["rejected_lines"] for r in S.reject_counts(rejects).collect()}
    assert rc == {"toy": 2}
    first, _ = S.read_edge_lists(spark, os.path.join(d, "*.txt"), max_files=1)
    assert {r["graph_name"] for r in first.collect()} == {"other"}


def test_edge_list_round_trip(spark):
    e = T.copurchase_edges(spark, SF_SMALL)
    d = _tmp()
    S.write_edge_list(e, os.path.join(d, "out"))
    back, rej = S.read_edge_lists(spark, os.path.join(d, "out", "*", "*.txt"))
    assert rej.count() == 0
    assert back.select("src", "dst").exceptAll(e.select("src", "dst")).count() == 0
    assert back.count() == e.count()


def test_runs_csv_and_table_round_trip(spark):
    runs = T.runs(spark, SF_SMALL)
    d = _tmp()
    S.write_table(runs, os.path.join(d, "runs_pq"))
    back = spark.read.parquet(os.path.join(d, "runs_pq"))
    assert back.exceptAll(runs).count() == 0 and back.count() == runs.count()
    S.write_table(runs, os.path.join(d, "runs_csv"), fmt="csv")
    schema = "run_id long, graph_name string, algorithm_type string, simulated_time double, " \
             "num_nodes int, cores_per_node int, memory_per_node_gb int, total_cores int, " \
             "total_memory_gb int, node_cost int"
    from pyspark.sql.types import _parse_datatype_string
    csv = S.read_runs_csv(spark, os.path.join(d, "runs_csv"), _parse_datatype_string(schema))
    assert csv.exceptAll(runs).count() == 0


def test_runs_view_shape(spark):
    r = T.runs(spark, SF_SMALL)
    row = r.agg(F.min("num_nodes"), F.max("num_nodes"), F.countDistinct("memory_per_node_gb")).first()
    assert row[0] >= 1 and row[1] <= 8 and row[2] == 3


def test_parts_are_one_graph_and_rejects_have_places(spark):
    d = _tmp()
    texts = {"toy.part-00000.txt": "1 2\n# é note\nbad line\n3 4\n", "toy.part-00001.txt": "x\n5 6\n\n7\n", "v1.2.txt": "9 8\n?"}
    for name, t in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")  # several blocks a file
    try:
        edges, rejects = S.read_edge_lists(spark, d, places=True)
        assert sorted((r.graph_name, r.src, r.dst) for r in edges.collect()) == [
            ("toy", 1, 2), ("toy", 3, 4), ("toy", 5, 6), ("v1.2", 9, 8)]
        for r in rejects.collect():
            lines = texts[r.file.rsplit("/", 1)[1]].split("\n")
            assert lines[r.line_number - 1] == r.line
            assert r.byte_offset == len("\n".join(lines[:r.line_number - 1]).encode()) + (r.line_number > 1)
        assert {r.graph_name: r.rejected_lines for r in S.reject_counts(rejects).collect()} == {"toy": 3, "v1.2": 1}
        first = [r.vertex for r in S.first_k_vertices_by_file(edges.where("graph_name = 'toy'"), 5).orderBy("position").collect()]
        assert first == [1, 2, 3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one, _ = S.read_edge_lists(spark, d, max_files=1)
    assert one.count() == 3


def test_named_graphs_are_written_in_parts_and_order(spark):
    d = _tmp()
    rows = [(g, f"{k} {k + 1}", k) for g in ("4-NOT SPECIFIED", "plain") for k in range(300)]
    df = spark.createDataFrame(rows, "graph_name string, value string, k int").repartition(5)
    S.write_named_edge_lists(df, os.path.join(d, "out"), ["k"])
    names = sorted(n for n in os.listdir(os.path.join(d, "out")) if not n.startswith((".", "_")))
    assert len(names) > 3 and all(".part-" in n for n in names if "=" not in n)
    edges, rejects = S.read_edge_lists(spark, os.path.join(d, "out"), places=True)
    assert rejects.count() == 0 and edges.where("graph_name = 'plain'").count() == 300
    first = S.first_k_vertices_by_file(edges, 4).where("graph_name = '4-NOT SPECIFIED'").orderBy("position").collect()
    assert [r.vertex for r in first] == [0, 1, 2, 3]


def test_shuffles_grow_with_the_table(spark):
    from capgraph.session import MERGED_BYTES, PARTITION_ROWS, sized_shuffles
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = [spark.conf.get(n) for n in names]
    try:
        sized_shuffles(spark, 3 * PARTITION_ROWS)
        assert [spark.conf.get(n) for n in names] == before
        sized_shuffles(spark, 100 * PARTITION_ROWS + 1)
        sized_shuffles(spark, 50 * PARTITION_ROWS)
        assert [spark.conf.get(n) for n in names] == ["101", str(MERGED_BYTES)]
    finally:
        spark.conf.set(names[0], before[0])
        spark.conf.unset(names[1])
