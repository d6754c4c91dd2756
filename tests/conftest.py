import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from capgraph.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="capgraph-tests")
    yield s


def edges_df(spark, pairs, graph="g"):
    rows = [(graph, int(a), int(b)) for a, b in pairs]
    return spark.createDataFrame(rows, "graph_name string, src bigint, dst bigint")


def multi_edges_df(spark, graphs: dict):
    rows = [(g, int(a), int(b)) for g, pairs in graphs.items() for a, b in pairs]
    return spark.createDataFrame(rows, "graph_name string, src bigint, dst bigint")
