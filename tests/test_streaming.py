"""Structured Streaming run analytics equal the batch operators."""
import tempfile

from capgraph.operators import runs as R
from capgraph.sources import tables as T
from capgraph.streaming import runs_stream as RS
from conftest import SF_SMALL


def test_stream_hit_rates_equal_batch(spark):
    s = RS.run_stream(spark, SF_SMALL, pattern="events.parquet")
    q = RS.start(RS.live_hit_rates(s, T.deadlines(spark)), "live_hits",
                 tempfile.mkdtemp(prefix="capgraph-stream-"))
    q.awaitTermination(120)
    live = spark.sql("SELECT * FROM live_hits")
    batch = R.deadline_hit_rates(T.runs(spark, SF_SMALL), T.deadlines(spark), by_algorithm=True)
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0


def test_stream_categories_equal_batch(spark):
    s = RS.run_stream(spark, SF_SMALL, pattern="events.parquet")
    q = RS.start(RS.live_categories(s), "live_cats", tempfile.mkdtemp(prefix="capgraph-stream-"))
    q.awaitTermination(120)
    live = spark.sql("SELECT * FROM live_cats")
    batch = RS.live_categories(T.runs(spark, SF_SMALL))
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
