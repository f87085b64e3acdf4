"""The stream of files gives the matches of the batch query."""

from __future__ import annotations

from vellum.operators import search
from vellum.plans import grid
from vellum.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta {i}\nAlphabet soup", "en", "a", 5) for i in range(9)], ingest.SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    query = ingest.search_stream(ingest.stream_documents(spark, f"{tmp_path}/in", 1), "ALPHA", f"{tmp_path}/out", f"{tmp_path}/check")
    assert query.awaitTermination(120)
    key = lambda df: sorted(tuple(x) for x in df.select("doc_id", "page_index", "match_no", "start", "matched").collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(search.find(grid.chunks(docs), "alpha"))
