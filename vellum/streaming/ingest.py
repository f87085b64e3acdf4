"""Extension: documents that arrive as files become search hits as a stream, exactly once.

The grid needs a document's lines together, which one row holds, so no state crosses batches: each micro-batch runs the batch
operators and is written under its batch id; a batch that is run again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellum.operators import search
from vellum.plans import grid

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stream_documents(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def search_stream(documents: DataFrame, pattern: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Matches of every arriving document, as Parquet under out/batch=<id>; runs until what is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        search.find(grid.chunks(batch.select("doc_id", "text")), pattern, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
