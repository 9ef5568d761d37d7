"""Search over a stream of documents: one row is one document, so each micro-batch is searched by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrid.operators.texts import search


def search_stream(documents: DataFrame, queries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes hits of a stream (doc_id, text) to Parquet below `path`, a folder for each batch, which a repeated batch replaces."""

    def batch(rows: DataFrame, number: int) -> None:
        search(rows, queries).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
