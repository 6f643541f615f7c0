"""Searches for a stream of query vectors.

Each micro-batch of queries is searched as a table is, by any function from
queries to results, such as a search of an index; its results go to a folder of
their own, overwritten if the batch is repeated after a failure, so that every
query is answered once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Start answering a stream of queries into path; with available_now it ends when all that is there is answered."""
    if not queries.isStreaming:
        raise ValueError("queries are no stream")

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All results so far, with the number of their batch."""
    return spark.read.parquet(path)
