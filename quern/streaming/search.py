"""Answers to queries that arrive as a stream, over a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.search import SearchOptions, search_batch


def answer(queries: DataFrame, index: Index, out: str, checkpoint: str, options: SearchOptions = SearchOptions(), *, once: bool = False) -> StreamingQuery:
    """Append the ranked documents of every arriving (qid, query) to Parquet under out.

    Each micro-batch is one batch search. A batch that runs again after a failure replaces
    its own folder, so results come once.
    """

    def run(batch: DataFrame, number: int) -> None:
        search_batch(index, batch, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
