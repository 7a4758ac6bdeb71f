"""Matching a stream of labels to a fixed collection of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from labelloom.operators import match as M
from labelloom.operators.index import Index
from labelloom.storage import ready


def match_stream(labels: DataFrame, index: Index, target: str, checkpoint: str, dates: DataFrame | None = None, **options) -> StreamingQuery:
    """Start writing matches of each micro-batch under ``target``.

    A batch is written to a folder of its own number in overwrite mode, so a batch
    repeated after a failure leaves its rows once.
    """
    ready(index.texts.sparkSession)

    def each(batch: DataFrame, number: int) -> None:
        M.match_events(batch, index, dates, **options).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return labels.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
