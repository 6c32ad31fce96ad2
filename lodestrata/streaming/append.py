"""Appending to an archive from a stream: each micro-batch is a batch, with duplicates looked for within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import archive


def append_stream(entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch of a streaming frame of entries with bodies. Empty ones add nothing. A micro-batch that is
    given again, since the stream ended before it was noted as done, is known by its checkpoint and number and added
    once."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            archive.append(batch, path, token=f"{checkpoint}#{number}")

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
