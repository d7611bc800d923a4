"""Embedding backfill as a stream into a stored table.

New rows arrive as files; each micro-batch bands the rows that lack a vector (D19),
encodes them (U1) and appends all its rows, vectors filled, to the stored table as
one commit keyed by (writer, batch id): a repeated batch adds nothing, and several
streams or jobs may write the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.encoder import DEFAULT_DIM, embed_backfill
from ..sources.store import Store


def stream_embed(stream: DataFrame, table: str, base: str, checkpoint: str, dim: int = DEFAULT_DIM,
                 writer: str = "stream_embed", available_now: bool = True):
    """Start the job; `base` is the stored table that receives the rows."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        filled, _ = embed_backfill(batch, table, dim)
        Store(batch.sparkSession, base).append(filled, writer, batch_id)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
