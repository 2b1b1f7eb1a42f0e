"""Extension: a stream of changes, merged batch by batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import files
from ..operators.merge import merge_changes
from ..store import Store


def merge_stream(store: Store, name: str, changes: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply each micro-batch of a change stream as one commit. The commit holds
    the stream's id, which its checkpoint folder keeps, and the batch's number:
    a batch that comes again after a failure isn't applied twice, and other
    streams on the table have their own numbers."""

    def apply(batch: DataFrame, number: int) -> None:
        stream = json.loads(files.read_text(store.spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        merge_changes(store, name, batch, (stream, number))

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
