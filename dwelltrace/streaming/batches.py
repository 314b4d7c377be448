"""Exactly-once folders for micro-batches.

A streaming file sink leaves files of failed attempts in place and only lists the good
ones in its own metadata, which a recursive scan of a log root does not consult. So each
micro-batch is an ordinary batch write, whose commit protocol publishes whole results
only, into a folder named after the query and the batch. A replay after a failure
overwrites that folder. The query's identity lives in its checkpoint: a new checkpoint
starts new folders instead of overwriting old ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dwelltrace.plans.workspace import stream_settings


def batch_folder(batch: DataFrame, batch_id: int, root: str) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{root.rstrip('/')}/{query}/batch-{batch_id:012d}"


def start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], *, checkpoint: str, every_sec: float | None
) -> StreamingQuery:
    """Run ``write`` per micro-batch: every ``every_sec`` seconds, or once over what is there."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with stream_settings(stream.sparkSession):
        if every_sec is None:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{every_sec} seconds").start()


def flush_and_stop(query: StreamingQuery, start_once: Callable[[], StreamingQuery]) -> None:
    """End a periodic query without waiting for its next flush, and lose nothing.

    ``start_once`` starts the same job on the same checkpoint without a period. That run
    writes what has arrived since the last flush, the batch that stopping may have cut short
    included, and ends. What it fails to write stays due for the next start.
    """
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    start_once().awaitTermination()
