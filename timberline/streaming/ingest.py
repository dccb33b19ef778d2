"""Continuous ingest: validate, commit, and only then advance the source."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.validation import validate_envelopes
from timberline.schema import MAX_LOGS_PER_BATCH
from timberline.sources.log_table import LogTable


def stream_ingest(
    envelopes: DataFrame,
    table: LogTable,
    checkpoint: str,
    max_logs: int = MAX_LOGS_PER_BATCH,
    interval: str | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """Start ingesting a stream of envelopes into the table.

    Validation is part of the streaming plan, so ``received_at`` is the micro-batch's stored clock: a
    replayed micro-batch judges and numbers its entries exactly as before and replaces its own folders.
    Rows of any age are kept. ``drain`` takes what is there and stops; ``interval`` sets the pace.
    Limits on the work per micro-batch belong to the source (``stream_envelopes(**limits)``).
    """
    base: Future[int] = Future()

    def write(validated: DataFrame, epoch: int) -> None:
        table.commit(validated, base.result() + epoch)

    writer = (
        validate_envelopes(envelopes, max_logs)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if drain:
        writer = writer.trigger(availableNow=True)
    elif interval is not None:
        writer = writer.trigger(processingTime=interval)
    query = writer.start()
    # The query's id lives in its checkpoint: a lost checkpoint means a new id and numbers of its own.
    try:
        first = table.writer_base(str(query.id))
        table.discard_uncommitted(first)
        base.set_result(first)
    except BaseException as e:
        base.set_exception(e)
        query.stop()
        raise
    return query


def stop_after_admitted(query: StreamingQuery) -> None:
    """Finish what the source already offers, then stop."""
    query.processAllAvailable()
    query.stop()
