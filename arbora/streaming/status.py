"""Latest document status from a stream of status events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions import fixed_values as V
from arbora.operators.catalog import gateway_status


def status_stream(events: DataFrame) -> DataFrame:
    """Streaming twin of ``latest_status``: one row of state per document.

    Run in update mode.  The state is the newest event of each document, so it
    is bounded by the number of documents; a late event loses by its time stamp.
    ``events.ts`` must be a TIMESTAMP.
    """
    newest = F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "event_id"))
    state = events.groupBy("document_id").agg(newest.alias("last"))
    status = gateway_status(F.col("last.status"))
    return state.select(
        "document_id",
        status.alias("ingestion_status"),
        F.col("last.error").alias("ingestion_error"),
        F.when(status.isin(*V.TERMINAL_STATUSES), F.col("last.ts")).alias("ingestion_completed_at"),
    )

