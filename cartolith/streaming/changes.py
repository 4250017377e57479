"""Streams of file changes: collapsing per micro-batch, handlers of batches, windowed counts.

Sinks go through foreachBatch, and a batch's effect is idempotent by its number. Keyed state is in `state`, the index that
follows a change stream in `index`, the source of changes in `cartolith.sources.folder`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators import events

INTERVAL = "250 milliseconds"


def collapsed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Starts a query that collapses each micro-batch of changes and hands it to the sink."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: sink(events.collapse(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=INTERVAL)).start()


def by_type(batch: DataFrame) -> dict[str, DataFrame]:
    """A collapsed batch in parts: created, modified and deleted."""
    return {k: batch.filter(F.col("event_type") == k) for k in ("created", "modified", "deleted")}


def fan_out(handlers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A sink that gives each batch to all handlers; one that fails does not keep it from the others."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        failed = []
        try:
            for handler in handlers:
                try:
                    handler(batch, number)
                except Exception as e:
                    failed.append(e)
        finally:
            batch.unpersist()
        if failed:
            raise failed[0]

    return run


def windowed_counts(stream: DataFrame, at: str, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Event-time counts by type in tumbling windows, late rows accepted until the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))
