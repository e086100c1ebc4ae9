"""Structured Streaming forms of ingestion: change detection and duplicate filtering over a stream of pages, and windowed activity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators import incremental
from ..operators.store import Store


def detect_changes(pages: DataFrame, store: Store, checkpoint: str, on_batch: Callable[[DataFrame], None] = lambda df: None) -> StreamingQuery:
    """A stream of (url, html, text): each batch is compared with the stored pages, and what is new or changed is upserted.
    on_batch sees the changes before the pages are stored: a batch that stopped in between is found changed again, one that was stored is
    found unchanged, so nothing is lost and on_batch should bear a repeat."""

    def step(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["url"]).checkpoint()
        changed = incremental.changes(rows, store.read("pages")).filter("change <> 'unchanged'").checkpoint()
        on_batch(changed)
        store.upsert("pages", rows.join(changed.select("url", "content_hash"), "url").select("url", "html", F.col("text").alias("extracted_text"), "content_hash"))

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_text(pages: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose text was not seen within the watermark; state is bounded by it."""
    return pages.withColumn("content_hash", tx.content_hash(F.col("text"))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def activity(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and event type."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
