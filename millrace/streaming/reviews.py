"""Structured Streaming over review events. An addition: state kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.findings import upsert_table


def distinct_events(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, value: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; late events within the watermark still count."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))


def latest_by_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key, for update or complete output."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e")).select("e.*")


def upserts(events: DataFrame, path: str, key: str, version: str, buckets: int = 64) -> DataStreamWriter:
    """A stream that keeps the table at path up to date, batch by batch; a batch that is replayed changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, _: upsert_table(batch.sparkSession, path, batch, key, version, buckets) and None)
