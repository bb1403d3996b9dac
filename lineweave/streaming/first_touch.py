"""First touch of bins over a stream: each micro-batch's bins against the table of those already touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_bins(events: DataFrame, watermark: str, window: str) -> DataFrame:
    """(window, mode, bins): distinct bins by time window, approximately (streams have no exact distinct count), late rows beyond the watermark dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("window"), "mode").agg(F.approx_count_distinct("bin").alias("bins"))


def merge_first_touch(batch: DataFrame, touched: DataFrame) -> DataFrame:
    """(bin, ts, activity_id) after a batch, for foreachBatch: the earlier of both by (ts, activity_id). Idempotent, so a
    batch that is delivered twice changes nothing."""
    rows = batch.select("bin", "ts", "activity_id").unionByName(touched.select("bin", "ts", "activity_id"))
    return rows.groupBy("bin").agg(F.min(F.struct("ts", "activity_id")).alias("f")).select("bin", "f.ts", "f.activity_id")
