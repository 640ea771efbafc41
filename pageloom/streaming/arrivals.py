"""Pages as a stream: quality counts by window of arrival, tolerant of late pages.

The batch engine has no streaming counterpart to match; this lets arriving
pages be watched with the same column functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_quality_counts(pages: DataFrame, window: str = "1 day", late: str = "90 days", garbled: float = 0.25) -> DataFrame:
    """(window_start, method, pages, garbled) of a stream of pages; a page delivered twice within the watermark counts once."""
    p = pages.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late)
    one = p.dropDuplicatesWithinWatermark(["page_id"])
    bad = T.garbled_ratio(F.coalesce("text", F.lit(""))) > garbled
    g = one.groupBy(F.window("ingested_at", window), F.coalesce("extraction_method", F.lit("none")).alias("method"))
    return g.agg(F.count("*").alias("pages"), F.count_if(bad).alias("garbled")).select(F.col("window.start").alias("window_start"), "method", "pages", "garbled")
