"""First-of-key deduplication and counts of streams; the functions take batch tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Rows whose keys were not seen within the watermark; state is bounded by it.

    Of a stream the first to arrive stays; of a table the one of the least time, ties by the
    column `tie`, then by the rest of the row.
    """
    if not stream.isStreaming:
        others = [c for c in stream.columns if c not in keys]
        order = F.struct(time, *([tie] if tie else []), *(c for c in others if c not in (time, tie)))
        return stream.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_first")).select(*keys, "_first.*").select(*stream.columns)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, *by: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of each tumbling window and key."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
