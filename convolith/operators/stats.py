"""Archive statistics: from the block index without reading texts, or by scan where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_index(index: DataFrame) -> DataFrame:
    """Sums over blocks; unset times (0, or no upper bound) are ignored."""
    return index.agg(
        F.coalesce(F.sum("session_count"), F.lit(0)).alias("session_count"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"),
        F.coalesce(F.sum("uncompressed_bytes"), F.lit(0)).alias("data_uncompressed_bytes"),
        F.coalesce(F.min(F.when(F.col("min_time") > 0, F.col("min_time"))), F.lit(0)).alias("min_time"),
        F.coalesce(F.max("max_time"), F.lit(0)).alias("max_time"),
    )


def from_scan(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The same from the rows; only counts of messages are taken, no texts.  Copies of an id count each."""
    seconds = sessions.schema["created_at"].dataType
    none = F.lit(None).cast(seconds)
    rows = sessions.select(F.lit(1).alias("s"), F.lit(0).alias("m"), F.col("created_at").alias("t")).unionByName(messages.select(F.lit(0).alias("s"), F.lit(1).alias("m"), none.alias("t")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(total("s").alias("session_count"), F.coalesce(F.min(F.when(F.col("t") > 0, F.col("t"))), F.lit(0)).alias("min_time"), F.coalesce(F.max("t"), F.lit(0)).alias("max_time"), total("m").alias("message_count"))


def with_pending(archive: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending sessions are added without regard to copies in the archive."""
    both = archive.select("session_count", "message_count", "min_time", "max_time").unionByName(pending.select("session_count", "message_count", "min_time", "max_time"))
    return both.agg(F.sum("session_count").alias("session_count"), F.sum("message_count").alias("message_count"), F.coalesce(F.min(F.when(F.col("min_time") > 0, F.col("min_time"))), F.lit(0)).alias("min_time"), F.coalesce(F.max("max_time"), F.lit(0)).alias("max_time"))
