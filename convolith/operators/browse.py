"""Order, precedence, first, last, recent, list and show over sessions in insertion order.

Sessions carry ``src`` (0 pending, 1 archive) and ``ord`` (a struct that orders a source's rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolith.functions.text import display_title, preview


def archive_order() -> Column:
    return F.struct("segment", "block_seq", "pos")


def first_wins(df: DataFrame, id: str, *order: Column) -> DataFrame:
    """One row for each id, the first by ``order``; a window with a group limit, so hot ids are cut early."""
    w = Window.partitionBy(id).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_n(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The last n, oldest of them first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def recent_n(df: DataFrame, order: list[str], n: object = 10) -> DataFrame:
    """The last n, newest first; anything but a non-negative integer means 10."""
    count = n if isinstance(n, int) and not isinstance(n, bool) and n >= 0 else 10
    return df.orderBy(*[F.desc(c) for c in order]).limit(count)


def list_rows(sessions: DataFrame, messages: DataFrame, key: str, message_key: str) -> DataFrame:
    """id, title, message_count and the beginning of the first message."""
    said = messages.groupBy(F.col(message_key).alias("_k")).agg(F.count("*").alias("n"), F.min_by("content", "seq").alias("first"))
    joined = sessions.join(said, sessions[key] == said["_k"], "left")
    return joined.select(*[sessions[c] for c in sessions.columns if c != "title"], display_title(F.col("title")).alias("title"), F.coalesce("n", F.lit(0)).alias("message_count"), preview(F.col("first")).alias("preview"))
