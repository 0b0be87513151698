"""Literal search with time range, and the block index that prunes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.functions.text import contains_text, query_tokens, since, tokens, until

BLOCK = ["segment", "block_seq"]


def matching(sessions: DataFrame, messages: DataFrame, key: str, message_key: str, query: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """Sessions with a message that holds the query, within the time range.

    Texts are only filtered, never gathered: a session of any length is met message by message.
    A session without messages never matches, not even the empty query.
    """
    hits = messages.where(contains_text(F.col("content"), query)).select(F.col(message_key).alias("_hit")).distinct()
    return sessions.where(since(F.col("created_at"), after) & until(F.col("created_at"), before)).join(hits, F.col(key) == F.col("_hit"), "left_semi")


def block_index(sessions: DataFrame, messages: DataFrame, key: str, message_key: str) -> DataFrame:
    """One row for each block: ids, counts, time range (unbounded if any session is undated), bytes."""
    said = messages.groupBy(F.col(message_key).alias("_k")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).alias("bytes"))
    rows = sessions.join(said, sessions[key] == said["_k"], "left")
    undated = F.count("*") > F.count("created_at")
    return rows.groupBy(*BLOCK).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("i")))), lambda x: x["i"]).alias("session_ids"),
        F.count("*").alias("session_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"),
        F.when(undated, F.lit(0)).otherwise(F.min("created_at")).alias("min_time"),
        F.when(~undated, F.max("created_at")).alias("max_time"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("uncompressed_bytes"),
    )


def token_index(sessions: DataFrame, messages: DataFrame, key: str, message_key: str) -> DataFrame:
    """Distinct (token, segment, block_seq): the words of a block's messages and its joined ids."""
    place = sessions.select(*BLOCK, F.col(key).alias("_k"))
    said = messages.where("content is not null").select(F.col(message_key).alias("_k"), F.explode(tokens(F.col("content"))).alias("token")).distinct()
    words = said.join(place, "_k").select("token", *BLOCK)
    return words.unionByName(_joined_ids(sessions)).distinct()


def stored_token_index(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The same of stored tables, whose messages bear their block: no join, and a task sends a word of a block once."""
    words = messages.where("content is not null").select(F.explode(tokens(F.col("content"))).alias("token"), *BLOCK)
    return words.unionByName(_joined_ids(sessions)).distinct()


def _joined_ids(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(*BLOCK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("i")))), lambda x: x["i"]), ",").alias("token")).select("token", *BLOCK)


def gated_blocks(token_index: DataFrame, query: str) -> DataFrame | None:
    """Blocks that hold every word of the query; None if it has no words and every block passes."""
    words = query_tokens(query)
    if not words:
        return None
    held = token_index.where(F.col("token").isin(words)).distinct()
    return held.groupBy(*BLOCK).agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select(*BLOCK)


def overlapping_blocks(index: DataFrame, after: int | None = None, before: int | None = None) -> DataFrame:
    """Blocks whose time range meets the one asked for."""
    out = index
    if after is not None:
        out = out.where(F.col("max_time").isNull() | (F.col("max_time") >= after))
    if before is not None:
        out = out.where(F.col("min_time") <= before)
    return out


def surviving_blocks(index: DataFrame, token_index: DataFrame, query: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """Indexed blocks that have to be read for a query: cheap time test first, then the words."""
    out = overlapping_blocks(index, after, before).select(*BLOCK)
    gate = gated_blocks(token_index, query)
    return out if gate is None else out.join(gate, BLOCK, "left_semi")


def search_indexed(sessions: DataFrame, messages: DataFrame, index: DataFrame, token_index: DataFrame, key: str, message_key: str, query: str, after: int | None = None, before: int | None = None) -> DataFrame:
    """Search that reads only surviving blocks, and blocks the index doesn't know; what is read is verified."""
    read = surviving_blocks(index, token_index, query, after, before).withColumn("_read", F.lit(True))
    known = index.select(*BLOCK).distinct().withColumn("_known", F.lit(True))
    kept = sessions.join(known, BLOCK, "left").join(read, BLOCK, "left").where("_known is null or _read").drop("_known", "_read")
    wanted = messages.join(kept.select(F.col(key).alias(message_key)).distinct(), message_key, "left_semi")
    return matching(kept, wanted, key, message_key, query, after, before)
