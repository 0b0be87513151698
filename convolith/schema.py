"""Data types of the archive."""

from __future__ import annotations

from pyspark.sql import types as T

TOOL_CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("id", T.StringType())])
TOOL_OUTPUT = T.StructType([T.StructField("tool_call_id", T.StringType()), T.StructField("content", T.StringType())])
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("tool_outputs", T.ArrayType(TOOL_OUTPUT)),
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("metadata_json", T.StringType()),
    ]
)
#: Unix seconds of the full unsigned 64-bit range.
SECONDS = T.DecimalType(20, 0)
SESSION_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("created_at", SECONDS),
    T.StructField("metadata_json", T.StringType()),
]
SESSION = T.StructType([*SESSION_FIELDS, T.StructField("messages", T.ArrayType(MESSAGE))])
PLACE = [T.StructField("segment", T.IntegerType()), T.StructField("block_seq", T.LongType()), T.StructField("pos", T.IntegerType())]
#: The archive keeps sessions and messages in two tables that share their place, so that no session,
#: however long, has to be one row, and titles can be listed without reading texts.
ARCHIVE_SESSIONS = T.StructType([*PLACE, *SESSION_FIELDS, T.StructField("message_count", T.LongType())])
#: ``seq`` of a flushed message is its number in the event log.
ARCHIVE_MESSAGES = T.StructType([*PLACE, T.StructField("seq", T.LongType()), *MESSAGE.fields])
BLOCK_INDEX = T.StructType(
    [
        *PLACE[:2],
        T.StructField("session_ids", T.ArrayType(T.StringType())),
        T.StructField("session_count", T.LongType()),
        T.StructField("message_count", T.LongType()),
        T.StructField("min_time", SECONDS),
        T.StructField("max_time", SECONDS),
        T.StructField("compressed_bytes", T.LongType()),
        T.StructField("uncompressed_bytes", T.LongType()),
    ]
)
TOKEN_INDEX = T.StructType([T.StructField("token", T.StringType()), *PLACE[:2]])
EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("message", MESSAGE), T.StructField("metadata_json", T.StringType())])

ROLES = ("user", "system", "model", "thought", "tool")
ROLE_ALIASES = {"assistant": "model"}
EVENT_TYPES = ("session_start", "message", "finalize")
#: Metadata keys of a start event that become columns.
HOISTED = ("title", "source", "model", "created_at")
