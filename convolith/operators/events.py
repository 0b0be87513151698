"""The event log: folding starts, messages and finalizes into sessions, and what is left over.

An event counts only after the first start of its session, by ``seq``.  Everything is aggregation and
a join on the session, with map-side combine; messages are filtered, never gathered into a list, so
that a session with a third of all events folds like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolith.functions.metadata import hoist


def folded(events: DataFrame) -> DataFrame:
    """session_id, start_seq, end_seq (null: unfinished), metadata_json of each started session.

    The first start wins; a finalize before it is ignored; of several later ones the first gives the
    place in the order of finishing.
    """
    starts = events.where("type = 'session_start'").groupBy("session_id").agg(F.min("seq").alias("start_seq"), F.min_by("metadata_json", "seq").alias("metadata_json"))
    ends = events.where("type = 'finalize'").select("session_id", F.col("seq").alias("end"))
    ended = starts.select("session_id", "start_seq").join(ends, "session_id").where("end > start_seq").groupBy("session_id").agg(F.min("end").alias("end_seq"))
    return starts.join(ended, "session_id", "left")


def pending_sessions(events: DataFrame) -> DataFrame:
    """Finished sessions as session rows; title, source, model and time come from the start's metadata."""
    return as_sessions(folded(events).where("end_seq is not null"))


def as_sessions(done: DataFrame) -> DataFrame:
    """Rows of ``folded`` as session rows."""
    fields = hoist(F.col("metadata_json"))
    return done.select(F.col("session_id").alias("id"), *[c.alias(k) for k, c in fields.items()], F.coalesce("metadata_json", F.lit("{}")).alias("metadata_json"), "start_seq", "end_seq")


def pending_messages(events: DataFrame, finished_only: bool = True) -> DataFrame:
    """Messages after the start of their session, also those after its finalize, with their seq."""
    state = folded(events)
    if finished_only:
        state = state.where("end_seq is not null")
    said = events.where("type = 'message'").select("session_id", "seq", "message")
    return said.join(state.select("session_id", "start_seq"), "session_id").where("seq > start_seq").drop("start_seq")


def orphans(events: DataFrame) -> DataFrame:
    """Messages and finalizes whose session has not started before them."""
    starts = folded(events).select("session_id", "start_seq")
    rest = events.where("type <> 'session_start'")
    return rest.join(starts, "session_id", "left").where("start_seq is null or seq < start_seq").select(*events.columns)


def unfinished(events: DataFrame) -> DataFrame:
    return folded(events).where("end_seq is null")


def compacted(events: DataFrame, archived: DataFrame) -> DataFrame:
    """The events that stay in the log once the sessions ``archived`` (session_id) are stored."""
    return events.join(archived.select("session_id").distinct(), "session_id", "left_anti")


def to_archive(events: DataFrame, archive_ids: DataFrame) -> DataFrame:
    """Finished sessions that the archive (id) doesn't hold yet; flushing twice adds nothing."""
    return pending_sessions(events).join(archive_ids.select("id").distinct(), "id", "left_anti")
