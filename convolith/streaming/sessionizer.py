"""Sessions of an event stream: into the archive, or as rows of a stateful operator.

There is no event time in these events' meaning: a session is complete when its finalize arrives, so
no watermark is set and nothing is dropped for being late.  State that will never be needed can be
given up with a timeout, which is off unless asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convolith.archive import Archive
from convolith.schema import EVENT, EVENT_TYPES

FOLDED = "session_id string, turn_no long, seq long, role string, content string, metadata_json string"
_STATE = "started boolean, done boolean, emitted long, metadata_json string, held array<string>"


def read_stream(spark: SparkSession, path: str, schema=EVENT, format: str = "json", **options: str) -> DataFrame:
    """Events from files as they appear, of an explicit schema."""
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def sessionized(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """The messages of each session, numbered, once it is finalized.

    ``events`` has seq, type, session_id, message and metadata_json.  Kept per session: whether it has
    started and been finalized, how many messages were given out, and the messages that wait, one a list entry.
    Within a micro-batch events are taken by seq.  As in the fold of a whole log, messages count from the
    first start on; those after the finalize too, which are given out as they come, whatever the batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        started, done, emitted, metadata, held = state.get if state.exists else (False, False, 0, None, [])
        held = list(held)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, kind, role, content, data in zip(rows["seq"], rows["type"], rows["role"], rows["content"], rows["metadata_json"], strict=True):
            if kind == "session_start" and not started:
                started, metadata = True, data
            elif kind == "message" and started:
                held.append(json.dumps([int(seq), role, content]))
            elif kind == "finalize" and started:
                done = True
        if done and held:
            yield pd.DataFrame([(key[0], emitted + k + 1, *json.loads(m), metadata) for k, m in enumerate(held)], columns=["session_id", "turn_no", "seq", "role", "content", "metadata_json"])
            emitted, held = emitted + len(held), []
        if started:
            state.update((started, done, emitted, metadata, held))
            if timeout:
                state.setTimeoutDuration(timeout)

    flat = events.where(F.col("session_id").isNotNull() & F.col("type").isin(*EVENT_TYPES)).select("session_id", "seq", "type", F.col("message.role").alias("role"), F.col("message.content").alias("content"), "metadata_json")
    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return flat.groupBy("session_id").applyInPandasWithState(step, FOLDED, _STATE, "append", mode)


def archive_stream(events: DataFrame, archive: Archive, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Feed a stream of events into the archive; every micro-batch is logged, then flushed.

    The event log is the state: unfinished sessions wait there, orphans too.  A batch that is
    delivered again after a failure is known by its number and skipped, and flushing is idempotent by id, so each
    session is archived once.
    """

    def put(batch: DataFrame, number: int) -> None:
        with archive.lock():
            m = archive.manifest()
            if m.get("last_batch", {}).get(checkpoint, -1) >= number:
                return
            archive._append_events(m, batch.select(*EVENT.fieldNames()))
            m.setdefault("last_batch", {})[checkpoint] = number
            archive._commit(m)
            archive._flush()

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
