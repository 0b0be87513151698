"""Strict reading of sessions, arrays of sessions, tree exports and event streams.

What JSON may look like is decided on parsed values, before anything is typed: a number is no id, a
fraction no time, an unknown role no message.  The same checks serve a document on the driver and a
table of documents on the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.functions.text import is_blank
from convolith.operators.blocks import ranked
from convolith.schema import EVENT, EVENT_TYPES, ROLE_ALIASES, ROLES, SESSION

MOST_SECONDS = (1 << 64) - 1


class InvalidInput(ValueError):
    """The text isn't what it is read as."""


def _object(value: object, what: str) -> dict:
    if not isinstance(value, dict):
        raise InvalidInput(f"{what} must be an object")
    return value


def _text(value: object, what: str, needed: bool = False) -> str | None:
    if value is None and not needed:
        return None
    if not isinstance(value, str):
        raise InvalidInput(f"{what} must be a string")
    return value


def _items(value: object, what: str) -> list:
    if not isinstance(value, list):
        raise InvalidInput(f"{what} must be an array")
    return value


def _rest(value: dict, known: Iterable[str]) -> str:
    return json.dumps({k: v for k, v in value.items() if k not in known}, ensure_ascii=False, separators=(",", ":"))


def message(value: object) -> dict:
    m = _object(value, "message")
    role = ROLE_ALIASES.get(m.get("role"), m.get("role")) if isinstance(m.get("role"), str) else None
    if role not in ROLES:
        raise InvalidInput(f"unknown role {m.get('role')!r}")
    calls, outputs = m.get("tool_calls"), m.get("tool_outputs")
    return {
        "role": role,
        "content": _text(m.get("content"), "content", needed=True),
        "tool_calls": None if calls is None else [{"name": _text(_object(c, "tool call").get("name"), "name", True), "arguments": _text(c.get("arguments"), "arguments", True), "id": _text(c.get("id"), "id")} for c in _items(calls, "tool_calls")],
        "tool_outputs": None if outputs is None else [{"tool_call_id": _text(_object(o, "tool output").get("tool_call_id"), "tool_call_id"), "content": _text(o.get("content"), "content", True)} for o in _items(outputs, "tool_outputs")],
        "id": _text(m.get("id"), "id"),
        "parent_id": _text(m.get("parent_id"), "parent_id"),
        "metadata_json": _rest(m, ("role", "content", "tool_calls", "tool_outputs", "id", "parent_id")),
    }


def session(value: object) -> dict:
    """A session as stored; an id is made where there is none, unknown keys go to metadata_json."""
    s = _object(value, "session")
    at = s.get("created_at")
    if at is not None and (isinstance(at, bool) or not isinstance(at, int) or not 0 <= at <= MOST_SECONDS):
        raise InvalidInput("created_at must be unix seconds")
    return {
        "id": _text(s.get("id"), "id") if s.get("id") is not None else str(uuid.uuid4()),
        "title": _text(s.get("title"), "title"),
        "source": _text(s.get("source"), "source"),
        "model": _text(s.get("model"), "model"),
        "created_at": at,
        "metadata_json": _rest(s, ("id", "title", "source", "model", "created_at", "messages")),
        "messages": [message(m) for m in _items(s.get("messages", []), "messages")],
    }


def conversation(value: object) -> dict:
    """Check that a value is a conversation of a tree export; it is returned as it is."""
    c = _object(value, "conversation")
    _text(c.get("id"), "id", needed=True)
    _text(c.get("title"), "title")
    _text(c.get("current_node"), "current_node")
    for node in _object(c.get("mapping"), "mapping").values():
        _text(_object(node, "node").get("id"), "node id", needed=True)
        _text(node.get("parent"), "parent")
        m = node.get("message")
        if m is not None:
            _text(_object(m, "node message").get("id"), "message id", needed=True)
            _text(_object(m.get("author"), "author").get("role"), "author role", needed=True)
            content = _object(m.get("content"), "content")
            _text(content.get("content_type"), "content_type", needed=True)
            if content.get("parts") is not None:
                _items(content["parts"], "parts")
            _number(m.get("create_time"))
    _number(c.get("create_time"))
    return c


def _number(value: object) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
        raise InvalidInput("create_time must be a number")


def event(value: object) -> dict:
    """An event of a stream: type, session_id, message, metadata_json."""
    e = _object(value, "event")
    if e.get("type") not in EVENT_TYPES:
        raise InvalidInput(f"unknown event type {e.get('type')!r}")
    out = {"type": e["type"], "session_id": _text(e.get("session_id"), "session_id", needed=True), "message": None, "metadata_json": None}
    if e["type"] == "message":
        out["message"] = message(e.get("message"))
    elif e["type"] == "session_start":
        out["metadata_json"] = _rest(e, ("type", "session_id"))
    return out


def detect(value: object) -> tuple[str, list[dict]]:
    """What a document is, in this order: a session, a tree export, an array of sessions.

    Any object with well-typed known keys is a session, ``{}`` too.  An empty array is an empty export.
    """
    if isinstance(value, dict):
        return "session", [session(value)]
    if isinstance(value, list):
        try:
            return "export", [conversation(c) for c in value]
        except InvalidInput:
            return "sessions", [session(s) for s in value]
    raise InvalidInput("neither a session, nor a tree export, nor an array of sessions")


def parse(text: str) -> object:
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise InvalidInput(f"invalid JSON: {e}") from None


def events_of_lines(lines: Iterable[str]) -> Iterator[dict]:
    """Events of newline-delimited JSON; blank lines are skipped, a bad line ends the reading."""
    for line in lines:
        if line.strip():
            yield event(parse(line))


def session_frame(spark: SparkSession, sessions: list[dict]) -> DataFrame:
    """A few sessions as a frame with their order, ``ord``."""
    from decimal import Decimal

    rows = [(k, *[Decimal(s[f]) if f == "created_at" and s[f] is not None else s[f] for f in SESSION.fieldNames()]) for k, s in enumerate(sessions)]
    schema = "ord long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SESSION.fields)
    return spark.createDataFrame(rows, schema)


def event_frame(spark: SparkSession, events: list[dict], first_seq: int = 0) -> DataFrame:
    rows = [(first_seq + k, e["type"], e["session_id"], e["message"], e["metadata_json"]) for k, e in enumerate(events)]
    return spark.createDataFrame(rows, EVENT)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A batch of NDJSON events from files, checked on the executors, with seq in the order of the lines.

    Files count in the order of their names.  Blank lines are skipped; a bad line ends the reading.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(~is_blank(F.col("value")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [event(parse(x)) for x in pdf["value"]]
            yield pdf[["file", "block", "line"]].assign(**{k: [e[k] for e in read] for k in ("type", "session_id", "message", "metadata_json")})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields if f.name != "seq")
    rows = ranked(lines.mapInPandas(run, f"file string, block long, line long, {fields}"), ["file", "block", "line"])
    return rows.select((F.col("rn") - 1).alias("seq"), "type", "session_id", "message", "metadata_json")


def read_sessions(df: DataFrame, json_column: str) -> DataFrame:
    """Sessions of a table of JSON documents, one a row, with their messages; other columns are kept.

    The checks are those of ``session``, made on the executors; a document that is no session ends the reading.
    """
    keep = [c for c in df.columns if c != json_column]
    names = SESSION.fieldNames()
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{f.name} {'string' if f.name == 'created_at' else f.dataType.simpleString()}" for f in SESSION.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [session(parse(x if x is not None else "null")) for x in pdf[json_column]]
            out = {n: [s[n] if n != "created_at" or s[n] is None else str(s[n]) for s in read] for n in names}
            yield pdf[keep].assign(**out)[[*keep, *names]]

    return df.select(*keep, json_column).mapInPandas(run, ", ".join(kinds)).withColumn("created_at", F.col("created_at").cast("decimal(20,0)"))


def checked_sessions(df: DataFrame, json_column: str) -> DataFrame:
    """Sessions of a table of JSON documents, one a row, checked on the executors.

    Adds a column ``problem``: null where the document is a session, else why it isn't.
    """
    keep = [c for c in df.columns if c != json_column]
    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in keep], *[f"session_{f.name} {f.dataType.simpleString()}" for f in SESSION.fields if f.name not in ("messages", "created_at")], "session_created_at string", "message_count long", "problem string"])
    names = [f.name for f in SESSION.fields if f.name not in ("messages", "created_at")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf[keep + [json_column]].itertuples(index=False):
                *kept, text = row
                try:
                    s = session(parse(text if text is not None else "null"))
                    out.append((*kept, *[s[n] for n in names], None if s["created_at"] is None else str(s["created_at"]), len(s["messages"]), None))
                except InvalidInput as e:
                    out.append((*kept, *[None] * len(names), None, None, str(e)))
            yield pd.DataFrame(out, columns=[*keep, *[f"session_{n}" for n in names], "session_created_at", "message_count", "problem"])

    return df.mapInPandas(run, schema).withColumn("session_created_at", F.col("session_created_at").cast("decimal(20,0)"))
