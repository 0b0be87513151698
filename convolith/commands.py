"""What the command line and the RPC server share: taking in documents, rendering sessions."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from convolith.archive import Archive
from convolith.sources import export_tree, ingest


def take_in(archive: Archive, value: object) -> tuple[str, int]:
    """Store a document as what it is; (kind, number of sessions)."""
    kind, found = ingest.detect(value)
    spark = archive.spark
    if kind == "session":
        archive.append_pending(ingest.session_frame(spark, found))
    elif kind == "export" and found:
        rows = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(found)], "ord long, json string")
        archive.append_bulk(export_tree.export_sessions(rows, "json"))
    elif found:
        archive.append_bulk(ingest.session_frame(spark, found))
    return kind, len(found)


def as_json(row: Row) -> dict:
    """A session with its messages as the archive stores it, for JSON output."""
    keep = ("id", "title", "source", "model", "created_at", "metadata_json", "messages")
    out = {k: row[k] for k in keep}
    out["created_at"] = None if row["created_at"] is None else int(row["created_at"])
    out["messages"] = [m.asDict(recursive=True) for m in row["messages"]]
    return out


def when(seconds: int) -> str:
    try:
        return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")
    except (OverflowError, ValueError, OSError):
        return str(seconds)


def preview(text: str | None, size: int = 60) -> str:
    text = text or ""
    return text[:size] + "..." if len(text.encode()) > size else text


def listing(archive: Archive, chosen: DataFrame) -> list[str]:
    """id and title, number of messages and a preview of the first, in the order of ``chosen``."""
    rows = {r["id"]: r for r in archive.nested(chosen).select("id", "title", F.size("messages").alias("n"), F.get(F.transform("messages", lambda m: m["content"]), F.lit(0)).alias("first")).collect()}
    out = []
    for r in chosen.select("id").collect():
        s = rows[r["id"]]
        out.append(f"[{s['id']}] {s['title'] if s['title'] is not None else 'Untitled'}")
        out.append(f"  Messages: {s['n']}")
        if s["n"]:
            out.append(f"  Preview: {preview(s['first'])}")
        out.append("")
    return out
