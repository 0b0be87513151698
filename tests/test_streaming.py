from __future__ import annotations

import pytest
from convolith.archive import Archive
from convolith.operators import events as E
from convolith.schema import EVENT
from convolith.sources import ingest as I
from convolith.streaming import sessionizer as S


def log(spark, *rows):
    out = [I.event({"type": t, "session_id": s, **({"message": {"role": "user", "content": c}} if t == "message" else {})}) for t, s, c in rows]
    return I.event_frame(spark, out)


ROWS = [("message", "a", "orphan"), ("session_start", "a", None), ("message", "a", "1"), ("session_start", "b", None), ("message", "b", "x"), ("finalize", "c", None), ("session_start", "a", None), ("message", "a", "2"), ("finalize", "a", None), ("message", "a", "3"), ("session_start", "d", None), ("finalize", "d", None)]


@pytest.mark.parametrize("cuts", [[12], [3, 9, 12], list(range(1, 13))])
def test_stream_equals_batch(spark, tmp_path, cuts):
    df = log(spark, *ROWS)
    for a, b in zip([0, *cuts], cuts):
        df.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = S.sessionized(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["session_id"], r["turn_no"], r["content"]) for r in spark.read.schema(S.FOLDED).parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3")}
    batch = {(r["session_id"], r["seq"]) for r in E.pending_messages(df).collect()}
    assert batch == {("a", 2), ("a", 7), ("a", 9)}
    assert {r["session_id"] for r in E.unfinished(df).collect()} == {"b"}
    assert {(r["session_id"], r["type"]) for r in E.orphans(df).collect()} == {("a", "message"), ("c", "finalize")}


def test_archive_stream_is_exactly_once(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "db"))
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    log(spark, *ROWS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(EVENT).parquet(source)
    S.archive_stream(stream, archive, checkpoint).awaitTermination()
    assert {r["id"] for r in archive.scan().collect()} == {"a", "d"}
    assert {r["session_id"] for r in archive.events().collect()} == {"b", "c"}
    log(spark, ("finalize", "b", None)).coalesce(1).write.mode("append").parquet(source)
    S.archive_stream(spark.readStream.schema(EVENT).parquet(source), archive, checkpoint).awaitTermination()
    assert sorted(r["id"] for r in archive.scan().collect()) == ["a", "b", "d"] and archive.stats()["session_count"] == 3
