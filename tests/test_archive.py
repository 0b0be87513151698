from __future__ import annotations

import io
import json
import random
from pathlib import Path

import pytest
from convolith import cli, rpc
from convolith.archive import Archive, DataMissing, IndexMissing, LockTimeout
from convolith.operators import blocks, search
from convolith.shared import shared_dir
from convolith.sources import ingest as I
from pyspark.sql import functions as F


def doc(id, n=2, at=7000, **extra):
    return {"id": id, "title": f"Chat on {id}", "created_at": at, "messages": [{"role": "user", "content": f"Line {k} in session {id}"} for k in range(n)], **extra}


def put(archive, *docs):
    return archive.append_bulk(I.session_frame(archive.spark, [I.session(d) for d in docs]))


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "db"))


def test_empty(archive):
    assert archive.stats() == {"file_name": "segment 1", "session_count": 0, "message_count": 0, "total_size_bytes": 0, "data_compressed_bytes": 0, "data_uncompressed_bytes": 0, "min_time": 0, "max_time": 0}
    assert archive.flush() == 0 and archive.optimise(1024) == (0, 0)
    with pytest.raises(DataMissing):
        archive.reindex()


def test_blocks_search_and_lookup(archive):
    put(archive, *[doc(f"s{k}", 1 + k % 3, 1000 + k) for k in range(101)], doc("early", 1, None), doc("early", 3, 5))
    assert archive.block_count() == 2
    s = archive.stats()
    assert s["session_count"] == 103 and s["message_count"] == sum(1 + k % 3 for k in range(101)) + 4
    assert ids(archive.search("SESSION S77")) == ["s77"] and ids(archive.search("nothing like it")) == []
    # word gate: "sess" is a part of a word only, so an indexed block is not read for it
    assert ids(archive.search("sess")) == [] and len(ids(archive.search("sess", mode="literal"))) == 102
    assert ids(archive.search("line", after=1099)) == ["s99", "s100", "early"]
    assert ids(archive.search("line", before=5)) == ["early"]
    row = archive.get("early").first()
    assert row["created_at"] is None and len(row["messages"]) == 1
    assert archive.get("missing").first() is None
    assert ids(archive.first(2)) == ["s0", "s1"] and ids(archive.last(2)) == ["s100", "early"] and ids(archive.recent(2)) == ["early", "s100"]
    assert len(ids(archive.recent(-1))) == 10


def test_log_flush_and_leftovers(archive, spark):
    def events(*rows):
        out = [I.event({"type": t, "session_id": s, **({"message": {"role": "user", "content": c}} if t == "message" else {"title": c} if c else {})}) for t, s, c in rows]
        archive.append_events(I.event_frame(spark, out))

    events(("message", "a", "orphan"), ("session_start", "a", "First"), ("message", "a", "one"), ("session_start", "a", "Second"))
    assert archive.flush() == 0
    events(("finalize", "a", None), ("message", "a", "two"), ("message", "b", "lost"), ("finalize", "b", None))
    assert ids(archive.search("ONE")) == ["a"]
    assert [m["content"] for m in archive.get("a").first()["messages"]] == ["one", "two"]
    assert archive.flush() == 1 and archive.flush() == 0
    row = archive.get("a").first()
    assert row["title"] == "First" and [m["content"] for m in row["messages"]] == ["one", "two"]
    assert {r["session_id"] for r in archive.events().collect()} == {"b"}
    events(("session_start", "a", "Again"), ("message", "a", "late"), ("finalize", "a", None))
    assert archive.flush() == 0 and archive.stats()["session_count"] == 1
    assert archive.manifest()["rejects"]


def test_index_missing_and_back(archive):
    put(archive, doc("x"), doc("y"))
    archive.drop_index()
    for call in (lambda: archive.search("x"), lambda: archive.get("x")):
        with pytest.raises(IndexMissing, match="reindex"):
            call()
    assert archive.scan().count() == 2 and archive.stats()["message_count"] == 4
    assert archive.reindex() == 2 and ids(archive.search("session x")) == ["x"]


def test_rotation_and_optimise(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "db"), segment_bytes=500)
    put(archive, *[doc(f"a{k}") for k in range(5)])
    put(archive, *[doc(f"b{k}", 2, None) for k in range(7)])
    assert archive.segments() == [1, 2]
    before = [(r["id"], r["message_count"]) for r in archive.scan().orderBy("segment", "block_seq", "pos").collect()]
    made, n = archive.optimise(30)
    assert n == 7 and made >= 2
    assert [(r["id"], r["message_count"]) for r in archive.scan().orderBy("segment", "block_seq", "pos").collect()] == before
    assert ids(archive.search("session b3")) == ["b3"] and archive.get("a1").first()["id"] == "a1"


def rotated(sizes, limit, used=0, first=1):
    """One block after the other: a new segment if the present one has reached its limit."""
    out, n, held = [], first, used
    for x in sizes:
        if held >= limit:
            n, held = n + 1, 0
        held += x
        out.append(n)
    return out


def test_rotation_block_by_block(spark):
    rng = random.Random(5)
    cases = [([900] * 6, 1000, 0), ([10] * 5, 1000, 995), ([5000, 1, 1, 5000, 0, 0, 3], 1000, 0), ([rng.choice([0, 1, 50, 400, 999, 1000, 2500]) for _ in range(300)], 1000, 700)]
    for sizes, limit, used in cases:
        df = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "block_no long, bytes long").repartition(5)
        got = blocks.segments(df, ["block_no"], F.col("bytes"), limit, used, 3).orderBy("block_no").collect()
        assert [r["segment_no"] for r in got] == rotated(sizes, limit, used, 3)
    assert rotated([900] * 6, 1000) == [1, 1, 2, 2, 3, 3]


def test_segments_stay_dense_after_a_nearly_full_one(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "db"), segment_bytes=500)
    put(archive, *[doc(f"a{k}", 2) for k in range(3)])
    held = archive.manifest()["segments"]["1"]["raw"]
    archive.segment_bytes = held + 10
    put(archive, *[doc(f"b{k}", 1) for k in range(350)])
    m = archive.manifest()["segments"]
    assert sorted(map(int, m)) == list(range(1, len(m) + 1)) and len(m) == 4
    assert archive.block_count() == 5 and archive.scan().count() == 353
    assert archive.get("b349").first()["title"] == "Chat on b349"
    places = {(r["segment"], r["block_seq"]) for r in archive.sessions().select("segment", "block_seq").distinct().collect()}
    assert places == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)}


def test_reads_only_what_the_index_names(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "db"), segment_bytes=5000)
    put(archive, *[doc(f"s{k}", 1) for k in range(250)])
    m = archive.manifest()
    where = archive.block_index(m).where(F.array_contains("session_ids", "s120")).select("segment", "block_seq")
    (messages,) = archive._within(m, where, ("messages",))
    plan = messages._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(block_seq" in plan or "EqualTo(block_seq" in plan
    assert messages.count() == 100 and len(messages.inputFiles()) < len(archive.messages(m).inputFiles())
    assert ids(archive.search("session s120")) == ["s120"]


def test_flush_writes_a_long_session_in_parts(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "db"))
    rows = [("session_start", None)] + [("message", f"part {k}") for k in range(12_000)] + [("finalize", None)]
    frame = spark.createDataFrame([(k, t, c) for k, (t, c) in enumerate(rows)], "seq long, type string, c string")
    message = F.when(F.col("c").isNotNull(), F.struct(F.lit("user").alias("role"), F.col("c").alias("content"), F.lit(None).cast("array<struct<name: string, arguments: string, id: string>>").alias("tool_calls"), F.lit(None).cast("array<struct<tool_call_id: string, content: string>>").alias("tool_outputs"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("{}").alias("metadata_json")))
    archive.append_events(frame.select("seq", "type", F.lit("hot").alias("session_id"), message.alias("message"), F.lit(None).cast("string").alias("metadata_json")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are written by one task
    try:
        assert archive.flush() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(archive.messages().inputFiles()) >= 2
    assert [m["content"] for m in archive.get("hot").first()["messages"]] == [f"part {k}" for k in range(12_000)]


def test_flush_takes_any_event_number_and_many_sessions(archive, spark, monkeypatch):
    monkeypatch.setattr(blocks, "FLUSH", 3, raising=False)
    frame = I.event_frame(spark, [I.event(e) for k in range(8) for e in ({"type": "session_start", "session_id": f"s{k}"}, *({"type": "message", "session_id": f"s{k}", "message": {"role": "user", "content": f"{k} {n}"}} for n in range(2)), {"type": "finalize", "session_id": f"s{k}"})])
    archive.append_events(frame.withColumn("seq", F.col("seq") + 3_000_000_000))
    assert archive.flush() == 8 and archive.flush() == 0
    assert archive.block_count() == 3 and ids(archive.first(8)) == [f"s{k}" for k in range(8)]
    assert all([m["content"] for m in archive.get(f"s{k}").first()["messages"]] == [f"{k} 0", f"{k} 1"] for k in (0, 7))
    assert archive.messages().agg(F.min("seq"), F.max("seq")).first()[:] == (3_000_000_001, 3_000_000_030)


def test_flush_leaves_the_rest_under_its_numbers(archive, spark):
    rows = [("session_start", "done"), ("session_start", "open"), ("message", "open"), ("message", "done"), ("finalize", "done"), ("message", "lost")]
    docs = [{"type": t, "session_id": s, **({"message": {"role": "user", "content": "text"}} if t == "message" else {})} for t, s in rows]
    archive.append_events(I.event_frame(spark, [I.event(d) for d in docs]).withColumn("seq", F.col("seq") + 3_000_000_000))
    assert archive.flush() == 1
    assert sorted(r["seq"] - 3_000_000_000 for r in archive.events().collect()) == [1, 2, 5]


def test_flush_parts_the_log_and_leaves_no_scratch(archive, spark):
    put(archive, doc("known", 1))
    rows = [("message", "done", "early"), ("session_start", "done", None), ("session_start", "known", None), ("message", "done", "kept"), ("session_start", "open", None), ("message", "known", "refused"), ("message", "open", "waits"), ("finalize", "done", None), ("finalize", "known", None), ("message", "done", "late"), ("message", "lost", "orphan")]
    docs = [{"type": t, "session_id": s, **({"message": {"role": "user", "content": c}} if c else {})} for t, s, c in rows]
    archive.append_events(I.event_frame(spark, [I.event(d) for d in docs]))

    def scratch():
        return {str(p) for p in Path(shared_dir(spark).removeprefix("file:"), "convolith").rglob("*.parquet")}

    before = scratch()
    assert archive.flush() == 1
    assert scratch() <= before
    assert [m["content"] for m in archive.get("done").first()["messages"]] == ["kept", "late"]
    assert sorted(r["seq"] for r in archive.events().collect()) == [4, 6, 10]
    refused = spark.read.parquet(*[f"{archive.root}/{r}" for r in archive.manifest()["rejects"]])
    assert sorted(r["seq"] for r in refused.collect()) == [2, 5, 8]
    keyed = archive.sessions().withColumn("k", F.struct("segment", "block_seq", "pos"))
    joined = search.token_index(keyed, archive.messages().select(F.struct("segment", "block_seq", "pos").alias("k"), "content"), "k", "k")
    assert sorted(map(tuple, archive.token_index().select(joined.columns).collect())) == sorted(map(tuple, joined.collect()))


def test_bad_manifest_and_lock(archive):
    put(archive, doc("x"))
    with archive.lock(), pytest.raises(LockTimeout):
        with archive.lock(0.1):
            pass
    archive._write_text("manifest.json", "garbage")
    with pytest.raises(RuntimeError, match="Invalid file format"):
        archive.scan()


def test_greedy_blocks_keep_order(spark):
    rows = [(1 + k // 20, k, ("word%d " % (k % 7)) * (20 + k)) for k in range(40)] + [(3, 99, None)]
    df = spark.createDataFrame(rows, "segment int, at int, text string")
    out = sorted((r["segment"], r["at"], r["block_no"]) for r in blocks.greedy_blocks(df, "segment", ["at"], "text", 200).collect())
    assert [(s, a) for s, a, _ in out] == [(s, a) for s, a, _ in rows]
    for s in (1, 2, 3):
        n = [b for x, _, b in out if x == s]
        assert n[0] == 0 and all(b - a in (0, 1) for a, b in zip(n, n[1:]))


def test_ranked(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("k"))
    got = blocks.ranked(df, ["k"], {"before": F.col("k")}).orderBy("k").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["k"]


def run(spark, db, *argv, stdin="", monkeypatch=None, capsys=None):
    monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    code = cli.main(["--db", str(db), *argv], spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    def call(*argv, stdin=""):
        return run(spark, tmp_path / "db", *argv, stdin=stdin, monkeypatch=monkeypatch, capsys=capsys)

    assert call("add", stdin="{bad")[0] == 1
    assert call("add", stdin=json.dumps([{"id": "x", "messages": [{"role": "clown", "content": ""}]}]))[0] == 1
    assert "saved" in call("add", stdin=json.dumps(doc("one", 2, 1700000000)))[1]
    tree = {"id": "t", "title": None, "create_time": 5.9, "current_node": "c", "mapping": {"a": {"id": "a", "parent": None}, "b": {"id": "b", "parent": "a", "message": {"id": "m1", "author": {"role": "user"}, "content": {"content_type": "text", "parts": ["Hi ", {"o": 1}, "there"]}}}, "c": {"id": "c", "parent": "b", "message": {"id": "m2", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["Hello"]}}}}}
    assert "1 conversations" in call("add", stdin=json.dumps([tree]))[1]
    lines = [{"type": "session_start", "session_id": "st", "title": "Live"}, {"type": "message", "session_id": "st", "message": {"role": "assistant", "content": "streamed"}}, {"type": "finalize", "session_id": "st"}]
    assert "Archived 2 sessions" in call("add", "--stream", stdin="\n\n".join(map(json.dumps, lines)))[1]
    assert call("search", "hello")[1].splitlines() == ["[t] Untitled"]
    assert call("search", "nope")[1] == "Nothing matches.\n"
    found = json.loads(call("search", "streamed", "--json")[1])
    assert found["title"] == "Live" and found["messages"][0]["role"] == "model"
    assert "[one]" in call("search", "session one", "--after", "2023-11-01")[1]
    assert call("search", "session one", "--before", "2023-01-01")[1] == "Nothing matches.\n"
    assert call("search", "x", "--after", "someday")[0] == 1
    shown = call("show", "t")[1]
    assert "[2] model\nHello" in shown and "Hi there" in shown
    assert "no session zzz" in call("show", "zzz")[1]
    assert "Sessions:        3" in call("stats")[1]
    assert "First 1, 3 in all" in call("first", "1")[1]
    assert "Nothing was changed." in call("optimise", stdin="n\n")[1]
    assert call("optimise", "--chunk-kb", "0", "--yes")[0] == 1
    assert "Reindexed 3 sessions" in call("reindex", "--yes")[1]


def test_rpc(spark, tmp_path):
    server = rpc.Server(Archive(spark, str(tmp_path / "db")))

    def ask(method, params=None, id=1):
        line = server.answer(json.dumps({"jsonrpc": "2.0", "method": method, "params": params, "id": id}))
        return None if line is None else json.loads(line)

    def tool(name, **args):
        r = ask("tools/call", {"name": name, "arguments": args})
        return r["error"]["code"] if "error" in r else r["result"]["content"][0]["text"]

    assert json.loads(server.answer("{nope"))["error"]["code"] == rpc.PARSE and server.answer("  ") is None
    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 5
    assert ask("ping", id=None) is None and ask("nope")["error"]["code"] == rpc.UNKNOWN
    assert ask("tools/call")["error"]["code"] == rpc.PARAMS and tool("nope") == rpc.UNKNOWN and tool("add_log") == rpc.PARAMS
    assert tool("add_log", data=json.dumps(doc("a"))) == "Session saved."
    assert tool("add_log", data=[doc("b"), doc("c", 1)]) == "Imported 2 sessions."
    assert tool("add_log", data="not json") == rpc.FAILED
    assert [s["id"] for s in json.loads(tool("search", query="session"))] == ["a", "b", "c"]
    assert json.loads(tool("read_session", id="b"))["messages"][1]["content"] == "Line 1 in session b"
    assert tool("read_session", id="zz") == rpc.FAILED
    assert [s["id"] for s in json.loads(tool("get_recent_sessions", count=2))] == ["a", "c"]
    assert json.loads(tool("stats"))["session_count"] == 3
