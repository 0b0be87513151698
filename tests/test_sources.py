from __future__ import annotations

import json
import re

import pytest
from convolith.functions import metadata, text
from convolith.operators import search
from convolith.sources import export_tree as X
from convolith.sources import ingest as I
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_sessions_are_read_strictly():
    s = I.session({})
    assert re.fullmatch(r"[0-9a-f-]{36}", s["id"]) and s["messages"] == [] and s["metadata_json"] == "{}"
    s = I.session({"id": "a", "created_at": 2**64 - 1, "metadata": {}, "messages": [{"role": "assistant", "content": "", "timestamp": 1, "tool_calls": []}]})
    assert s["messages"][0]["role"] == "model" and json.loads(s["messages"][0]["metadata_json"]) == {"timestamp": 1}
    assert s["messages"][0]["tool_calls"] == [] and s["messages"][0]["tool_outputs"] is None and json.loads(s["metadata_json"]) == {"metadata": {}}
    bad = [{"id": 5}, {"created_at": -1}, {"created_at": 1.5}, {"created_at": True}, {"title": 5}, {"messages": None}, {"messages": [{"role": "human", "content": ""}]}, {"messages": [{"role": "user"}]}, [], None, "x"]
    for b in bad:
        with pytest.raises(I.InvalidInput):
            I.session(b)


def test_detection_in_order():
    tree = {"id": "c", "mapping": {}}
    assert I.detect({})[0] == "session" and I.detect(tree)[0] == "session"
    assert I.detect([tree])[0] == "export" and I.detect([])[0] == "export"
    assert I.detect([tree, {"id": "s"}])[0] == "sessions"
    for b in (5, "x", [5], {"id": 5}):
        with pytest.raises(I.InvalidInput):
            I.detect(b)
    assert len(list(I.events_of_lines(["", ' {"type": "finalize", "session_id": "a"} ', "\n"]))) == 1
    with pytest.raises(I.InvalidInput):
        list(I.events_of_lines(['{"type": "chunk", "session_id": "a"}']))


def node(id, parent, parts, role="user"):
    return {"id": id, "parent": parent, "message": None if parts is None else {"id": "m" + id, "author": {"role": role}, "content": {"content_type": "text", "parts": parts}}}


def test_tree_walk(spark):
    chain = {str(k): node(str(k), str(k - 1) if k else None, [f"t{k}"]) for k in range(300)}
    docs = [
        {"id": "chain", "mapping": chain, "current_node": "299", "create_time": 7.9},
        {"id": "cycle", "mapping": {"a": node("a", "b", ["x"]), "b": node("b", "a", ["y"])}, "current_node": "a"},
        {"id": "empty", "mapping": {}, "current_node": None},
        {"id": "side", "mapping": {"r": node("r", "gone", None), "a": node("a", "r", ["one ", {"o": 1}, "two"], "assistant"), "b": node("b", "r", ["lost"]), "c": node("c", "a", [""]), "d": node("d", "c", ["end"], "robot")}, "current_node": "d"},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    got = {r["id"]: r for r in X.export_sessions(df, "j").collect()}
    assert [m["content"] for m in got["chain"]["messages"]] == [f"t{k}" for k in range(300)] and got["chain"]["created_at"] == 7
    assert len(got["cycle"]["messages"]) == 2 and got["empty"]["messages"] == []
    assert [(m["role"], m["content"], m["parent_id"]) for m in got["side"]["messages"]] == [("model", "one two", "r"), ("user", "end", "c")]


def test_dates():
    assert text.parse_when("20240101") == 20240101 and text.parse_when("2024-01-01") == 1704067200 and text.parse_when("1960-01-01") == 0
    for bad in ("", "soon", "2024-13-01", "-5", str(2**64)):
        with pytest.raises(ValueError):
            text.parse_when(bad)


def test_typed_metadata(spark):
    df = spark.createDataFrame([('{"title": 5, "source": "s", "created_at": "7", "k": [1]}',), ('{"title": "t", "created_at": 18446744073709551615}',), ('{"created_at": 1.5}',), (None,), ("{bad",)], "m string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in metadata.hoist(F.col("m")).items()]).collect()]
    assert got == [(None, "s", None, None), ("t", None, None, 2**64 - 1), (None,) * 4, (None,) * 4, (None,) * 4]


@given(st.text(alphabet=st.sampled_from("aB.,- \t\nß9"), max_size=30))
@settings(max_examples=100, deadline=None)
def test_query_tokens(q):
    words = [w for w in (re.sub(r"^[^\w]+|[^\w]+$", "", x) for x in q.lower().split()) if w]
    assert text.query_tokens(q) == list(dict.fromkeys(words))


def test_gate_is_between(spark):
    """What the words of a block let through is a part of what the literal text finds."""
    texts = ["the stream is open", "streaming now", "a (stream) of words", "", None, "Up-stream side"]
    sessions = spark.createDataFrame([(1, b, p, f"s{b}{p}", None) for b in range(3) for p in range(2)], "segment int, block_seq long, pos int, id string, created_at long")
    messages = spark.createDataFrame([(f"s{k // 2}{k % 2}", t, k) for k, t in enumerate(texts)], "session_id string, content string, seq int")
    index, words = search.block_index(sessions, messages, "id", "session_id"), search.token_index(sessions, messages, "id", "session_id")
    for q in ("stream", "Stream is", "streaming", "up-stream", "", "..."):
        literal = {r["id"] for r in search.matching(sessions, messages, "id", "session_id", q).collect()}
        gated = {r["id"] for r in search.search_indexed(sessions, messages, index, words, "id", "session_id", q).collect()}
        assert gated <= literal
        none = search.search_indexed(sessions, messages, index.limit(0), words, "id", "session_id", q)
        assert {r["id"] for r in none.collect()} == literal
    assert {r["id"] for r in search.search_indexed(sessions, messages, index, words, "id", "session_id", "stream").collect()} == {"s00", "s01", "s10"}
