from __future__ import annotations

import itertools
import json

import numpy as np
from convolith.operators import schema_drift as S


def test_matching_against_all_permutations():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (2, 4), (4, 2), (5, 5)):
        w = rng.random((n, m))
        got = sum(w[i, j] for i, j in S.best_matching(w))
        small, large = (n, m) if n <= m else (m, n)
        a = w if n <= m else w.T
        best = max(sum(a[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(got - best) < 1e-9


def inputs(spark, files):
    """files: file_no -> list of (id, dict or text)"""
    data, n = [], 0
    for no, records in files.items():
        for id, m in records:
            n += 1
            data.append((n, "f", no, id, m if m is None or isinstance(m, str) else json.dumps(m), 5))
    return spark.createDataFrame(data, "input_no long, feed string, file_no int, id string, metadata string, key int")


def changes(df):
    return {tuple(r)[1:] for r in S.schema_changes(df).collect()}


def test_all_kinds_of_change(spark):
    one = [(f"r{i}", {"gitBranch": f"a/b{i}", "score": i, "flag": True, "tags": ["x", "y"]}) for i in range(8)]
    two = [(f"q{i}", {"branch": f"a/b{i}", "score": i + 0.5, "flag": True, "cost": 1.25}) for i in range(8)]
    assert changes(inputs(spark, {1: one, 3: two})) == {(3, "renamed", "gitBranch", "branch"), (3, "retyped", "score", "decimal"), (3, "removed", "tags", ""), (3, "added", "cost", "")}


def test_records_decide_a_rename(spark):
    one = [(f"r{i}", {"left": i % 2 == 0}) for i in range(10)]
    same = [(f"r{i}", {"right": i % 2 == 0}) for i in range(10)]
    other = [(f"r{i}", {"right": i % 2 == 1}) for i in range(10)]
    assert changes(inputs(spark, {1: one, 2: same})) == {(2, "renamed", "left", "right")}
    assert changes(inputs(spark, {1: one, 2: other})) == {(2, "removed", "left", ""), (2, "added", "right", "")}


def test_unlike_content_is_no_rename(spark):
    one = [(f"a{i}", {"version": f"1.{i}.0"}) for i in range(6)]
    two = [(f"b{i}", {"folder": f"north-{'xyz'[i % 3]} harbour"}) for i in range(6)]
    assert changes(inputs(spark, {1: one, 2: two})) == {(2, "removed", "version", ""), (2, "added", "folder", "")}


def test_defined_cases(spark):
    assert changes(inputs(spark, {1: [("a", '{"k": 1}')], 2: [("a", None), ("b", ""), ("c", "{bad"), ("d", "[1]"), ("e", '{"k": null, "n": 1.0}')]})) == {(2, "added", "n", "")}
    kinds = {r["key"]: r["kind"] for r in S.exploded(inputs(spark, {1: [("a", '{"i": 1, "d": 1.0, "e": 1e3, "s": "1", "b": true, "l": [], "o": {}, "z": null, "big": 12345678901234567890}')]}), "feed", "file_no", "input_no", "id", "metadata").collect()}
    assert kinds == {"i": "integer", "d": "decimal", "e": "decimal", "s": "string", "b": "boolean", "l": "array", "o": "object", "z": None, "big": "integer"}
    assert changes(inputs(spark, {1: [("a", "{}")]}).limit(0)) == set()


def test_unified_names_follow_chains(spark):
    files = {1: [(f"a{i}", {"git_branch": f"x/y{i}"}) for i in range(5)], 2: [(f"b{i}", {"branch": f"x/y{i}"}) for i in range(5)], 3: [(f"c{i}", {"branchName": f"x/y{i}"}) for i in range(5)]}
    df = inputs(spark, files)
    found = S.materialise(S.schema_changes(df), "changes")
    got = {(r["file_no"], r["field"]) for r in S.unified_table(df, found).collect()}
    assert got == {(1, "branchName"), (2, "branchName"), (3, "branchName")}


def consistent(spark, feeds, sessions=()):
    """feeds: feed -> files as in inputs(); sessions: (id, dict)"""
    made = [inputs(spark, files).withColumn("feed", S.F.lit(feed)).withColumn("input_no", S.F.col("input_no") + 1000 * k) for k, (feed, files) in enumerate(feeds.items())]
    df = made[0]
    for d in made[1:]:
        df = df.unionByName(d)
    found = S.materialise(S.schema_changes(df), "changes")
    late = spark.createDataFrame([(None, None, n, id, json.dumps(m)) for n, (id, m) in enumerate(sessions)], "feed string, file_no int, n long, id string, m string")
    return S.consistent_table(S.unified_table(df, found), S.exploded(late, "feed", "file_no", "n", "id", "m"), found)


def test_one_name_over_all_feeds_and_the_outcome(spark):
    a = {1: [(f"a{i}", {"gitBranch": f"x/y{i}", "num": i, "is_archived": i > 3}) for i in range(8)]}
    b = {1: [(f"b{i}", {"branch": f"x/y{i}", "isPinned": i > 3}) for i in range(6)], 2: [(f"c{i}", {"vcs_ref": f"x/y{i}", "isPinned": i > 3}) for i in range(6)]}
    sessions = [("a1", {"gitBranch": "x/y1", "num": 1}), ("b1", {"branch": "x/y1"}), ("zz", {"vcs_ref": "x/y9", "unknown": "n"}), ("c1", {"vcs_ref": None})]
    got = consistent(spark, {"a": a, "b": b}, sessions).collect()
    assert {r["field"] for r in got} == {"vcs_ref", "num", "is_archived", "isPinned", "unknown"}
    assert {(r["row_no"], r["field"], r["value"]) for r in got if r["origin"] == "outcome"} == {(0, "vcs_ref", "x/y1"), (0, "num", "1"), (1, "vcs_ref", "x/y1"), (2, "vcs_ref", "x/y9"), (2, "unknown", "n"), (3, "vcs_ref", None)}
    assert sum(r["origin"] == "files" for r in got) == 24 + 12 + 12 and not any(r["failed"] for r in got)


def test_names_side_by_side_stay_apart(spark):
    both = {1: [(f"a{i}", {"from": f"x/y{i}", "to": f"x/y{i}"}) for i in range(6)]}
    assert {r["field"] for r in consistent(spark, {"a": both}).collect()} == {"from", "to"}
    assert sorted(map(sorted, S.grouped_names("abcd", [("a", "b", 3.0), ("b", "c", 2.0), ("c", "d", 1.0)], [("a", "c")]))) == [["a", "b"], ["c", "d"]]


def test_one_type_for_each_field(spark):
    one = {"n": 7, "s": "linux", "t": ["x", "y"], "b": True, "o": {"p": 1}, "d": 1}
    two = {"n": "12", "s": {"value": "macos", "kind": "auto"}, "t": "x; z", "b": 0, "o": "plain", "d": "2.5"}
    three = {"n": "many", "s": ["a", "b"], "t": 5, "b": "TRUE", "o": None, "d": "1e1"}
    four = {"n": 12345678901234567890, "s": {"p": 1}, "t": ["w"], "b": 2, "o": {"p": 2}, "d": False}
    got = consistent(spark, {"f": {1: [(f"x{i}", one) for i in range(4)] + [("two", two), ("three", three), ("four", four)]}}).where("record in ('x0', 'two', 'three', 'four')").collect()
    kinds = {r["field"]: r["kind"] for r in got}
    assert kinds == {"n": "integer", "s": "string", "t": "array", "b": "boolean", "o": "object", "d": "decimal"}
    values = {(r["record"], r["field"]): r["value"] for r in got}
    row = lambda record: [values[record, f] for f in "nstbod"]
    assert row("x0") == ["7", "linux", '["x","y"]', "true", '{"p":1}', "1.0"]
    assert row("two") == ["12", "macos", '["x","z"]', "false", None, "2.5"]
    assert row("three") == [None, "a;b", "[5]", "true", None, "10.0"]
    assert row("four") == ["12345678901234567890", None, '["w"]', None, '{"p":2}', "0.0"]
    assert {(r["record"], r["field"], r["raw"]) for r in got if r["failed"]} == {("three", "n", "many"), ("two", "o", "plain"), ("four", "s", '{"p":1}'), ("four", "b", "2")}


def test_likeness_of_keys_with_more_shapes_than_a_sketch_holds():
    import random

    from convolith.operators import schema_drift as S

    rng = random.Random(2)
    shapes = {rng.getrandbits(60): rng.randrange(1, 5) for _ in range(4000)}

    def sketch(part):
        return {"key": "k", "shapes": dict(sorted(part.items())[: S.SHAPES]), "tokens": [], "low": None, "high": None}

    # two samples of one distribution are alike, though few of their most frequent shapes would agree
    one = {k: n for k, n in shapes.items() if rng.random() < 0.9}
    two = {k: n for k, n in shapes.items() if rng.random() < 0.9}
    other = {rng.getrandbits(60): 1 for _ in range(4000)}
    assert S.likeness("string", sketch(one), sketch(two)) - S.likeness("string", sketch(one), sketch(other)) > 0.3
