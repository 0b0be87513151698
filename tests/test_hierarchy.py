from __future__ import annotations

import random

import numpy as np
from convolith.operators import hierarchy as H
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(parents: dict) -> dict:
    """(root, depth, below) of each node by walking up."""
    out, ups = {}, {}
    for n in parents:
        seen, at = [], n
        while at is not None and at in parents and at not in seen:
            seen.append(at)
            at = parents[at]
        ended = at is None or at not in parents
        ups[n] = seen if ended else None
    for n, up in ups.items():
        out[n] = (H.CYCLE, -1, -1) if up is None else (up[-1], len(up) - 1, sum(u is not None and n in u[1:] for u in ups.values()))
    return out


@given(st.lists(st.integers(-1, 39), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_contraction_of_arrays(raw):
    parent = np.array([p if p < len(raw) else -1 for p in raw])
    root, depth, below = H.contract_forest(parent)
    expected = brute({i: (None if p < 0 else int(p)) for i, p in enumerate(parent)})
    for i in range(len(parent)):
        got = (H.CYCLE, -1, -1) if root[i] < 0 else (root[i], depth[i], below[i])
        assert got == expected[i]


def test_long_chain():
    n = 20_000
    root, depth, below = H.contract_forest(np.arange(n) - 1)
    assert (root == 0).all() and depth[-1] == n - 1 and below[0] == n - 1


def rows(spark, data):
    return spark.createDataFrame(data, "tree string, id string, parent string, root_id int")


def test_both_executions_agree(spark):
    rng = random.Random(5)
    data = []
    for t in range(6):
        n = rng.choice([1, 5, 40])
        data += [(f"t{t}", f"n{i}", rng.choice([None, "gone", *[f"n{rng.randrange(n)}" for _ in range(6)]]), 1) for i in range(n)]
    data += [("chain", f"c{i}", f"c{i - 1}" if i else None, 1) for i in range(60)]
    df = rows(spark, data)
    local = {tuple(r) for r in H.hierarchies(df, "tree", "id", "parent").collect()}
    spread = {tuple(r) for r in H.hierarchies(df, "tree", "id", "parent", local_limit=3).collect()}
    assert local == spread and len(local) == len(data)
    for t in {d[0] for d in data}:
        expected = brute({i: p for tree, i, p, _ in data if tree == t})
        assert {r[1]: r[2:] for r in local if r[0] == t} == expected


def test_paths_and_descendants(spark):
    df = rows(spark, [("t", "a", None, 1), ("t", "b", "a", 1), ("t", "c", "b", 1), ("t", "x", "x", 1)])
    for limit in (100, 1):
        got = {r["id"]: r["path"] for r in H.hierarchies(df, "tree", "id", "parent", with_path=True, local_limit=limit).collect()}
        assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "x": None}
    below = {(r[1], r[2], r[3]) for r in H.descendants(df, "tree", "id", "parent").collect()}
    assert below == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_defined_cases(spark):
    df = rows(spark, [(None, "a", None, 1), (None, "b", "a", 1), ("t", None, "a", 1), ("t", "a", "b", None), ("t", "a", None, 1), ("t", "b", "", 2), ("t", "b", "", 2)])
    got = {(r[0], r[1]): tuple(r[2:]) for r in H.hierarchies(df, "tree", "id", "parent").collect()}
    assert got == {(None, "a"): ("a", 0, 1), (None, "b"): ("a", 1, 0), ("t", "a"): ("b", 1, 0), ("t", "b"): ("b", 0, 1)}
    assert H.hierarchies(df.limit(0), "tree", "id", "parent").count() == 0


def test_registered_descendants(spark, tmp_path):
    from convolith.plans import training

    rows = [("s", "a", None), ("s", "b", "a"), ("s", "c", "b"), ("s", "d", "a"), ("t", "x", "y"), ("t", "y", "x")]
    spark.createDataFrame(rows, "session_id string, id string, parent_id string").write.parquet(str(tmp_path / "messages.parquet"))
    got = {tuple(r) for r in training.QUERIES["p4_descendants"](spark, str(tmp_path)).collect()}
    assert got == {("s", "a", "b", 1), ("s", "a", "c", 2), ("s", "b", "c", 1), ("s", "a", "d", 1)}
