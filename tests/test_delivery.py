from __future__ import annotations

from convolith.operators import delivery as D
from convolith.operators.ordering import next_row
from pyspark.sql import functions as F


def events(spark, data):
    return spark.createDataFrame(data, "event_no long, session string, id string, batch long, key string")


DATA = [
    (1, "s", "A1", 1, "x"),
    (2, "s", " a1\n", 1, "x"),
    (5, "s", "a1", 2, "y"),
    (4, "s", "b", 2, None),
    (3, "t", "a1", 1, None),
    (6, "t", " a1", 9, None),
    (7, "t", None, 1, None),
    (8, "t", "  ", 1, None),
    (9, "t", " ", None, None),
    (10, None, "a1", 1, None),
    (11, None, "a1", 1, None),
]


def found(df, **options):
    return {tuple(r) for r in D.surplus_copies(df, F.col("session"), F.col("id"), "event_no", **options).collect()}


def test_surplus(spark):
    df = events(spark, DATA)
    expected = {(1, 2), (1, 5), (3, 6)}
    assert found(df, batch=F.col("batch")) == expected
    assert found(df) == expected
    assert found(df.unionByName(df), batch=F.col("batch")) == expected
    assert found(df.limit(0), batch=F.col("batch")) == set()


def test_drop_copies_keeps_the_rest(spark):
    kept = {r["event_no"] for r in D.drop_copies(events(spark, DATA), F.col("session"), F.col("id"), "event_no").collect()}
    assert kept == {1, 3, 4, 7, 8, 9, 10, 11}
    rows = events(spark, DATA)
    assert D.drop_copies(rows, F.col("session"), F.col("id"), "event_no", F.col("batch"), runs=3).count() == 8
    assert D.drop_copies(rows.limit(0), F.col("session"), F.col("id"), "event_no").count() == 0


def kept(store):
    return {tuple(r) for r in store.kept().collect()}


def test_store_is_idempotent(spark):
    store = D.UpsertStore(spark, row_type="bigint", buckets=3)
    batch = spark.createDataFrame([("g", "k", 5), ("g", "k", 3), ("g", "l", 9), ("g", None, 1), (None, "k", 1)], "grp string, key string, row_no long")
    store.upsert(batch)
    once = kept(store)
    store.upsert(batch)
    assert kept(store) == once == {("g", "k", 3, 5), ("g", "l", 9, 9)}
    store.upsert(spark.createDataFrame([("g", "k", 1), ("h", "k", 7)], "grp string, key string, row_no long"))
    store.upsert(batch.limit(0))
    assert kept(store) == {("g", "k", 1, 5), ("g", "l", 9, 9), ("h", "k", 7, 7)} and len(store.runs) == 1
    store.close()
    assert not any(t.name.startswith("upsert_") for t in spark.catalog.listTables())


def test_compaction_merges_sorted_runs(spark):
    """Neither exchange, nor sort, nor hash table stands in the plan of a merge."""
    store = D.UpsertStore(spark, row_type="bigint", buckets=3)
    rows = spark.range(500).select(F.lit("g").alias("grp"), (F.col("id") % 90).cast("string").alias("key"), F.col("id").alias("row_no"))
    store.upsert(rows.where("row_no < 300"))
    store.upsert(rows.where("row_no >= 200"))
    with D._conf(spark, D._IN_ORDER):
        plan = store.merge(store.runs[0][0], store.runs[1][0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "FullOuter" in plan
    assert "Exchange" not in plan and "Sort [" not in plan and "Aggregate" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert kept(store) == {("g", str(k), k, 499 - (499 - k) % 90) for k in range(90)}
    store.close()


def test_next_row_across_blocks(spark):
    rows = [("a", i, i * 10) for i in (1, 2, 5, 9, 30)] + [("b", 1, 7)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    for block in (1, 3, 1000):
        got = {(r["g"], r["o"]): r["next_v"] for r in next_row(df, "g", "o", ["v"], block=block).collect()}
        assert got == {("a", 1): 20, ("a", 2): 50, ("a", 5): 90, ("a", 9): 300, ("a", 30): None, ("b", 1): None}
