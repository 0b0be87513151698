"""Messages delivered more than once: an idempotent upsert store.

The store is a set of sorted runs, each a table hash-bucketed and sorted by identifier.  A batch of
deliveries is first collapsed to the least and the largest row number of each identifier, then written
as one run: one file for each bucket, ordered by identifier.  Upserting the same batch again only adds an
equal run, and changes nothing that is read from the store.  Compaction merges runs two by two, bucket by
bucket: a full outer merge join reads both in order, so there is neither exchange nor sort nor hash table,
and equal identifiers collapse to one.  A session that holds a third of all rows is spread by its message
identifiers, and a single identifier delivered millions of times is collapsed before it is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolith.shared import delete_path, scratch_path

#: White space around identifiers: what Unicode calls White_Space.
_EDGE = r"(?U)^\s+|\s+$"


def message_key(id: Column) -> Column:
    """The identifier without surrounding white space and letter case; null where it identifies nothing."""
    key = F.lower(F.regexp_replace(id, _EDGE, ""))
    return F.when(key != "", key)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Buckets are read as such and in the order of their one file.
_IN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.sources.bucketing.enabled": "true", "spark.sql.adaptive.enabled": "false"}


class UpsertStore:
    """Hash-bucketed sorted runs of (grp, key) -> least and largest row number, in the shared folder."""

    def __init__(self, spark: SparkSession, group_type: str = "string", row_type: str = "bigint", buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.schema = f"grp {group_type}, key string, kept_no {row_type}, last_no {row_type}"
        self.runs: list[tuple[str, str]] = []  # table and folder of each

    def _run(self, df: DataFrame) -> None:
        """Write ``df``, partitioned by bucket, as a run."""
        name = f"upsert_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        self.spark.sql(f"create table {name} ({self.schema}) using parquet clustered by (grp, key) sorted by (grp, key) into {self.buckets} buckets location '{path}'")
        df.write.insertInto(name)
        self.runs.append((name, path))

    def upsert(self, rows: DataFrame) -> None:
        """Add one batch (grp, key, row_no): collapsed, bucketed and sorted into a run of its own."""
        known = rows.where("key is not null and grp is not null and row_no is not null")
        kept = known.groupBy("grp", "key").agg(F.min("row_no").alias("kept_no"), F.max("row_no").alias("last_no"))
        self._run(kept.select("grp", "key", "kept_no", "last_no").repartition(self.buckets, "grp", "key"))

    def merge(self, a: str, b: str) -> DataFrame:
        """Two runs in one; planned in order, the caller runs it under the same settings."""
        one, two = (self.spark.table(t).select("grp", "key", F.col("kept_no").alias(f"k{i}"), F.col("last_no").alias(f"l{i}")) for i, t in enumerate((a, b)))
        return one.hint("merge").join(two, ["grp", "key"], "full_outer").select("grp", "key", F.least("k0", "k1").alias("kept_no"), F.greatest("l0", "l1").alias("last_no"))

    def compact(self) -> None:
        """Merge sorted runs two by two until one is left, and put it in their place."""
        with _conf(self.spark, _IN_ORDER):
            while len(self.runs) > 1:
                old, self.runs = self.runs, []
                for k in range(0, len(old) - 1, 2):
                    self._run(self.merge(old[k][0], old[k + 1][0]))
                    for name, path in old[k : k + 2]:
                        self.spark.sql(f"drop table {name}")
                        delete_path(self.spark, path)
                self.runs += old[len(old) - len(old) % 2 :]

    def kept(self) -> DataFrame:
        """grp, key, kept_no, last_no of each identifier, of a compacted store; plain files, so that a join may split hot keys."""
        if len(self.runs) > 1:
            self.compact()
        return self.spark.read.schema(self.schema).parquet(*[path for _, path in self.runs]) if self.runs else self.spark.createDataFrame([], self.schema)

    def close(self) -> None:
        """Take the runs out of the catalog; their files stay until the driver ends."""
        for name, _ in self.runs:
            self.spark.sql(f"drop table if exists {name}")


def _delivered(df: DataFrame, group: Column, id: Column, row_no: str, batch: Column | None, runs: int) -> tuple[DataFrame, DataFrame]:
    """The deliveries that identify something, and (grp, key, kept_no) of identifiers with more than one row."""
    spark = df.sparkSession
    runs = runs if batch is not None else 1
    run = F.pmod(F.coalesce(batch.cast("long"), F.lit(0)), F.lit(runs)) if batch is not None else F.lit(0)
    keyed = df.select(group.alias("grp"), message_key(id).alias("key"), F.col(row_no).alias("row_no"), run.cast("int").alias("run"))
    keyed = keyed.where("key is not null and grp is not null and row_no is not null")
    # the input is read once; each run then reads only its own part of the three columns that matter
    path = scratch_path(spark, "deliveries")
    keyed.write.partitionBy("run").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(keyed.schema).parquet(path)
    kinds = dict(keyed.dtypes)
    store = UpsertStore(spark, kinds["grp"], kinds["row_no"])
    for k in range(runs):
        store.upsert(rows.where(F.col("run") == k))
    repeated = store.kept().where("last_no > kept_no").select("grp", "key", "kept_no")
    store.close()
    return rows.drop("run"), repeated


def surplus_copies(df: DataFrame, group: Column, id: Column, row_no: str, batch: Column | None = None, runs: int = 4) -> DataFrame:
    """(kept_no, surplus_no) for each delivery beyond the first of its identifier.

    The deliveries are upserted as ``runs`` runs, by batch number; the store is compacted; every row
    whose number is not the one kept for its identifier is surplus.  Rows agree if the group and the
    identifier do, letter case and white space around it aside.

    Defined cases: a null or blank identifier, or a null group, identifies nothing, so such rows are neither kept nor
    surplus; rows repeated with the same number are one row; ties cannot arise as the least number is
    kept; an empty table gives an empty result; extra columns are ignored.
    """
    rows, repeated = _delivered(df, group, id, row_no, batch, runs)
    return rows.join(repeated, ["grp", "key"]).where("row_no <> kept_no").select("kept_no", F.col("row_no").alias("surplus_no")).distinct()


def drop_copies(df: DataFrame, group: Column, id: Column, row_no: str, batch: Column | None = None, runs: int = 4) -> DataFrame:
    """``df`` with one delivery of each identifier, all its columns; rows that identify nothing stay.

    What is kept is read from the compacted store; the cases are those of ``surplus_copies``.
    """
    surplus = surplus_copies(df, group, id, row_no, batch, runs).select(F.col("surplus_no").alias("_surplus")).distinct()
    return df.join(surplus, df[row_no] == surplus["_surplus"], "left_anti")
