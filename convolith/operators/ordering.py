"""Neighbours in an order, without gathering a group: block-wise windows with carried edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_row(df: DataFrame, group: str, order: str, columns: list[str], block: int = 20_000) -> DataFrame:
    """``df`` with next_<column> of the following row of the group, by ``order`` (an integer column).

    The order is cut into blocks of ``block`` numbers.  Windows run within a block, so a group that
    holds a third of all rows is spread over many tasks; the last row of each block takes its
    successor from a summary with one row for each block.
    """
    at = F.floor(F.col(order) / block)
    rows = df.withColumn("_block", at)
    inner = Window.partitionBy(group, "_block").orderBy(order)
    packed = F.struct(order, *columns)
    rows = rows.withColumn("_next", F.lead(packed).over(inner))
    firsts = df.groupBy(group, at.alias("_block")).agg(F.min(packed).alias("_first"))
    edges = firsts.select(group, "_block", F.lead("_first").over(Window.partitionBy(group).orderBy("_block")).alias("_carried")).where("_carried is not null")
    edges = edges.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_carried")
    joined = rows.join(edges, F.col(group).eqNullSafe(F.col("_g")) & F.col("_block").eqNullSafe(F.col("_b")), "left")
    nxt = F.coalesce("_next", "_carried")
    return joined.select(*df.columns, *[nxt[c].alias(f"next_{c}") for c in [order, *columns]])
