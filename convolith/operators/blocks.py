"""Forming blocks and segments: by number, by bytes, by compressed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolith.shared import materialise

BULK = 100
FLUSH = 10_000  # most sessions of a block that a flush writes: the index holds the ids of a block in one row
SEGMENT_BYTES = 1 << 30


def ranked(df: DataFrame, order: list[str], columns: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with rn, a dense number by ``order``, and running sums of ``columns`` before each row.

    Sorted by range across tasks; the offsets come from one summary row for each range, so there is
    no window over the whole table.
    """
    columns = columns or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise(df.select("*", *[c.alias(f"_{k}") for k, c in columns.items()]).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(f"_{k}").alias(f"_sum_{k}") for k in columns])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"), *[F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_off_{k}") for k in columns])
    inside = Window.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(offsets), "_part")  # as many rows as shuffle partitions
    rn = F.row_number().over(inside) + F.col("_off")
    sums = [(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)) + F.col(f"_off_{k}")).alias(k) for k in columns]
    return joined.select(*df.columns, rn.cast("long").alias("rn"), *sums)


def bulk_blocks(df: DataFrame, order: list[str], size: int = BULK) -> DataFrame:
    """``df`` with block_no and pos, ``size`` rows to a block, in order."""
    rows = ranked(df, order)
    return rows.select(*df.columns, F.floor((F.col("rn") - 1) / size).alias("block_no"), ((F.col("rn") - 1) % size).cast("int").alias("pos"))


def size_blocks(df: DataFrame, order: list[str], size: Column, target: int) -> DataFrame:
    """``df`` with block_no by running bytes: an approximation of greedy packing that needs no fold."""
    rows = ranked(df, order, {"before": size})
    return rows.select(*df.columns, F.floor(F.col("before") / target).alias("block_no"))


def segments(df: DataFrame, order: list[str], size: Column, limit: int = SEGMENT_BYTES, used: int = 0, first: int = 1) -> DataFrame:
    """``df`` (one row a block) with segment_no: before each row, a new segment starts if the present one has reached the limit.

    ``used`` bytes stand in the ``first`` segment already.  Only the order and the size of each row pass through the
    fold, in batches, one after the other: within a batch the next start is found by bisection of the running bytes.
    """
    keys = [f"{c} {df.schema[c].dataType.simpleString()}" for c in order]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = first, used
        for pdf in batches:
            ends = pdf["_size"].to_numpy(np.int64).cumsum()
            out = np.empty(len(pdf), np.int64)
            at = 0
            while at < len(pdf):
                if held >= limit:
                    number, held = number + 1, 0
                before = ends[at - 1] if at else 0
                # rows up to the first that brings the segment to its limit
                to = min(len(pdf), int(np.searchsorted(ends, before + limit - held, side="left")) + 1)
                out[at:to] = number
                held += int(ends[to - 1] - before)
                at = to
            yield pdf[order].assign(segment_no=out)

    sizes = df.select(*order, size.cast("long").alias("_size")).orderBy(*order).coalesce(1)
    return df.join(sizes.mapInPandas(fold, ", ".join([*keys, "segment_no long"])), order)


def greedy_blocks(df: DataFrame, segment: str, order: list[str], text: str, target: int, level: int = 3) -> DataFrame:
    """``df`` (segment, order columns, text) with block_no by trial compression, one ordered fold a segment.

    A row joins the open block and its text the block's compressor, a stream, so that every byte is compressed once.
    Once the raw bytes have reached twice the target, the stream is flushed after each row: beyond the target
    the block is sealed without the last row (unless that is its only one), at the target with it.
    Blocks are sealed at the end of a segment.  A segment is bounded by its rotation size, so the fold
    of one is a bounded task, and segments are folded side by side.
    """
    keys = [segment, *order]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys) + ", block_no long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = zstandard.ZstdCompressor(level=level)
        current, block = None, 0
        stream, n_rows, raw, packed = codec.compressobj(), 0, 0, 0
        for pdf in batches:
            out = []
            for seg, *rest, value in zip(pdf[segment], *[pdf[c] for c in order], pdf[text], strict=True):
                data = (value or "").encode("utf-8", "surrogatepass")
                if seg != current:
                    current, block = seg, 0
                    stream, n_rows, raw, packed = codec.compressobj(), 0, 0, 0
                n_rows, raw, number = n_rows + 1, raw + len(data), block
                packed += len(stream.compress(data))
                if raw >= 2 * target:
                    packed += len(stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))
                    if packed > target and n_rows > 1:
                        block += 1
                        number, stream, n_rows, raw = block, codec.compressobj(), 1, len(data)
                        packed = len(stream.compress(data))
                    elif packed >= target:
                        block, stream, n_rows, raw, packed = block + 1, codec.compressobj(), 0, 0, 0
                out.append((seg, *rest, number))
            yield pd.DataFrame(out, columns=[*keys, "block_no"])

    rows = df.select(*keys, text).repartition(F.col(segment)).sortWithinPartitions(*keys)
    return rows.mapInPandas(fold, schema)
