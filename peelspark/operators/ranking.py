"""Ranks, running sums and packings in a total order, without one task for all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep


def _ordered(df: DataFrame, order: list) -> DataFrame:
    """Range-partitioned and sorted, as a table, with the number of the range as ``_range``."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return keep(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def row_numbers(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Positions from 0 in the given order."""
    ranged = _ordered(df, order)
    sizes = ranged.groupBy("_range").count().orderBy("_range").collect()  # one row for each range
    before, total = [], 0
    for r in sizes:
        before.append((r["_range"], total))
        total += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0)], "_range int, _before long"))
    inner = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(offsets, "_range").withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).drop("_range", "_before")


def running_sum(df: DataFrame, value: str, order: list, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row in the given order (ties: in any fixed order)."""
    ranged = _ordered(df, order)
    sizes = ranged.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["_range"], float(total)))
        total += r["s"] or 0
    offsets = F.broadcast(df.sparkSession.createDataFrame(before or [(0, 0.0)], "_range int, _before double"))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, "_range").withColumn(name, F.col("_before") + F.sum(value).over(inner)).drop("_range", "_before")


def dense_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """The distinct keys with their position in sorted order."""
    return row_numbers(df.select(*keys).distinct(), [F.col(k) for k in keys], name)


def level_rank(df: DataFrame, scope: list[str], keys: list[str], name: str = "level") -> DataFrame:
    """Dense rank of ``keys`` inside each scope, from 0; the window sees distinct keys only."""
    distinct = df.select(*scope, *keys).distinct()
    over = Window.partitionBy(*scope).orderBy(*keys) if scope else Window.orderBy(*keys)
    return df.join(distinct.withColumn(name, F.dense_rank().over(over) - 1), [*scope, *keys])


def log_top(df: DataFrame, scope: list[str], order: list, plus: int = 1) -> DataFrame:
    """The first ``ceil(log2(n + plus))`` rows of each scope of n rows."""
    if not scope:  # few rows, so each partition keeps its own first ones
        return df.orderBy(*order).limit(max(0, math.ceil(math.log2(max(1, df.count() + plus)))))
    n = df.groupBy(*scope).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*scope).orderBy(*order)
    return df.join(n, scope).withColumn("_r", F.row_number().over(over)).filter(F.col("_r") <= F.ceil(F.log2(F.col("_n") + plus))).drop("_n", "_r")


def top_by(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def median_row(df: DataFrame, scope: list[str], order: list) -> DataFrame:
    """The middle row of each scope in the given order (the upper one of two)."""
    over = Window.partitionBy(*scope)
    return df.withColumn("_r", F.row_number().over(over.orderBy(*order))).withColumn("_n", F.count("*").over(over)).filter("_r = cast(floor(_n / 2) as int) + 1").drop("_r", "_n")


def split_at(df: DataFrame, value: str, order: list, limit: int, name: str = "file") -> DataFrame:
    """Number of the file a row goes to when a new one begins each ``limit`` of the running sum."""
    summed = running_sum(df, value, order, "_sum")
    return summed.withColumn(name, F.floor((F.col("_sum") - F.col(value)) / limit).cast("long")).drop("_sum")


def pack_buckets(df: DataFrame, scope: list[str], size: str, order: str, limit: int) -> DataFrame:
    """Sequential filling: a bucket is closed by the row that would overflow it; an oversize row stands alone.

    The fill level restarts with each bucket, so a scope is scanned in order; its rows stream through in batches.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bucket, filled = None, 0, 0
        for b in batches:
            out = []
            for key, n in zip(b[scope].itertuples(index=False, name=None) if scope else [()] * len(b), b[size], strict=True):
                if key != last:
                    last, bucket, filled = key, 0, 0
                elif filled + n > limit:
                    bucket, filled = bucket + 1, 0
                filled += n
                out.append(bucket)
            yield b.assign(bucket=pd.array(out, dtype="int64"))

    sorted_ = (df.repartition(*scope) if scope else df.coalesce(1)).sortWithinPartitions(*scope, order)
    return sorted_.mapInPandas(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", bucket long")


def sort_multi(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order)
