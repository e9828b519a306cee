"""Streams of edges and chunked delivery of stored arrays."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import running_sum


def chunks(rows: DataFrame, order: str, text: str, size: int = 256) -> DataFrame:
    """Chunk number of each row: a new chunk begins with every ``size`` characters of the running total."""
    lengths = rows.withColumn("_n", F.char_length(text))
    return running_sum(lengths, "_n", [F.col(order)], "_sum").withColumn("chunk", F.floor((F.col("_sum") - F.col("_n")) / size).cast("long")).drop("_n", "_sum")


def deliver(chunked: DataFrame, order: str, text: str) -> Iterator[str]:
    """Chunks as JSON arrays, one after the other; partitions are fetched as they are asked for."""
    import json

    now, held = None, []
    for r in chunked.orderBy(order).toLocalIterator(prefetchPartitions=True):
        if now is not None and r["chunk"] != now:
            yield json.dumps(held)
            held = []
        now = r["chunk"]
        held.append(r[text])
    if held:
        yield json.dumps(held)


def degrees_of_stream(edges: DataFrame) -> DataFrame:
    """Running degrees of an edge stream ``(src, dst)``."""
    return edges.filter("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def recompute_each_batch(edges: DataFrame, table: str, compute, checkpoint: str) -> StreamingQuery:
    """Append each batch to a table and hand all of it to ``compute``: peeling isn't monotone, so nothing is carried over."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(table)
        compute(batch.sparkSession.read.parquet(table), number)

    return edges.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
