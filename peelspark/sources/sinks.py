"""Writers: tables, edge lists, partitioned subgraphs, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import pack_buckets
from ..store import delete  # noqa: F401  part of this module's surface


def write_edge_list(edges: DataFrame, path: str, predicate: str | None = None, sep: str = " ") -> None:
    kept = edges.filter(predicate) if predicate else edges
    kept.select(F.concat_ws(sep, "src", "dst").alias("value")).write.text(path)


def write_table(df: DataFrame, path: str, form: str = "parquet", partition: list[str] | None = None, mode: str = "error") -> None:
    """csv, json or parquet; an existing folder is not overwritten unless asked for."""
    writer = df.write.mode(mode).format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def write_properties(vertices: DataFrame, path: str) -> None:
    """Topology and every property apart, keyed by id."""
    for c in vertices.columns:
        if c != "id":
            vertices.select("id", c).write.json(f"{path}/{c}", compression="gzip")
    vertices.select("id").write.json(f"{path}/id", compression="gzip")


def write_metagraph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/V")
    edges.write.parquet(f"{path}/E")


def write_subgraphs(edges: DataFrame, sizes: DataFrame, path: str, limit: int = 132_000) -> DataFrame:
    """Edges ``(part, src, dst)`` by bucket of parts; small parts are packed together.  Returns the parts' buckets and sizes."""
    packed = pack_buckets(sizes.withColumn("size", F.greatest("v", "e")), [], "size", "part", limit)
    edges.join(packed.select("part", "bucket"), "part").repartition("bucket").write.partitionBy("bucket").parquet(path)
    return packed


def size_histograms(sizes: DataFrame) -> DataFrame:
    """How many parts have so many vertices and edges."""
    return sizes.groupBy("v", "e").agg(F.count("*").alias("n"), F.min("part").alias("first"), F.max("part").alias("last"))


def export_selection(edges: DataFrame, labels: DataFrame, path: str) -> None:
    """Edges and labels of a selection as CSV with header; fails if it is there."""
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target")).write.mode("error").csv(f"{path}/edges", header=True)
    labels.select(F.col("id").alias("new_id"), F.col("label").alias("name")).write.mode("error").csv(f"{path}/labels", header=True)


def saved_or(spark: SparkSession, path: str, kind: str, compute) -> DataFrame:
    """The saved result of (path, kind), or else the computed one, which is saved."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        compute().write.parquet(f"{path}/{kind}")
    return spark.read.parquet(f"{path}/{kind}")
