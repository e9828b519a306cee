"""Look-ups between the tables of a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wcc_to_lcc(sources: DataFrame, layers: DataFrame) -> DataFrame:
    """The lcc of each (layer, wave, wcc), through its smallest source vertex."""
    one = sources.groupBy("layer", "wave", "wcc").agg(F.min("vertex").alias("vertex"))
    return one.join(layers.select("vertex", "layer", "lcc"), ["vertex", "layer"]).select("layer", "wave", "wcc", "lcc")


def with_labels(vertices: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Label of each vertex; its id where there is none."""
    own = F.col("id").cast("string")
    if labels is None:
        return vertices.withColumn("label", own)
    return vertices.join(labels.select("id", F.col("label").alias("_l")), "id", "left").withColumn("label", F.coalesce("_l", own)).drop("_l")


def edges_of_nodes(edges: DataFrame, vmap: DataFrame, touching: bool = False) -> DataFrame:
    """Raw edges under meta nodes ``vmap(id, node)``: those inside one, or with ``touching`` under each end's."""
    s, d = (vmap.select(F.col("id").alias(c), F.col("node").alias(f"n_{c}")) for c in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    if not touching:
        return e.filter("n_src = n_dst").select(F.col("n_src").alias("node"), "src", "dst")
    return e.select(F.explode(F.array_distinct(F.array("n_src", "n_dst"))).alias("node"), "src", "dst")


def semi(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def classify(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Label of the open range that a value lies in (``ranges(lo, hi, label)`` is a short table)."""
    return values.join(F.broadcast(ranges), (F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi")), "left")


def with_attributes(df: DataFrame, *tables: DataFrame, on: str = "id") -> DataFrame:
    for t in tables:
        df = df.join(t, on, "left")
    return df


def pair_labels(pairs: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the vertices that two parts share, in ``pairs(a, b)``."""
    m = members.join(labels, "id")
    a, b = m.select(F.col("part").alias("a"), "id", "label"), m.select(F.col("part").alias("b"), "id")
    return pairs.join(a, "a").join(b, ["b", "id"]).select("a", "b", "id", "label")
