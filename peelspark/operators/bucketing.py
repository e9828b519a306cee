"""Size buckets, duplicates, representatives and samples of connected fixed points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import density


def log_thresholds(vertices: int, most: int) -> list[int]:
    """0, then the integer powers of ``ln(V) / 2`` beyond ``most``; 0, 1, 2, ... if that base is at most 1."""
    base = math.log(vertices) / 2 if vertices > 1 else 0.0
    out, i = [0], 1
    while True:
        t = math.floor(base**i) if base > 1 else i
        out.append(t)
        if t > most:
            return out
        i += 1


def bucket_by(df: DataFrame, size: str, thresholds: list[int]) -> DataFrame:
    """The largest bucket whose threshold a size reaches, before the first that it does not."""
    th = F.array(*(F.lit(t).cast("long") for t in thresholds))
    first_beyond = F.array_position(F.transform(th, lambda t: t > F.col(size)), F.lit(True))
    return df.withColumn("bucket", (first_beyond - 2).cast("long"))


def bucket_log(lccs: DataFrame, vertices: int) -> DataFrame:
    most = lccs.agg(F.max("e")).first()[0] or 0
    return bucket_by(lccs, "e", log_thresholds(vertices, most))


def bucket_linear(lccs: DataFrame) -> DataFrame:
    """Position of the edge count among those that occur."""
    sizes = lccs.select("e").distinct().withColumn("bucket", F.dense_rank().over(Window.orderBy("e")).cast("long") - 1)
    return lccs.join(sizes, "e")


def bucket_client(lccs: DataFrame) -> DataFrame:
    """By powers of ``ln`` of all edges; each in one bucket."""
    total, most = lccs.agg(F.sum("e"), F.max("e")).first()
    base, out = math.log(total or 1), [0]
    while out[-1] <= (most or 0):
        out.append(math.floor(base ** len(out)) if base > 1 else len(out))
    return bucket_by(lccs, "e", out)


def degree_code_duplicates(local_degrees: DataFrame) -> DataFrame:
    """Connected fixed points of a layer with the same degree histogram: ``layer, code, n, lccs``."""
    h = local_degrees.groupBy("layer", "lcc", "degree").agg(F.count("*").alias("n"))
    code = h.groupBy("layer", "lcc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("degree", "n"))), lambda x: F.concat_ws(":", x["degree"], x["n"])), " ").alias("code"))
    return code.groupBy("layer", "code").agg(F.count("*").alias("n"), F.min("lcc").alias("first"))


def dedup_lccs(lccs: DataFrame) -> DataFrame:
    """Those of a layer with equal (v, e) as one, with how many there are (members: ``lcc_members``)."""
    return lccs.groupBy("layer", "v", "e").agg(F.min("lcc").alias("lcc"), F.count("*").alias("duplicates"))


def lcc_members(lccs: DataFrame) -> DataFrame:
    """Every connected fixed point with the one that stands for it, a row each."""
    return lccs.withColumn("first", F.min("lcc").over(Window.partitionBy("layer", "v", "e"))).select("layer", "lcc", "first")


def node_buckets(nodes: DataFrame, group: str) -> DataFrame:
    """Bucket of each node by deviation of its edges in its group, and by the logarithm."""
    m = nodes.groupBy(group).agg(F.avg("e").alias("m"), F.stddev_pop("e").alias("s"), F.sum(F.col("e") + F.col("touch")).alias("total"))
    out = nodes.join(m, group)
    by_std = F.when(F.col("s") > 0, F.floor((F.col("e") - F.col("m")) / F.col("s"))).otherwise(0).cast("long")
    by_log = F.floor(F.log2(1 + F.col("e") + F.col("touch")) / F.log2(1 + F.log2(F.greatest("total", F.lit(2))))).cast("long")
    return out.withColumns({"std_bucket": by_std, "log_bucket": by_log}).drop("m", "s", "total")


def node_sample(nodes: DataFrame, group: str) -> DataFrame:
    """One node of each distinct (v, e, touch) of a group."""
    return nodes.groupBy(group, "v", "e", "touch").agg(F.min("node").alias("node"), F.count("*").alias("n"))


def sample_without_duplicates(edges: DataFrame, lccs: DataFrame) -> DataFrame:
    """Edges of the connected fixed points that stand for their duplicates."""
    kept = dedup_lccs(lccs).select("layer", "lcc")
    return edges.join(kept, ["layer", "lcc"], "left_semi")


def building_or_spiral(lccs: DataFrame) -> DataFrame:
    return lccs.groupBy("bucket", "layer").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("n") == 1, "building").otherwise("spiral"))


def bucket_order(lccs: DataFrame) -> DataFrame:
    """Place of each in its (bucket, layer), the largest first."""
    return lccs.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "layer").orderBy(F.desc("e"), F.desc("v"), "lcc")))


def top_buildings(b: DataFrame) -> DataFrame:
    """Union of the first ``ceil(log2(n + 1))`` buildings by edges, density (upper half of the buckets), height, floors and road weight."""
    from .ranking import log_top

    half = b.agg((F.max("bucket") / 2).alias("half"))
    dense = b.crossJoin(F.broadcast(half)).filter("bucket >= half").drop("half").withColumn("d", density("v", "e"))
    out = log_top(dense, [], [F.desc("d"), F.col("building")]).select("building")
    for by in ("e", "height", "floors", "road"):
        out = out.union(log_top(b, [], [F.desc(by), F.col("building")]).select("building"))
    return out.distinct()


def nodes_not_dense(nodes: DataFrame, most: float = 0.95, keep_equal: bool = False) -> DataFrame:
    d = density("v", "e")
    return nodes.filter(d <= most if keep_equal else d < most)


def summed_by_bucket(lccs: DataFrame) -> DataFrame:
    """(bucket, layer) nodes: vertices, edges, how many, whether they form a spiral."""
    out = lccs.groupBy("bucket", "layer").agg(F.sum("v").alias("v"), F.sum("e").alias("e"), F.count("*").alias("n"))
    return out.withColumn("spiral", F.col("n") > 1)


def split_by_size(nodes: DataFrame, small: int = 16_384, large: int = 131_072) -> DataFrame:
    """Which limit a node's edges keep: sample, vicinity or beyond."""
    return nodes.withColumn("size_class", F.when(F.col("e") <= small, "sample").when(F.col("e") <= large, "vicinity").otherwise("beyond"))
