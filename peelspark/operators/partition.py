"""Metagraphs: graphs whose vertices are parts of another graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import partition_components
from .ranking import dense_ids


def vertex_metagraph(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts by ``values(id, value)``: nodes (value, v, e, name) and edges (src, dst, e); a part of one vertex is named after it."""
    s, d = (values.select(F.col("id").alias(c), F.col("value").alias(f"v_{c}")) for c in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    inner = e.filter("v_src = v_dst").groupBy(F.col("v_src").alias("value")).agg(F.count("*").alias("e"))
    nodes = values.groupBy("value").agg(F.count("*").alias("v"), F.min("id").alias("_first")).join(inner, "value", "left").fillna({"e": 0})
    nodes = nodes.withColumn("name", F.when(F.col("v") == 1, F.concat(F.lit("v_"), F.col("_first").cast("string"))).otherwise(F.col("value").cast("string"))).drop("_first")
    meta = e.filter("v_src <> v_dst").groupBy(F.least("v_src", "v_dst").alias("src"), F.greatest("v_src", "v_dst").alias("dst")).agg(F.count("*").alias("e"))
    return nodes, meta


def shared_vertices(members: DataFrame, parts: list[str], vertex: str = "vertex") -> DataFrame:
    """Pairs of parts by the number of vertices they share, the smaller part first.

    A vertex is in few parts (one per layer), so the self-join on it stays
    linear in the members.
    """
    m = members.select(vertex, F.struct(*parts).alias("p")).distinct()
    pairs = m.select(vertex, F.col("p").alias("a")).join(m.select(vertex, F.col("p").alias("b")), vertex).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("w")).select(*(F.col(f"a.{c}").alias(f"{c}_a") for c in parts), *(F.col(f"b.{c}").alias(f"{c}_b") for c in parts), "w")


def edge_metagraph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts by the edges' ``value``: nodes (value, v, e), edges by shared vertices."""
    ends = edges.select("value", F.col("src").alias("vertex")).union(edges.select("value", "dst")).distinct()
    nodes = edges.groupBy("value").agg(F.count("*").alias("e")).join(ends.groupBy("value").agg(F.count("*").alias("v")), "value")
    return nodes, shared_vertices(ends, ["value"])


def vertex_profile(edges: DataFrame) -> DataFrame:
    """Per vertex and value, the number of its edges."""
    return edges.select(F.col("src").alias("id"), "value").unionAll(edges.select("dst", "value")).groupBy("id", "value").agg(F.count("*").alias("degree"))


def value_component_metagraph(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts by value and then by component."""
    parts = partition_components(edges, values)
    return vertex_metagraph(edges, parts.select("id", F.col("component").alias("value")))


def layer_metagraph(members: DataFrame) -> DataFrame:
    """Connected fixed points by shared vertices with ``weight = shared / (Va Vb)``."""
    size = members.distinct().groupBy("layer", "lcc").agg(F.count("*").alias("v"))
    w = shared_vertices(members, ["layer", "lcc"])
    a, b = (size.toDF(f"layer_{x}", f"lcc_{x}", f"v_{x}") for x in "ab")
    return w.join(a, ["layer_a", "lcc_a"]).join(b, ["layer_b", "lcc_b"]).withColumn("weight", F.col("w") / (F.col("v_a") * F.col("v_b")))


def meta_weight(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s, d = (nodes.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}")) for c in ("src", "dst"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", (F.col("e") / (F.col("v_src") * F.col("v_dst"))).alias("weight"))


def fixed_point_metagraph(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids of the connected fixed points, and edges (s, t, w) by shared vertices."""
    ids = dense_ids(members, ["layer", "lcc"])
    w = shared_vertices(members, ["layer", "lcc"])
    a, b = (ids.select(F.col("layer").alias(f"layer_{x}"), F.col("lcc").alias(f"lcc_{x}"), F.col("id").alias(n)) for x, n in (("a", "s"), ("b", "t")))
    return ids, w.join(a, ["layer_a", "lcc_a"]).join(b, ["layer_b", "lcc_b"]).select("s", "t", "w")


def bucket_metagraph(weights: DataFrame, buckets: DataFrame) -> DataFrame:
    """Shared vertices summed to (layer, bucket) nodes."""
    a, b = (buckets.select(F.col("layer").alias(f"layer_{x}"), F.col("lcc").alias(f"lcc_{x}"), F.col("bucket").alias(f"bucket_{x}")) for x in "ab")
    j = weights.join(a, ["layer_a", "lcc_a"]).join(b, ["layer_b", "lcc_b"])
    return j.groupBy("layer_a", "bucket_a", "layer_b", "bucket_b").agg(F.sum("w").alias("w"))


def wave_metagraph(edges: DataFrame, waves: DataFrame) -> DataFrame:
    """Edges between waves: count, ``count / (Vs Vt)`` and direction."""
    nodes, meta = vertex_metagraph(edges, waves.select("id", F.col("wave").alias("value")))
    w = meta_weight(meta, nodes.select(F.col("value").alias("id"), "v"))
    return meta.join(w, ["src", "dst"]).withColumn("direction", F.signum(F.col("dst") - F.col("src")).cast("int"))


def wave_arcs(sizes: DataFrame) -> DataFrame:
    """Angles of the components of each wave, in proportion to their sizes: ``from_angle, to_angle`` in radians."""
    inner = Window.partitionBy("wave")
    total, run = F.sum("v").over(inner), F.sum("v").over(inner.orderBy("wcc").rowsBetween(Window.unboundedPreceding, 0))
    turn = 2 * 3.141592653589793
    return sizes.withColumn("to_angle", turn * run / total).withColumn("from_angle", turn * (run - F.col("v")) / total)


def rings(edges: DataFrame, parts: DataFrame, degrees: DataFrame, base: float = 2.0) -> DataFrame:
    """Ring of each vertex: by the log bucket of its degree inside its component's size bucket."""
    size = parts.groupBy("component").agg(F.count("*").alias("size"))
    out = parts.join(size, "component").join(degrees, "id")
    bucket = lambda c: F.floor(F.ln(F.col(c)) / F.ln(F.lit(base)) + 1e-9).cast("long")
    return out.select("id", "component", bucket("size").alias("size_bucket"), bucket("degree").alias("ring"))


def ring_metagraph(edges: DataFrame, ring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of one component and ring collapsed into a metanode."""
    label = F.concat_ws("_", "component", "ring")
    return vertex_metagraph(edges, ring.select("id", label.alias("value")))


def articulation_metagraph(bcc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and articulation points of ``bcc(src, dst, block)``.

    A vertex of several blocks is an articulation point.  Edges join a block
    with its points; a block of one edge between two points becomes that edge.
    """
    held = bcc.select("block", F.col("src").alias("id")).union(bcc.select("block", "dst")).distinct()
    points = held.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    of_block = held.join(points, "id", "left_semi")
    single = bcc.groupBy("block").agg(F.count("*").alias("e"), F.min("src").alias("s"), F.min("dst").alias("d")).filter("e = 1")
    s, d = points.toDF("s"), points.toDF("d")
    bridges = single.join(s, "s", "left_semi").join(d, "d", "left_semi")
    star = of_block.join(bridges.select("block"), "block", "left_anti").select(F.concat(F.lit("b_"), F.col("block").cast("string")).alias("src"), F.concat(F.lit("v_"), F.col("id").cast("string")).alias("dst"))
    direct = bridges.select(F.concat(F.lit("v_"), F.col("s").cast("string")).alias("src"), F.concat(F.lit("v_"), F.col("d").cast("string")).alias("dst"))
    return points, star.unionAll(direct)


def regions(sets: DataFrame, edges: DataFrame | None = None, max_distance: int = 1, min_overlap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Regions of vertices that lie in the same sets (``sets(id, set_id)``) and the neighbouring regions.

    Two regions are neighbours if at most ``max_distance`` sets differ and at
    least ``min_overlap`` are shared.
    """
    key = sets.distinct().groupBy("id").agg(F.array_sort(F.collect_set("set_id")).alias("sets"))
    nodes = key.groupBy("sets").agg(F.count("*").alias("v")).withColumn("region", F.array_join("sets", "+"))
    a, b = nodes.select(F.col("region").alias("a"), F.col("sets").alias("sa")), nodes.select(F.col("region").alias("b"), F.col("sets").alias("sb"))
    # neighbours share a region less one set, so they meet under a key that leaves up to max_distance sets out
    if max_distance == 1:
        less = lambda d, n, s: d.select(n, s, F.explode(F.concat(F.array(F.array_join(s, "+")), F.transform(s, lambda x: F.array_join(F.array_remove(s, x), "+")))).alias("k"))
        pairs = less(a, "a", "sa").join(less(b, "b", "sb"), "k").filter("a < b").select("a", "b", "sa", "sb").distinct()
    else:
        pairs = a.join(b, F.col("a") < F.col("b"))
    differ = F.size(F.array_except("sa", "sb")) + F.size(F.array_except("sb", "sa"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return nodes.select("region", "v"), pairs.withColumns({"distance": differ, "overlap": shared}).filter((F.col("distance") <= max_distance) & (F.col("overlap") >= min_overlap)).select("a", "b", "distance", "overlap")
