"""Counts, distributions and densities of graphs and of their layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .edges import both_ways


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degree(edges).groupBy("degree").agg(F.count("*").alias("n"))


def density(v: Column | str, e: Column | str) -> Column:
    """``2E / (V (V - 1))``; 0 for fewer than two vertices."""
    v, e = (F.col(x) if isinstance(x, str) else x for x in (v, e))
    return F.when(v > 1, 2.0 * e / (v * (v - 1))).otherwise(0.0)


def layer_distribution(lccs: DataFrame) -> DataFrame:
    """Per layer, how many connected fixed points have so many edges."""
    return lccs.groupBy("layer", F.col("e").alias("edges")).agg(F.count("*").alias("n"))


def mean_degree(lccs: DataFrame) -> DataFrame:
    """``2E / V`` per layer and whether it lies in ``[layer, 2 layer)``."""
    m = lccs.groupBy("layer").agg((2.0 * F.sum("e") / F.sum("v")).alias("mean_degree"))
    return m.withColumn("holds", (F.col("mean_degree") >= F.col("layer")) & (F.col("mean_degree") < 2 * F.col("layer")))


def component_sizes(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices and edges of each component of ``parts(id, component)``."""
    v = parts.groupBy("component").agg(F.count("*").alias("v"))
    e = edges.join(parts.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.count("*").alias("e"))
    return v.join(e, "component", "left").fillna({"e": 0})


def main_vertices(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertex of most neighbours (ties: the smallest) of each component larger than the mean size."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("v"))
    mean = sizes.agg(F.avg("v").alias("mean"))
    large = sizes.crossJoin(F.broadcast(mean)).filter("v > mean").select("component")
    held = parts.join(large, "component", "left_semi").join(degree(edges), "id")
    best = held.groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("id"), F.max("degree").alias("degree"))
    return best


def wave_stats(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per wave: s, ss, t, ie, ee and the edges to the next wave.

    ``edges(src, dst, wave)`` each once, ``sources(id, wave, frag)``.  s counts
    the sources of fragment 0, ss all, t the other vertices that the wave's
    edges touch; ie are edges inside, ee those that leave.
    """
    wave_of = lambda c: sources.select(F.col("id").alias(c), F.col("wave").alias(f"w_{c}"))
    e = edges.join(wave_of("src"), "src").join(wave_of("dst"), "dst")
    next_wave = (F.least("w_src", "w_dst") == F.col("wave")) & (F.greatest("w_src", "w_dst") == F.col("wave") + 1)
    per_edge = e.groupBy("wave").agg(
        F.count("*").alias("e"),
        F.sum(((F.col("w_src") == F.col("wave")) & (F.col("w_dst") == F.col("wave"))).cast("long")).alias("ie"),
        F.sum(next_wave.cast("long")).alias("e_next"),
    )
    touched = edges.select("wave", F.col("src").alias("id")).union(edges.select("wave", "dst")).distinct().groupBy("wave").agg(F.count("*").alias("v"))
    own = sources.groupBy("wave").agg(F.sum((F.col("frag") == 0).cast("long")).alias("s"), F.count("*").alias("ss"))
    out = per_edge.join(touched, "wave").join(own, "wave")
    return out.select("wave", "s", "ss", (F.col("v") - F.col("s")).alias("t"), "ie", (F.col("e") - F.col("ie")).alias("ee"), "e_next")


def fork_stats(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per wave and fragment: edges, vertices, sources and components."""
    v = edges.select("wave", "frag", F.col("src").alias("id")).union(edges.select("wave", "frag", "dst")).distinct().groupBy("wave", "frag").agg(F.count("*").alias("v"))
    e = edges.groupBy("wave", "frag").agg(F.count("*").alias("e"), F.array_sort(F.collect_set("wcc")).alias("wccs"))
    s = sources.groupBy("wave", "frag").agg(F.count("*").alias("sources"))
    out = e.join(v, ["wave", "frag"]).join(s, ["wave", "frag"], "left").fillna({"sources": 0})
    return out.withColumn("max_frag_edges", F.max("e").over(Window.partitionBy("wave")))


def wave_map(edges: DataFrame) -> DataFrame:
    """Per (wave, wcc, level): vertices, edges inside the level, edges to higher ones; ``edges`` has ls and lt."""
    up = edges.select("wave", "wcc", F.least("ls", "lt").alias("level"), (F.col("ls") == F.col("lt")).alias("inside"))
    e = up.groupBy("wave", "wcc", "level").agg(F.sum(F.col("inside").cast("long")).alias("e"), F.sum((~F.col("inside")).cast("long")).alias("ef"))
    v = edges.select("wave", "wcc", F.col("ls").alias("level"), F.col("src").alias("id")).union(edges.select("wave", "wcc", "lt", "dst")).distinct()
    return v.groupBy("wave", "wcc", "level").agg(F.count("*").alias("v")).join(e, ["wave", "wcc", "level"], "left").fillna({"e": 0, "ef": 0})


def level_map(edges: DataFrame) -> DataFrame:
    """Per level: vertices by the highest level of their edges, edges inside, edges forward."""
    low = F.least("ls", "lt")
    held = edges.select(F.col("src").alias("id"), low.alias("l")).unionAll(edges.select("dst", low))
    v = held.groupBy("id").agg(F.max("l").alias("level")).groupBy("level").agg(F.count("*").alias("v"))
    e = edges.groupBy(low.alias("level")).agg(F.sum((F.col("ls") == F.col("lt")).cast("long")).alias("e"), F.sum((F.col("ls") != F.col("lt")).cast("long")).alias("ef"))
    return v.join(e, "level", "left").fillna({"e": 0, "ef": 0})


def density_stats(lccs: DataFrame, key: str) -> DataFrame:
    d = lccs.withColumn("d", density("v", "e"))
    return d.groupBy(key).agg(F.max("d").alias("max_density"), F.avg("d").alias("avg_density"), F.min("d").alias("min_density"))


def bucket_info(lccs: DataFrame) -> DataFrame:
    """Per (bucket, layer) and in total per bucket: components, V, E, mean density and density of the running sums."""
    d = lccs.withColumn("d", density("v", "e"))
    out = d.rollup("bucket", "layer").agg(F.count("*").alias("components"), F.sum("v").alias("v"), F.sum("e").alias("e"), F.avg("d").alias("avg_density")).filter("bucket IS NOT NULL")
    run = Window.partitionBy("bucket", F.col("layer").isNull()).orderBy("layer").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("running_density", density(F.sum("v").over(run), F.sum("e").over(run)))


def diversity(edges: DataFrame) -> DataFrame:
    """Mean over a layer's vertices of the normalised entropy of their degree over layers (our own normalisation)."""
    ends = edges.select(F.col("src").alias("id"), "layer").unionAll(edges.select("dst", "layer"))
    local = ends.groupBy("id", "layer").agg(F.count("*").alias("d"))
    total = local.groupBy("id").agg(F.sum("d").alias("all"), F.count("*").alias("layers"))
    p = local.join(total, "id").withColumn("p", F.col("d") / F.col("all"))
    h = p.groupBy("id").agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.greatest(F.lit(2), F.max("layers")))).alias("h"))
    return local.join(h, "id").groupBy("layer").agg(F.avg("h").alias("diversity"))


def clone_counts(layers: DataFrame) -> DataFrame:
    return layers.groupBy("vertex").agg(F.countDistinct("layer").alias("clones"))


def local_degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), "layer").unionAll(edges.select("dst", "layer")).groupBy("id", "layer").agg(F.count("*").alias("degree"))


def std_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts by ``floor((x - mean) / std)``."""
    m = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return df.crossJoin(F.broadcast(m)).filter("s > 0").groupBy(F.floor((F.col(value) - F.col("m")) / F.col("s")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def fragment_spread(frags: DataFrame) -> DataFrame:
    """Per lcc: mean and deviation of ``ln(size)``, how many fit below and above, and running counts by bin."""
    x = frags.withColumn("x", F.ln("size"))
    m = x.groupBy("lcc").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    spread = lambda d: F.when(F.col("std") > 1e-9, F.ceil(d / F.col("std"))).otherwise(0).cast("long")
    m = m.withColumns({"below": spread(F.col("mean") - F.col("lo")), "above": spread(F.col("hi") - F.col("mean"))})
    bins = x.join(m, "lcc").withColumn("bin", F.when(F.col("std") > 1e-9, F.floor((F.col("x") - F.col("mean")) / F.col("std"))).otherwise(0).cast("long"))
    n = bins.groupBy("lcc", "below", "above", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.partitionBy("lcc").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))


def summary(edges: DataFrame, layers: DataFrame, lccs: DataFrame) -> DataFrame:
    """One row: V, E, components, peel values, connected fixed points, buckets."""
    a = edges.agg(F.count("*").alias("edges"))
    b = layers.agg(F.countDistinct("vertex").alias("vertices"), F.countDistinct("cc").alias("con_comp"), F.countDistinct("layer").alias("peel_values"), F.countDistinct("layer", "lcc").alias("con_fixpoints"))
    c = lccs.agg(F.countDistinct("bucket").alias("buckets"), F.countDistinct("layer", "v", "e").alias("buildings"))
    return a.crossJoin(b).crossJoin(c)


def average_connections(df: DataFrame, label: str, count: str, contains: str) -> DataFrame:
    return df.filter(F.contains(F.col(label), F.lit(contains)) & (F.col(count) > 0)).agg(F.ceil(F.avg(count)).cast("long").alias("average"))


def down_degree(arcs: DataFrame) -> DataFrame:
    """Per node: up, down and level degree, for arcs with ls and lt."""
    both = arcs.select(F.col("src").alias("node"), F.col("ls").alias("level"), F.col("lt").alias("other")).unionAll(arcs.select("dst", "lt", "ls"))
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy("node", "level").agg(count(F.col("other") > F.col("level")).alias("up"), count(F.col("other") < F.col("level")).alias("down"), count(F.col("other") == F.col("level")).alias("horizontal"))


def high_nodes(degrees: DataFrame) -> DataFrame:
    """Per level the first ``1 + floor(log2(n))`` nodes by down degree."""
    over = Window.partitionBy("level")
    ranked = degrees.withColumn("rank", F.row_number().over(over.orderBy(F.desc("down"), "node"))).withColumn("n", F.count("*").over(over)).withColumn("mean_down", F.avg("down").over(over))
    return ranked.filter(F.col("rank") <= 1 + F.floor(F.log2("n"))).select("level", "node", "down", "rank", "mean_down")


def summary_stat(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.stddev_pop(value).alias("std"), F.sum(value).alias("total"), F.count(value).alias("length"))


def graph_properties(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: n, m, edge probability, n p, n p / ln n, average degree, sparsity, components."""
    one = parts.agg(F.count("*").alias("n"), F.countDistinct("component").alias("components")).crossJoin(edges.agg(F.count("*").alias("m")))
    p = F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return one.select(
        "n", "m", "components", p.alias("probability"), (F.col("n") * p).alias("np"), (F.col("n") * p / F.ln("n")).alias("np_ln"),
        F.when(F.col("n") < 2, 0.0).otherwise(2.0 * F.col("m") / F.col("n")).alias("avg_degree"), (F.ln(F.col("m") / F.col("n")) / F.ln(F.ln("n"))).alias("sparsity"),
    )


def vertex_partition_stats(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Per value: vertices, inner edges, edges to other values."""
    s, d = (values.select(F.col("id").alias(c), F.col("value").alias(f"v_{c}")) for c in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    inner = e.filter("v_src = v_dst").groupBy(F.col("v_src").alias("value")).agg(F.count("*").alias("e"))
    outer = e.filter("v_src <> v_dst").select(F.explode(F.array("v_src", "v_dst")).alias("value")).groupBy("value").agg(F.count("*").alias("meta"))
    return values.groupBy("value").agg(F.count("*").alias("v")).join(inner, "value", "left").join(outer, "value", "left").fillna({"e": 0, "meta": 0})


def clones(edges: DataFrame) -> DataFrame:
    """Every vertex in every layer it touches, with its highest layer and whether it is cloned."""
    c = edges.select(F.col("src").alias("id"), "layer").union(edges.select("dst", "layer")).distinct()
    top = c.groupBy("id").agg(F.max("layer").alias("highest"), F.count("*").alias("clones"))
    return c.join(top, "id")


def edge_partition_stats(edges: DataFrame) -> DataFrame:
    e = edges.groupBy("layer").agg(F.count("*").alias("e"))
    v = clones(edges).groupBy("layer").agg(F.count("*").alias("v"), F.sum((F.col("clones") > 1).cast("long")).alias("cloned"))
    return e.join(v, "layer")


def vertices_by_height(edges: DataFrame) -> DataFrame:
    """The vertices of each layer, ascending, as rows (a layer's list is not gathered)."""
    return clones(edges).select("layer", "id")


def wave_starts(levels: DataFrame) -> DataFrame:
    """First level of each wave of ``levels(wave, frag, level)``."""
    return levels.groupBy("wave").agg(F.min("level").alias("first_level"))


def level_summary(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """Per level: vertices, inner edges, forward edges, whether its wave ends there."""
    v = vertices.groupBy("level").agg(F.count("*").alias("v"), F.max("wave").alias("wave"))
    low = F.least("ls", "lt")
    e = arcs.groupBy(low.alias("level")).agg(F.sum((F.col("ls") == F.col("lt")).cast("long")).alias("e"), F.sum((F.col("ls") != F.col("lt")).cast("long")).alias("forward"))
    after = F.lead("wave").over(Window.orderBy("level"))
    return v.withColumn("ends", F.coalesce(after != F.col("wave"), F.lit(True))).join(e, "level", "left").fillna({"e": 0, "forward": 0})


def forward_by_target(arcs: DataFrame) -> DataFrame:
    return arcs.filter("ls <> lt").groupBy(F.least("ls", "lt").alias("level"), F.greatest("ls", "lt").alias("target")).agg(F.count("*").alias("forward"))


def wave_summary(vertices: DataFrame) -> DataFrame:
    """Per wave: first and last level, levels, vertices at the start and after it."""
    first = F.col("level") == F.min("level").over(Window.partitionBy("wave"))
    return vertices.withColumn("first", first).groupBy("wave").agg(F.min("level").alias("first_level"), F.max("level").alias("last_level"), F.countDistinct("level").alias("levels"), F.sum(F.col("first").cast("long")).alias("start"), F.sum((~F.col("first")).cast("long")).alias("middle"))


def wave_to_wave(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy(F.least("ws", "wt").alias("wave"), F.greatest("ws", "wt").alias("other")).agg(F.count("*").alias("edges"))


def wave_endings(arcs: DataFrame) -> DataFrame:
    """Per wave, distinct vertices of later waves next to it."""
    up = arcs.select("ws", "wt", "dst").unionAll(arcs.select("wt", "ws", "src")).toDF("w", "later", "v")
    return up.filter("w < later").select("w", "v").distinct().groupBy(F.col("w").alias("wave")).agg(F.count("*").alias("ending"))


def first_seen(arcs: DataFrame) -> DataFrame:
    """First level at which a neighbour of a strictly lower level lowers a vertex's degree."""
    up = arcs.select("ls", "lt", F.col("dst").alias("id")).unionAll(arcs.select("lt", "ls", "src"))
    return up.filter("ls < lt").groupBy("id").agg(F.min("ls").alias("first_seen"))
