"""Level-directed graphs: kinds of arcs, meta-DAGs, orders, longest paths and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import keep
from .components import component_edges
from .paths import follow, grown


def edge_waves(edges: DataFrame, waves: DataFrame) -> DataFrame:
    """Wave and fragment of an edge: the smaller of its ends'."""
    s, d = (waves.select(F.col("id").alias(c), F.struct("wave", "frag").alias(f"k_{c}")) for c in ("src", "dst"))
    k = edges.join(s, "src").join(d, "dst").withColumn("k", F.least("k_src", "k_dst"))
    return k.select(*edges.columns, "k.wave", "k.frag")


def with_levels(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of both ends, the arc turned from low to high (ties: from the smaller id)."""
    s, d = (levels.select(F.col("id").alias(c), F.col("level").alias(f"l_{c}")) for c in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    turn = (F.col("l_src") > F.col("l_dst")) | ((F.col("l_src") == F.col("l_dst")) & (F.col("src") > F.col("dst")))
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return e.select(pick("src", "dst").alias("src"), pick("dst", "src").alias("dst"), pick("l_src", "l_dst").alias("ls"), pick("l_dst", "l_src").alias("lt"))


def kind() -> Column:
    """induce (same level), span (the next), jump (beyond)."""
    gap = F.col("lt") - F.col("ls")
    return F.when(gap == 0, "induce").when(gap == 1, "span").otherwise("jump")


def level_filter(arcs: DataFrame, kinds: list[str], source: tuple[int, int], target: tuple[int, int] | None = None) -> DataFrame:
    """Arcs of some kinds whose levels lie in the given ranges."""
    out = arcs.withColumn("kind", kind()).filter(F.col("kind").isin(kinds) & F.col("ls").between(*source))
    return out.filter(F.col("lt").between(*target)) if target else out


def meta_dag(arcs: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: components of the arcs inside a level, lone vertices included; links between them by kind.

    ``touch`` counts the arcs that leave a node (our reading of that column).
    """
    inner = arcs.filter("ls = lt")
    parts = levels.join(component_edges(inner), "id", "left").select("id", "level", F.coalesce("component", "id").alias("node"))
    parts = keep(parts, "dag-nodes")
    e = inner.join(parts.select(F.col("id").alias("src"), "node"), "src").groupBy("node").agg(F.count("*").alias("e"))
    s, d = (parts.select(F.col("id").alias(c), F.col("node").alias(f"n_{c}")) for c in ("src", "dst"))
    cross = arcs.filter("ls <> lt").join(s, "src").join(d, "dst")
    links = cross.groupBy(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "ls", "lt").agg(F.count("*").alias("e")).withColumn("kind", kind())
    touch = cross.select(F.explode(F.array("n_src", "n_dst")).alias("node")).groupBy("node").agg(F.count("*").alias("touch"))
    nodes = parts.groupBy("node", "level").agg(F.count("*").alias("v")).join(e, "node", "left").join(touch, "node", "left").fillna({"e": 0, "touch": 0})
    return nodes, links.select("src", "dst", "e", "kind")


def regroup(nodes: DataFrame, links: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one ``group`` summed into one, links re-keyed and summed; links inside a group count as ``meta_e``."""
    s, d = (nodes.select(F.col("node").alias(c), F.col(group).alias(f"g_{c}")) for c in ("src", "dst"))
    l = links.join(s, "src").join(d, "dst")  # noqa: E741
    inside = l.filter("g_src = g_dst").groupBy(F.col("g_src").alias(group)).agg(F.count("*").alias("meta_e"), F.sum("e").alias("_e"))
    out = nodes.groupBy(group).agg(F.sum("v").alias("v"), F.sum("e").alias("e"), F.count("*").alias("meta_v")).join(inside, group, "left").fillna({"meta_e": 0, "_e": 0})
    out = out.withColumn("e", F.col("e") + F.col("_e")).drop("_e")
    return out, l.filter("g_src <> g_dst").groupBy(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).agg(F.sum("e").alias("e"), F.count("*").alias("meta_e"))


def inside(nodes: DataFrame, links: DataFrame, group: str, values: list) -> tuple[DataFrame, DataFrame]:
    """The nodes of some groups, and the links with both ends among them."""
    own = nodes.filter(F.col(group).isin(values))
    s, d = (own.select(F.col("node").alias(c)) for c in ("src", "dst"))
    return own, links.join(s, "src", "left_semi").join(d, "dst", "left_semi")


def top_source_links(arcs: DataFrame) -> DataFrame:
    """The spanning links by top sources; our reading: every arc to the next level."""
    return arcs.filter(F.col("lt") == F.col("ls") + 1).select("src", "dst")


def chosen_form(nodes: DataFrame, links: DataFrame, limit: int = 8192) -> DataFrame:
    """The links of the compressed form that is shown: by wcc, by windows of an edge cut, or by level."""
    by_wcc, spans = regroup(nodes, links, "wcc")[1], links.count()
    cut = edge_cut(nodes, links, limit)
    by_window = regroup(cut, links, "cut")[1]
    form = representation(by_wcc.limit(limit).count(), spans, by_window.limit(limit).count(), limit)
    return {"wcc": by_wcc, "edge_cut": by_window, "wave": regroup(nodes, links, "level")[1]}[form]


def edge_cut(nodes: DataFrame, links: DataFrame, limit: int = 8192) -> DataFrame:
    """Window of levels that each node is merged into, so that fewer than ``limit`` links join the windows (our own rule).

    The width of the windows doubles until the links fit; links are counted once by the levels they join.
    """
    l = nodes.select(F.col("node").alias("src"), F.col("level").alias("ls"))  # noqa: E741
    r = nodes.select(F.col("node").alias("dst"), F.col("level").alias("lt"))
    by_level = keep(links.join(l, "src").join(r, "dst").groupBy("ls", "lt").agg(F.count("*").alias("n")), "level-links")
    width = 1
    while by_level.filter(F.floor(F.col("ls") / width) != F.floor(F.col("lt") / width)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >= limit:
        width *= 2
    return nodes.withColumn("cut", F.floor(F.col("level") / width).cast("long"))


def check_sizes(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges inside nodes, in links, in the building, and whether the first two make the third."""
    a = nodes.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("inside"))
    b = links.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("between"))
    return a.crossJoin(b).crossJoin(edges.agg(F.count("*").alias("edges"))).withColumn("holds", F.col("inside") + F.col("between") == F.col("edges"))


def topological_levels(arcs: DataFrame) -> DataFrame:
    """Kahn layers of an acyclic graph: ``id, level``; vertices on cycles get none."""
    left = keep(arcs.select("src", "dst").distinct(), "arcs")
    todo = keep(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct(), "todo")
    out, level = None, 0
    while True:
        front = keep(todo.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level).cast("long")), "front")
        if front.isEmpty():
            return out if out is not None else front
        out = grown(out, front, level)
        done = front.select("id")
        todo = keep(todo.join(done, "id", "left_anti"), "todo")
        left = keep(left.join(done, left["src"] == done["id"], "left_anti"), "arcs")
        level += 1


def span_dag(arcs: DataFrame, levels: DataFrame) -> DataFrame:
    """Arcs that lead to the next level."""
    s, d = levels.toDF("src", "ls"), levels.toDF("dst", "lt")
    return arcs.join(s, "src").join(d, "dst").filter("lt = ls + 1").select(*arcs.columns)


def longest_paths(arcs: DataFrame) -> DataFrame:
    """``id, up, down``: most arcs of a path that ends, and that begins, at each vertex of an acyclic graph."""

    def depth(a: DataFrame) -> DataFrame:
        # a Kahn layer is the length of the longest path from a source
        return topological_levels(a)

    down = depth(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("level", "down")
    return depth(arcs).withColumnRenamed("level", "up").join(down, "id")


def longest_path(arcs: DataFrame) -> DataFrame:
    """The arcs of one longest path (ties: smallest ids): ``pos, src, dst``."""
    d = keep(longest_paths(arcs), "depths")
    best = d.agg(F.max(F.col("up") + F.col("down"))).first()[0]
    on = d.filter(F.col("up") + F.col("down") == best)
    s, t = on.select(F.col("id").alias("src"), F.col("up").alias("us")), on.select(F.col("id").alias("dst"), F.col("up").alias("ut"))
    steps = arcs.join(s, "src").join(t, "dst").filter("ut = us + 1").groupBy("src", "us").agg(F.min("dst").alias("dst"))
    steps = keep(steps, "steps")
    start = on.filter("up = 0").agg(F.min("id").alias("id")).filter("id IS NOT NULL")
    path = follow(steps.select(F.col("src").alias("id"), F.col("dst").alias("to")), start)
    return steps.join(path.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("us").alias("pos"), "src", "dst")


def natural_weights(arcs: DataFrame) -> DataFrame:
    """Weight 1 at each source, passed on in equal parts along the arcs, level by level."""
    levels = keep(topological_levels(arcs), "levels")
    out_degree = arcs.groupBy("src").agg(F.count("*").alias("d"))
    top = levels.agg(F.max("level")).first()[0] or 0
    weight = levels.filter("level = 0").select("id", F.lit(1.0).alias("w"))
    up = keep(arcs.join(levels.select(F.col("id").alias("dst"), F.col("level").alias("lt")), "dst").join(out_degree, "src"), "up")
    for level in range(1, top + 1):
        new = up.filter(F.col("lt") == level).join(weight.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") / F.col("d")).alias("w"))
        weight = keep(weight.unionByName(new), "weights")
    return weight


def search_expand(edges: DataFrame, hits: DataFrame, steps: int) -> DataFrame:
    """Vertices reached from the hits by step; weight 1 of each hit goes in equal parts to neighbours not yet reached; ``cut`` counts those."""
    from .edges import both_ways

    adj = keep(both_ways(edges), "adjacency")
    reached = keep(hits.select("id", F.lit(0).cast("long").alias("step"), F.lit(1.0).alias("w")).distinct(), "reached")
    for n in range(1, steps + 1):
        front = reached.filter(F.col("step") == n - 1)
        out = adj.join(front.select(F.col("id").alias("src"), "w"), "src").join(reached.select(F.col("id").alias("dst")), "dst", "left_anti")
        fan = out.groupBy("src").agg(F.count("*").alias("fan"))
        new = out.join(fan, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") / F.col("fan")).alias("w"))
        reached = keep(reached.unionByName(new.select("id", F.lit(n).cast("long").alias("step"), "w")), "reached")
    beyond = adj.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("cut"))
    return reached.join(beyond, "id", "left").fillna({"cut": 0})


def _connecting(base: DataFrame, extra: DataFrame, order: list[str]) -> DataFrame:
    """Of ``extra`` the arcs that join components of ``base``: each round every component takes its first in ``order`` (Boruvka)."""
    chosen = None
    extra = keep(extra, "extra")
    while True:
        used = base if chosen is None else base.unionByName(chosen.select("src", "dst"))
        parts = keep(component_edges(used), "parts")
        s, d = (parts.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")) for c in ("src", "dst"))
        open_ = extra.join(s, "src", "left").join(d, "dst", "left").withColumns({"c_src": F.coalesce("c_src", "src"), "c_dst": F.coalesce("c_dst", "dst")}).filter("c_src <> c_dst")
        each = open_.select("*", F.explode(F.array("c_src", "c_dst")).alias("c"))
        first = each.groupBy("c").agg(F.min(F.struct(*order, "src", "dst")).alias("m")).select("m.*").distinct()
        new = keep(extra.join(first.select("src", "dst"), ["src", "dst"], "left_semi"), "chosen")
        if new.isEmpty():
            return chosen if chosen is not None else new
        chosen = new if chosen is None else keep(chosen.unionByName(new).distinct(), "chosen")


def connect_by_jumps(arcs: DataFrame) -> DataFrame:
    """Jump arcs that connect the components of the span arcs, the shortest first."""
    k = arcs.withColumn("kind", kind()).withColumn("gap", F.col("lt") - F.col("ls"))
    return _connecting(k.filter("kind = 'span'").select("src", "dst"), k.filter("kind = 'jump'"), ["gap"]).select("src", "dst", "gap")


def dag_cover(arcs: DataFrame) -> DataFrame:
    """Arcs inside a level or to the next, and the least others that connect them."""
    k = arcs.withColumn("gap", F.col("lt") - F.col("ls"))
    near = k.filter("gap <= 1")
    far = _connecting(near.select("src", "dst"), k.filter("gap > 1"), ["gap"])
    return near.select("src", "dst", "gap").unionByName(far.select("src", "dst", "gap"))


def direction(edges: DataFrame, values: DataFrame) -> DataFrame:
    s, d = (values.select(F.col("id").alias(c), F.col("value").alias(f"v_{c}")) for c in ("src", "dst"))
    return edges.join(s, "src").join(d, "dst").select("src", "dst", F.signum((F.col("v_dst") - F.col("v_src")).cast("double")).cast("int").alias("direction"))


def best_by_weight(weights: DataFrame) -> DataFrame:
    from .ranking import log_top

    return log_top(weights, [], [F.desc("w"), F.col("id")])


def representation(wcc_links: int, span_links: int, cut_links: int, limit: int = 8192) -> str:
    """Which compressed form of a meta-DAG is shown."""
    if wcc_links < limit or span_links < limit:
        return "wcc"
    return "edge_cut" if cut_links < limit else "wave"


def waves_of_levels(levels: DataFrame) -> DataFrame:
    """Whether a level begins a new wave."""
    return levels.withColumn("starts", F.coalesce(F.lag("wave").over(Window.orderBy("level")) != F.col("wave"), F.lit(True)))
