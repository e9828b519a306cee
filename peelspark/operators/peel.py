"""Degree peeling: coreness, fixed-point layers, waves and fragments.

All three are decided inside a connected component on its own.  Components of
at most ``LOCAL`` edges are therefore peeled whole in one task each (bounded
memory, no iteration over jobs); larger ones go through bulk-synchronous
DataFrame steps whose state is a table in the shared folder.  Both ways give
the same rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import drop, keep
from .components import connected_components
from .edges import both_ways, sanitize

#: Edges of a component that one task may hold (about 50 bytes each while it is peeled).
LOCAL = 2_000_000


def _by_component(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges with their component, of small and of large components; ``keys`` are kept apart."""
    edges = keep(edges, "edges")
    if keys:
        tag = lambda c: F.struct(*(F.col(k) for k in keys), F.col(c).alias("vertex"))
        parts = connected_components(edges.select(tag("src").alias("u"), tag("dst").alias("v")))
        parts = parts.select(*(F.col(f"id.{k}").alias(k) for k in keys), F.col("id.vertex").alias("src"), F.col("component.vertex").alias("component"))
    else:
        parts = connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).select(F.col("id").alias("src"), "component")
    placed = keep(edges.join(parts, [*keys, "src"]), "placed")
    drop(edges)
    sizes = placed.groupBy(*keys, "component").count()
    large = sizes.filter(F.col("count") > LOCAL).select(*keys, "component")
    on = [*keys, "component"]
    return placed.join(large, on, "left_anti"), placed.join(large, on, "left_semi")


def _in_shards(small: DataFrame, on: list[str], peel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``peel`` of the whole components that a shard holds: some ``LOCAL / 2`` edges, and a component more at most where one is large."""
    shards = max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * small.count() // max(1, LOCAL)))
    dealt = small.withColumn("shard", F.pmod(F.xxhash64(*on), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda g: peel(g.drop(columns="shard")), schema)


def _numbered(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate((g["src"].to_numpy(), g["dst"].to_numpy())), return_inverse=True)
    return ids, at[: len(g)], at[len(g) :]


class Adjacency:
    """Neighbours of each of ``n`` vertices, in one array."""

    def __init__(self, u: np.ndarray, v: np.ndarray, n: int) -> None:
        ends = np.concatenate((u, v))
        order = np.argsort(ends, kind="stable")
        self.n, self.ends, self.to = n, ends[order], np.concatenate((v, u))[order]
        self._place()

    def _place(self) -> None:
        self.degree = np.bincount(self.ends, minlength=self.n)
        self.start = np.concatenate(([0], np.cumsum(self.degree)[:-1]))

    def less(self, gone: np.ndarray) -> None:
        """Remove the entries (both ways of an edge) where ``gone``."""
        self.ends, self.to = self.ends[~gone], self.to[~gone]
        self._place()

    def near(self, at: np.ndarray, degree: np.ndarray) -> np.ndarray:
        """All neighbours of ``at``, with repeats."""
        if len(at) == 1:
            first = self.start[at[0]]
            return self.to[first : first + degree[at[0]]]
        n = degree[at]
        return self.to[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _once(x: np.ndarray) -> np.ndarray:
    return x if len(x) < 2 else np.unique(x)


def peeled(adj: Adjacency) -> np.ndarray:
    """Coreness of each vertex, 0 without edges; the work is proportional to the edges.

    Each step removes the vertices that the threshold no longer holds and looks
    at their neighbours alone; a look at all vertices left comes with each value.
    """
    degree, core, alive = adj.degree.copy(), np.zeros(adj.n, np.int64), adj.degree > 0
    left, k = np.flatnonzero(alive), 0
    while len(left):
        now = degree[left]
        k = max(k, int(now.min()))
        out = left[now <= k]
        while len(out):
            alive[out], core[out] = False, k
            near = adj.near(out, adj.degree)
            near = near[alive[near]]
            np.subtract.at(degree, near, 1)
            out = _once(near[degree[near] <= k])
        left = left[alive[left]]
    return core


def local_coreness(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Coreness of each of ``n`` vertices; 0 without edges."""
    return peeled(Adjacency(u, v, n))


def local_layers(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The layer of each edge."""
    adj, layer, left = Adjacency(u, v, n), np.zeros(len(u), np.int64), np.arange(len(u))
    while len(left):
        core = peeled(adj)
        k = core.max()
        inner = core == k
        inside = inner[u[left]] & inner[v[left]]
        layer[left[inside]] = k
        left = left[~inside]
        adj.less(inner[adj.ends] & inner[adj.to])
    return layer


def local_waves(u: np.ndarray, v: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(wave, fragment) of each vertex; the threshold is ``k``, raised to the least degree left where a wave starts."""
    adj = Adjacency(u, v, n)
    degree, alive = adj.degree.copy(), np.ones(n, bool)
    wave, frag = np.full(n, -1), np.full(n, -1)
    left, threshold, w = np.arange(n), k, 0
    out = left[:0]
    while True:
        if not len(out):  # nothing stands at the threshold: it rises
            left = left[alive[left]]
            if not len(left):
                return wave, frag
            now = degree[left]
            threshold = max(threshold, int(now.min()))
            out = left[now <= threshold]
        f, touched = 0, []
        while len(out):
            wave[out], frag[out], alive[out] = w, f, False
            near = adj.near(out, adj.degree)
            near = near[alive[near]]
            np.subtract.at(degree, near, 1)
            # what is left stood above the threshold, so only neighbours can have fallen to it or below
            now = degree[near]
            touched.append(near[now == threshold])
            out = _once(near[now < threshold])
            f += 1
        out = _once(np.concatenate(touched) if f > 1 else touched[0])
        out, w = out[alive[out]], w + 1


def coreness(edges: DataFrame) -> DataFrame:
    """``id, core`` of every vertex."""
    small, large = _by_component(sanitize(edges), [])

    def peel(g: pd.DataFrame) -> pd.DataFrame:
        ids, u, v = _numbered(g)
        return pd.DataFrame({"id": ids, "core": local_coreness(u, v, len(ids))})

    # components don't touch, so a shard is peeled as one graph
    out = _in_shards(small, ["component"], peel, "id long, core long")
    return out if large.isEmpty() else out.unionByName(wide_coreness(large.select("src", "dst")))


def wide_coreness(edges: DataFrame) -> DataFrame:
    """Coreness by repeated h-index of the neighbours' values, from the degrees down."""
    adj = keep(both_ways(edges), "adjacency")
    state = keep(adj.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core")), "cores")
    while True:
        near = adj.join(state.select(F.col("id").alias("dst"), "core"), "dst").join(state.select(F.col("id").alias("src"), F.col("core").alias("own")), "src")
        counts = near.groupBy("src", "own", F.least("core", "own").alias("x")).count()
        upward = Window.partitionBy("src").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
        new = counts.withColumn("h", F.least("x", F.sum("count").over(upward))).groupBy(F.col("src").alias("id"), "own").agg(F.max("h").alias("core"))
        new = keep(new, "cores")
        changed = new.filter("core < own").limit(1).count()
        drop(state)
        state = new.select("id", "core")
        state.kept_at = new.kept_at
        if not changed:
            return state


def fixed_point_layers(edges: DataFrame) -> DataFrame:
    """``src, dst, layer``: repeatedly the edges inside the innermost core, labelled by its degree and removed."""
    edges = sanitize(edges)
    small, large = _by_component(edges, [])

    def peel(g: pd.DataFrame) -> pd.DataFrame:
        ids, u, v = _numbered(g)
        return g[["src", "dst"]].assign(layer=local_layers(u, v, len(ids)))

    # a component's layers are the same whatever others are peeled with it
    out = _in_shards(small, ["component"], peel, "src long, dst long, layer long")
    left = large.select("src", "dst")
    while not left.isEmpty():
        core = wide_coreness(left)
        k = core.agg(F.max("core")).first()[0]
        inner = core.filter(F.col("core") == k).select("id")
        layer = keep(left.join(inner, left["src"] == inner["id"], "left_semi").join(inner, left["dst"] == inner["id"], "left_semi").withColumn("layer", F.lit(k)), "layer")
        out = out.unionByName(layer)
        left = keep(left.join(layer, ["src", "dst"], "left_anti"), "left")
    return out


def waves(layered: DataFrame) -> DataFrame:
    """``layer, id, wave, frag`` (both from 0) of every vertex of every layer of ``layered(src, dst, layer)``."""
    small, large = _by_component(layered.select("layer", "src", "dst"), ["layer"])

    def peel(g: pd.DataFrame) -> pd.DataFrame:
        # waves are counted inside each component
        g = g.sort_values(["layer", "component"], ignore_index=True)
        layer, part = g["layer"].to_numpy(), g["component"].to_numpy()
        edge = np.flatnonzero((layer[1:] != layer[:-1]) | (part[1:] != part[:-1])) + 1
        out = []
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(g)])), strict=True):
            ids, u, v = _numbered(g.iloc[a:b])
            out.append((np.full(len(ids), layer[a]), ids, *local_waves(u, v, len(ids), int(layer[a]))))
        return pd.DataFrame(dict(zip(("layer", "id", "wave", "frag"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    schema = "layer long, id long, wave long, frag long"
    out = _in_shards(small, ["layer", "component"], peel, schema)
    return out if large.isEmpty() else out.unionByName(wide_waves(large))


def wide_waves(placed: DataFrame) -> DataFrame:
    """The same for ``placed(layer, component, src, dst)`` by one synchronous step over all components at a time.

    A component moves to its next wave when its fragment is empty; its threshold
    starts at the layer and rises to its least degree where a wave starts.
    """
    on = ["layer", "component"]
    adj = keep(placed.select(*on, "src", "dst").unionByName(placed.select(*on, F.col("dst").alias("src"), F.col("src").alias("dst"))), "adjacency")
    vertices = adj.select(*on, F.col("src").alias("id")).distinct()
    state = keep(vertices.select(*on, "id", F.lit(None).cast("long").alias("wave"), F.lit(None).cast("long").alias("frag")), "waves")
    zero = F.lit(0).cast("long")
    at = keep(vertices.select(*on).distinct().select(*on, zero.alias("w"), zero.alias("f"), F.col("layer").cast("long").alias("t")), "clock")
    while True:
        left = state.filter("wave IS NULL").select(*on, "id")
        if left.isEmpty():
            return state.select("layer", "id", "wave", "frag")
        alive = adj.join(left.withColumnRenamed("id", "dst"), [*on, "dst"], "left_semi").groupBy(*on, F.col("src").alias("id")).count()
        degree = keep(left.join(alive, [*on, "id"], "left").select(*on, "id", F.coalesce("count", zero).alias("degree")), "degrees")
        least = degree.groupBy(*on).agg(F.min("degree").alias("least"))
        # components without vertices left drop out of the clock
        now = keep(at.join(least, on).withColumn("t", F.when(F.col("f") == 0, F.greatest("t", "least")).otherwise(F.col("t"))), "clock")
        out = keep(degree.join(now, on).filter(F.when(F.col("f") == 0, F.col("degree") <= F.col("t")).otherwise(F.col("degree") < F.col("t"))).select(*on, "id", "w", "f"), "out")
        moved = out.select(*on).distinct().withColumn("went", F.lit(True))
        new = keep(state.join(out, [*on, "id"], "left").select(*on, "id", F.coalesce("wave", "w").alias("wave"), F.coalesce("frag", "f").alias("frag")), "waves")
        clock = keep(now.join(moved, on, "left").select(*on, F.when(F.col("went"), F.col("w")).otherwise(F.col("w") + 1).alias("w"), F.when(F.col("went"), F.col("f") + 1).otherwise(zero).alias("f"), "t"), "clock")
        for old in (state, at, now, degree, out):
            drop(old)
        state, at = new, clock


def iterative_waves(edges: DataFrame) -> DataFrame:
    """``src, dst, round``: edges inside the last wave are labelled and removed, again and again."""
    from .components import component_edges

    left, out = keep(sanitize(edges), "left"), None
    # each round takes an edge at least
    for n in itertools.count():
        if left.isEmpty():
            break
        # thresholds rise from the least degree: layer 1 with rising thresholds is the general rule
        w = keep(waves(left.withColumn("layer", F.lit(1).cast("long"))), "waves")
        parts = component_edges(left).select("id", "component")
        last = w.join(parts, "id").withColumn("last", F.max("wave").over(Window.partitionBy("component"))).filter("wave = last").select("id")
        inside = keep(left.join(last, left["src"] == last["id"], "left_semi").join(last, left["dst"] == last["id"], "left_semi").withColumn("round", F.lit(n)), "inside")
        if inside.isEmpty():
            inside = left.withColumn("round", F.lit(n))
        out = inside if out is None else out.unionByName(inside)
        left = keep(left.join(inside, ["src", "dst"], "left_anti"), "left")
    return out if out is not None else left.withColumn("round", F.lit(0))


def iterative_edges(edges: DataFrame, decompose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``src, dst, value``: edges inside the largest value of a vertex decomposition ``(id, value)`` take it and are removed."""
    left, out = keep(sanitize(edges), "left"), None
    # each round takes an edge at least
    while not left.isEmpty():
        values = keep(decompose(left), "values")
        top = values.agg(F.max("value")).first()[0]
        most = values.filter(F.col("value") == top).select("id")
        inside = keep(left.join(most, left["src"] == most["id"], "left_semi").join(most, left["dst"] == most["id"], "left_semi").withColumn("value", F.lit(top)), "inside")
        if inside.isEmpty():
            inside = left.withColumn("value", F.lit(top))
        out = inside if out is None else out.unionByName(inside)
        left = keep(left.join(inside, ["src", "dst"], "left_anti"), "left")
    return out if out is not None else left.withColumn("value", F.lit(0))
