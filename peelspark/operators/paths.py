"""Searches, trees, path covers and blocks."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import drop, keep
from .components import PART, component_edges, forest
from .edges import both_ways, sanitize
from .ranking import row_numbers

#: Edges of a component that one task searches for blocks (about 150 bytes each while it does).
BLOCK_EDGES = 1 << 20


def bfs(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, max_steps: int | None = None) -> DataFrame:
    """``id, dist, parent`` of what is reached; the parent is the smallest of the previous step.

    A step joins the last frontier only; with targets the search ends once all
    of them are reached.
    """
    adj = keep(both_ways(edges), "adjacency")
    front = keep(sources.select("id").distinct().select("id", F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("parent")), "front")
    reached, step = front, 0
    while max_steps is None or step < max_steps:
        step += 1
        near = adj.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = keep(near.join(reached.select("id"), "id", "left_anti").select("id", F.lit(step).cast("long").alias("dist"), "parent"), "front")
        if new.isEmpty():
            break
        # a table each few steps, so that the union stays short
        reached = reached.unionByName(new) if step % 8 else keep(reached.unionByName(new), "reached")
        front = new
        if targets is not None and targets.join(reached, "id", "left_anti").isEmpty():
            break
    return reached


def grown(out: DataFrame | None, new: DataFrame, step: int) -> DataFrame:
    """The rows so far and the new ones, a table each few steps, so that the union stays short."""
    if out is None:
        return new
    return out.unionByName(new) if step % 8 else keep(out.unionByName(new), "grown")


def follow(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts(..., id)`` and all that ``links(id, to)``, one for each id, lead to from there, other columns along.

    The links are doubled in length with each step, so that steps grow with the
    logarithm of the longest way.
    """
    others = [c for c in starts.columns if c != "id"]
    jump, on = keep(links.filter("to IS NOT NULL").select("id", "to"), "links"), keep(starts, "followed")
    while True:
        new = keep(on.join(jump, "id").select(*others, F.col("to").alias("id")), "reached")
        if new.isEmpty():
            return on
        on = keep(on.unionByName(new).distinct(), "followed")
        jump = keep(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("beyond")), "to").select("id", F.col("beyond").alias("to")), "links")


def _paths_up(tree: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """``key, path`` from the root of a search tree to each of ``ends(key, id)``."""
    on = follow(tree.select("id", F.col("parent").alias("to")), ends.select(key, "id")).join(tree.select("id", "dist"), "id")
    return on.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "id"))), lambda x: x["id"]).alias("path"))


def shortest_paths(edges: DataFrame, source: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, path`` from a source to each reachable target."""
    tree = keep(bfs(edges, source, targets), "tree")
    ends = targets.select("id").distinct().join(tree, "id", "left_semi").select(F.col("id").alias("target"), "id")
    return _paths_up(tree, ends, "target").select(F.col("target").alias("id"), "path")


def spanning_tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Tree arcs of the search from ``root``."""
    return bfs(edges, root).filter("parent IS NOT NULL").select(F.col("parent").alias("src"), F.col("id").alias("dst"))


def dijkstra(streets: DataFrame, source: int, target: int) -> DataFrame:
    """``pos, id, dist`` along the shortest path in each street network ``streets(net, src, dst, weight)``; a network is a few hundred rows."""

    def walk(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for s, d, w in zip(g["src"], g["dst"], g["weight"], strict=True):
            near.setdefault(s, []).append((d, w))
            near.setdefault(d, []).append((s, w))
        best, heap = {}, [(0.0, source, source)]
        while heap:
            dist, v, parent = heapq.heappop(heap)
            if v in best:
                continue
            best[v] = (dist, parent)
            for to, w in near.get(v, ()):
                if to not in best:
                    heapq.heappush(heap, (dist + w, to, v))
        path = []
        if target in best and source in near:
            v = target
            while True:
                path.append((v, best[v][0]))
                if v == source:
                    break
                v = best[v][1]
        path.reverse()
        return pd.DataFrame({"net": key[0], "pos": range(len(path)), "id": [v for v, _ in path], "dist": [d for _, d in path]})

    return streets.groupBy("net").applyInPandas(walk, "net long, pos long, id long, dist double")


def minimum_tree(streets: DataFrame, positions: DataFrame, root: int) -> DataFrame:
    """Prim's tree of each network from ``root``, in the order of a walk that takes the sharpest left turn first: ``net, pos, id, parent``."""
    data = streets.join(positions.toDF("src", "xs", "ys"), "src").join(positions.toDF("dst", "xd", "yd"), "dst")

    def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[float, int]]] = {}
        at = {}
        for r in g.itertuples(index=False):
            near.setdefault(r.src, []).append((r.weight, r.dst))
            near.setdefault(r.dst, []).append((r.weight, r.src))
            at[r.src], at[r.dst] = (r.xs, r.ys), (r.xd, r.yd)
        children: dict[int, list[int]] = {}
        seen, heap = set(), [(0.0, root, None)]
        while heap:
            _, v, parent = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            if parent is not None:
                children.setdefault(parent, []).append(v)
            for w, to in near.get(v, ()):
                if to not in seen:
                    heapq.heappush(heap, (w, to, v))
        out, stack = [], [(root, None, 0.0)] if root in near else []
        while stack:
            v, parent, heading = stack.pop()
            out.append((key[0], len(out), v, parent))
            turn = lambda c: (math.atan2(at[c][1] - at[v][1], at[c][0] - at[v][0]) - heading) % (2 * math.pi)  # noqa: B023, E731
            for c in sorted(children.get(v, ()), key=lambda c: (turn(c), c)):
                stack.append((c, v, math.atan2(at[c][1] - at[v][1], at[c][0] - at[v][0])))
        return pd.DataFrame(out, columns=["net", "pos", "id", "parent"]).astype({"parent": "Int64"})

    return data.groupBy("net").applyInPandas(grow, "net long, pos long, id long, parent long")


def _blocks_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of the edges, sorted and of whole components, the place of its block's first edge."""
    ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    n, m = len(ids), len(u)
    by = np.argsort(ends, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(ends, minlength=n))))
    a, b = ends[:m].astype(np.int32), ends[m:].astype(np.int32)
    # the neighbours of x and the edges to them stand from start[x] on
    to, edge = memoryview(np.concatenate((b, a))[by]), memoryview((by % m).astype(np.int32))
    del ends, by, a, b
    start, block = memoryview(start), np.full(m, -1, np.int32)
    order, low, rest = memoryview(np.zeros(n, np.int32)), memoryview(np.zeros(n, np.int32)), memoryview(np.array(start[:n]))
    found, stack, came, held = 0, [], [], []
    for root in range(n):
        if order[root]:
            continue
        found += 1
        order[root] = low[root] = found
        stack, came = [root], [-1]
        while stack:
            x, by_edge = stack[-1], came[-1]
            at, end, down = rest[x], start[x + 1], False
            own, least = order[x], low[x]
            while at < end and not down:
                y, i = to[at], edge[at]
                at += 1
                if i == by_edge:
                    continue
                if not order[y]:
                    found += 1
                    order[y] = low[y] = found
                    held.append(i)
                    stack.append(y)
                    came.append(i)
                    down = True
                elif order[y] < own:
                    held.append(i)
                    least = min(least, order[y])
            rest[x], low[x] = at, least
            if down:
                continue
            stack.pop()
            came.pop()
            if stack:
                p = stack[-1]
                low[p] = min(low[p], least)
                if least >= order[p]:  # p separates what was found since
                    k = len(held) - 1
                    while held[k] != by_edge:
                        k -= 1
                    block[held[k:]] = min(held[k:])
                    del held[k:]
    return block


def _wide_blocks(edges: DataFrame) -> DataFrame:
    """``src, dst, b_src, b_dst`` (the block's first edge) of components of any size, in steps of whole tables.

    An edge outside a search tree closes a way in the tree, and blocks are what
    ways that share an edge make.  Two vertices of equal distance are linked if
    one way holds the tree edges above both.  Links rise to the parents, level by
    level, until they meet; of the links of a level as many as a forest has are enough.
    """
    edges = keep(edges.select("src", "dst", "component"), "edges")
    roots = edges.groupBy("component").agg(F.min("src").alias("id")).select("id")
    tree = keep(bfs(edges, roots).select("id", "dist", "parent"), "tree")
    s, d = (tree.select(F.col("id").alias(c), F.col("dist").alias(f"{c}_dist"), F.col("parent").alias(f"{c}_parent")) for c in ("src", "dst"))
    placed = edges.select("src", "dst").join(s, "src").join(d, "dst")
    # the deeper end is named; a tree edge is named after its child
    deep = F.col("src_dist") > F.col("dst_dist")
    placed = placed.select(
        "src", "dst", F.when(deep, F.col("src")).otherwise(F.col("dst")).alias("child"), F.when(deep, F.col("dst")).otherwise(F.col("src")).alias("other"),
        F.when(deep, F.col("src_parent")).otherwise(F.col("dst_parent")).alias("parent"), F.greatest("src_dist", "dst_dist").alias("dist"), (F.col("src_dist") == F.col("dst_dist")).alias("level"),
    )
    placed = keep(placed, "placed")
    closing = placed.filter("level OR parent <> other")
    first = keep(closing.select(F.when(F.col("level"), F.col("dist")).otherwise(F.col("dist") - 1).alias("dist"), F.when(F.col("level"), F.col("child")).otherwise(F.col("parent")).alias("u"), F.col("other").alias("v")), "links")
    same = [keep(closing.filter("NOT level").select(F.col("child").alias("u"), F.col("parent").alias("v")).distinct(), "same")]
    risen, kept = None, [first]
    for level in range(first.agg(F.max("dist")).first()[0] or 0, 0, -1):
        now = first.filter(F.col("dist") == level).select("u", "v")
        now = forest(now if risen is None else now.unionByName(risen))
        above = tree.filter(F.col("dist") == level)
        up = now.join(above.select(F.col("id").alias("u"), F.col("parent").alias("u_up")), "u").join(above.select(F.col("id").alias("v"), F.col("parent").alias("v_up")), "v")
        up = keep(up, "risen")
        drop(now)
        apart = up.filter("u_up <> v_up")
        same += [up.select("u", "v"), apart.select(F.col("u"), F.col("u_up").alias("v")).unionByName(apart.select(F.col("v").alias("u"), F.col("v_up").alias("v"))).distinct()]
        kept.append(up)
        risen = apart.select(F.col("u_up").alias("u"), F.col("v_up").alias("v"))
    joined = same[0]
    for x in same[1:]:
        joined = joined.unionByName(x)
    of = component_edges(joined.toDF("src", "dst"))
    named = keep(placed.select("src", "dst", "child").join(of.select(F.col("id").alias("child"), "component"), "child", "left").select("src", "dst", F.coalesce("component", "child").alias("label")), "labels")
    names = keep(named.groupBy("label").agg(F.min(F.struct("src", "dst")).alias("first"), F.count("*").alias("n")).select("label", F.col("first.src").alias("b_src"), F.col("first.dst").alias("b_dst"), "n"), "names")
    drop(*kept, same[0], placed, edges, tree)
    # few blocks are large; their rows stay where they are
    large, small = F.broadcast(names.filter(F.col("n") > PART)), names.filter(F.col("n") <= PART)
    out = ["src", "dst", "b_src", "b_dst"]
    return named.join(large, "label").select(*out).unionAll(named.join(large.select("label"), "label", "left_anti").join(small, "label").select(*out))


def blocks(edges: DataFrame) -> DataFrame:
    """``src, dst, block``: biconnected blocks, each named after its smallest edge.

    Components of at most ``BLOCK_EDGES`` edges are searched whole, several in one
    task; larger ones go by steps of whole tables.  Both ways give the same rows.
    """
    edges = keep(sanitize(edges), "edges")
    parts = component_edges(edges)
    placed = keep(edges.join(parts.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst"), "placed")
    drop(edges)
    large = placed.groupBy("component").count().filter(F.col("count") > BLOCK_EDGES).select("component")
    large = F.broadcast(keep(large, "large"))
    small = placed.join(large, "component", "left_anti")
    shards = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * placed.count() // max(1, BLOCK_EDGES)))

    def split(g: pd.DataFrame) -> pd.DataFrame:
        # sorted rows make the names independent of the partitions
        g = g[["src", "dst"]].sort_values(["src", "dst"], ignore_index=True)
        u, v = g["src"].to_numpy(), g["dst"].to_numpy()
        block = _blocks_of(u, v)
        return g.assign(b_src=u[block], b_dst=v[block])

    dealt = small.withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInPandas(split, "src long, dst long, b_src long, b_dst long")
    if not large.isEmpty():
        found = found.unionByName(_wide_blocks(placed.join(large, "component")))
    return found.select("src", "dst", F.concat_ws("-", "b_src", "b_dst").alias("block"))


def articulation_points(found: DataFrame) -> DataFrame:
    held = found.select("block", F.col("src").alias("id")).union(found.select("block", "dst")).distinct()
    return held.groupBy("id").agg(F.count("*").alias("blocks")).filter("blocks > 1").select("id")


def sparse_net(edges: DataFrame, most_paths: int | None = None) -> DataFrame:
    """Path cover of every component: ``path_id, path``.

    The first path of a component joins two far vertices (found by two searches
    that begin at its largest vertex); then a path from the vertex farthest from
    the net is added until every vertex is on the net or next to it.  Ties go to
    the smallest id.  All components search at once; the net is a table.
    """
    edges = keep(sanitize(edges), "edges")
    parts = keep(component_edges(edges), "parts")

    def farthest(tree: DataFrame) -> DataFrame:
        """``component, id, dist`` of the farthest vertex of each component."""
        far = tree.select("id", "dist").join(parts, "id").groupBy("component").agg(F.max_by("id", F.struct("dist", -F.col("id"))).alias("id"), F.max("dist").alias("dist"))
        return keep(far, "farthest")

    a = farthest(bfs(edges, parts.groupBy("component").agg(F.max("id").alias("id"))))
    tree = keep(bfs(edges, a), "tree")
    new = keep(_paths_up(tree, farthest(tree), "component").withColumn("round", F.lit(0)), "paths")
    paths, net, n = None, None, 0
    while not new.isEmpty():
        paths = grown(paths, new, n)
        on = new.select(F.explode("path").alias("id"))
        net = keep((on if net is None else net.unionByName(on)).distinct(), "net")
        n += 1
        if most_paths is not None and n > most_paths:
            break
        tree = keep(bfs(edges, net), "net-distances")
        far = farthest(tree).filter("dist > 1")
        # from the farthest vertex to the net
        new = keep(_paths_up(tree, far, "component").select("component", F.reverse("path").alias("path"), F.lit(n).alias("round")), "paths")
    if paths is None:
        return edges.sparkSession.createDataFrame([], "path_id long, path array<long>")
    return row_numbers(paths, [F.col("round"), F.col("component")], "path_id").select(F.col("path_id").cast("long").alias("path_id"), "path")


def sparse_net_approximate(edges: DataFrame) -> DataFrame:
    """The same, ended after ``ln(n)^2`` paths."""
    from .edges import endpoints

    n = endpoints(edges).count()
    return sparse_net(edges, int(math.log(max(n, 1)) ** 2))


def vertex_paths(paths: DataFrame) -> DataFrame:
    """``id, path_id, pos`` of every vertex on a path."""
    return paths.select("path_id", F.posexplode("path").alias("pos", "id"))


def assign_to_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Vertices off the net with the path that most of their neighbours lie on (ties: the smallest path)."""
    on = vertex_paths(paths).select("id", "path_id").distinct()
    near = both_ways(edges).join(on.withColumnRenamed("id", "dst"), "dst").join(on.select(F.col("id").alias("src")).distinct(), "src", "left_anti")
    n = near.groupBy(F.col("src").alias("id"), "path_id").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max_by("path_id", F.struct("n", -F.col("path_id"))).alias("path_id"), F.max("n").alias("n"))


def nearest_landmark(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """``id, dist, landmark``: the nearest landmark (ties: the smallest)."""
    adj = keep(both_ways(edges), "adjacency")
    front = keep(landmarks.select("id", F.lit(0).cast("long").alias("dist"), F.col("id").alias("landmark")).distinct(), "front")
    reached, step = front, 0
    while True:
        step += 1
        near = adj.join(front.select(F.col("id").alias("src"), "landmark"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("landmark").alias("landmark"))
        front = keep(near.join(reached.select("id"), "id", "left_anti").select("id", F.lit(step).cast("long").alias("dist"), "landmark"), "front")
        if front.isEmpty():
            return reached
        reached = keep(reached.unionByName(front), "reached")


def path_midpoints(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Vertices off the net with the middle (rounded down) of the places of their neighbours on each path."""
    on = vertex_paths(paths)
    near = both_ways(edges).join(on.withColumnRenamed("id", "dst"), "dst").join(on.select(F.col("id").alias("src")).distinct(), "src", "left_anti")
    return near.groupBy(F.col("src").alias("id"), "path_id").agg(F.floor((F.min("pos") + F.max("pos")) / 2).cast("long").alias("pos"))


def solar_merge(edges: DataFrame, seed: int = 1) -> DataFrame:
    """``id, sun``: a step of coarsening; suns are local least hashes over two steps, others join the nearest sun."""
    adj = keep(both_ways(edges), "adjacency")
    v = adj.select(F.col("src").alias("id")).distinct().withColumn("h", F.struct(F.xxhash64(F.lit(seed), "id"), "id"))
    least = v
    for _ in range(2):
        near = adj.join(least.select(F.col("id").alias("dst"), "h"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("h").alias("n"))
        least = least.join(near, "id").select("id", F.least("h", "n").alias("h"))
    suns = v.join(least.withColumnRenamed("h", "m"), "id").filter("h = m").select("id")
    return nearest_landmark(edges, suns).select("id", F.col("landmark").alias("sun"), "dist")


def next_leaf(edges: DataFrame) -> DataFrame:
    """``id, step``: the step at which leaves (at most one neighbour left) are peeled; what is left at last gets -1."""
    left = keep(sanitize(edges), "left")
    out = None
    step = 0
    todo = keep(both_ways(left).select(F.col("src").alias("id")).distinct(), "todo")
    while True:
        degree = both_ways(left).groupBy(F.col("src").alias("id")).count()
        leaf = keep(todo.join(degree, "id", "left").filter("count IS NULL OR count <= 1").select("id", F.lit(step).cast("long").alias("step")), "leaves")
        if leaf.isEmpty():
            rest = todo.select("id", F.lit(-1).cast("long").alias("step"))
            return rest if out is None else out.unionByName(rest)
        out = grown(out, leaf, step)
        ids = leaf.select("id")
        todo = keep(todo.join(ids, "id", "left_anti"), "todo")
        left = keep(left.join(ids, left["src"] == ids["id"], "left_anti").join(ids, left["dst"] == ids["id"], "left_anti"), "left")
        step += 1


def expand_long_path(path: DataFrame, arcs: DataFrame, inner: DataFrame) -> DataFrame:
    """Vertices of a longest path of nodes: per consecutive arcs the shortest way inside the node they share.

    ``path(pos, src, dst)`` are nodes, ``arcs(src, dst, n_src, n_dst)`` vertex
    arcs with their nodes, ``inner(node, src, dst)`` edges inside nodes.
    """
    steps = path.join(arcs, (path["src"] == arcs["n_src"]) & (path["dst"] == arcs["n_dst"])).groupBy("pos", arcs["n_src"], arcs["n_dst"]).agg(F.min(F.struct(arcs["src"], arcs["dst"])).alias("m"))
    line = keep(steps.select("pos", "n_src", "n_dst", "m.src", "m.dst"), "line")
    # a path visits a node once, so the ways inside all of them are searched together
    leave = line.select((F.col("pos") - 1).alias("pos"), F.col("src").alias("leave"))
    joins = keep(line.select("pos", F.col("n_dst").alias("node"), F.col("dst").alias("enter")).join(leave, "pos"), "joins")
    own = inner.join(joins.select("node"), "node", "left_semi").select("src", "dst")
    tree = keep(bfs(own, joins.select(F.col("enter").alias("id")), joins.select(F.col("leave").alias("id"))), "ways")
    ways = follow(tree.select("id", F.col("parent").alias("to")), joins.select("pos", F.col("leave").alias("id"))).join(tree.select("id", "dist"), "id").select("pos", "dist", "id")
    zero = F.lit(0).cast("long").alias("dist")
    ends = line.agg(F.min_by("src", "pos").alias("first"), F.max_by("dst", "pos").alias("last"), F.max("pos").alias("most")).filter("most IS NOT NULL")
    ends = ends.select(F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("pos"), zero, F.col("first").alias("id")), F.struct(F.col("most").alias("pos"), zero, F.col("last").alias("id")))).alias("e")).select("e.*")
    return row_numbers(ways.unionByName(ends), [F.col("pos"), F.col("dist")], "n").select(F.col("n").cast("long").alias("pos"), "id")
