"""Operators that iterate; those without SQL are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import dag as D
from ..operators import edges as E
from ..operators import partition as P
from ..operators import paths as W
from ..operators import peel
from ..plans import hierarchy as H
from ..store import keep
from .base import FAR, register, rounded



def components_sql(keys: str, source: str) -> str:
    """Least reachable vertex inside equal keys, of ``source(keys, src, dst)``."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    adj = ", ".join(f"adj.{x}" for x in k)
    return (
        f"WITH RECURSIVE s AS ({source}), adj AS (SELECT {keys}, src AS a, dst AS b FROM s UNION ALL SELECT {keys}, dst, src FROM s), "
        f"r({keys}, id, component) USING KEY ({keys}, id) AS (SELECT DISTINCT {keys}, a, a FROM adj UNION SELECT {adj}, adj.b, min(r.component) FROM r JOIN adj ON {on('r', 'adj')} AND r.id = adj.a "
        f"JOIN recurring.r c ON {on('c', 'adj')} AND c.id = adj.b WHERE r.component < c.component GROUP BY {adj}, adj.b)"
    )


first = lambda e: e.agg(F.min("src").alias("id"))
register("O-cc", "forest", lambda e: C.component_edges(e), "SELECT id, component FROM forest_parts")
register("O-cc-dfs", "edges vertices", lambda e, v: C.partition_components(e, v.select("id", "value")), components_sql("value", "SELECT a.value, e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.value = b.value") + " SELECT v.id, v.value, coalesce(r.component, v.id) AS component FROM vertices v LEFT JOIN r ON v.id = r.id")
register("O-lcc", "layered", lambda e: C.component_edges(e, ("layer",)), "WITH RECURSIVE adj AS (SELECT layer, src AS a, dst AS b FROM layered UNION ALL SELECT layer, dst, src FROM layered), r(layer, id, component) USING KEY (layer, id) AS (SELECT DISTINCT layer, a, a FROM adj UNION SELECT adj.layer, adj.b, min(r.component) FROM r JOIN adj ON r.layer = adj.layer AND r.id = adj.a JOIN recurring.r c ON c.layer = adj.layer AND c.id = adj.b WHERE r.component < c.component GROUP BY adj.layer, adj.b) SELECT layer, id, component FROM r")
register("O-wcc", "wedges", lambda w: C.component_edges(w.select("src", "dst", "wave"), ("wave",)), components_sql("wave", "SELECT wave, src, dst FROM wedges") + " SELECT wave, id, component FROM r")
register("O-level-cc", "arcs", lambda a: C.component_edges(a.filter("ls = lt").select("src", "dst", F.col("ls").alias("level")), ("level",)), components_sql("level", "SELECT ls AS level, src, dst FROM arcs WHERE ls = lt") + " SELECT level, id, component FROM r")
register("O-fixedpoint", "edges", peel.fixed_point_layers)
register("O-waves", "layered", lambda e: peel.waves(keep(peel.fixed_point_layers(e), "layered")))
register("O-iter-wave", "layered", peel.iterative_waves)
register("O-iter-edge-generic", "layered", lambda e: peel.iterative_edges(e.select("src", "dst"), lambda left: peel.coreness(left).withColumnRenamed("core", "value")))
register("O-bfs", "edges", lambda e: W.bfs(e, first(e)).select("id", "dist"), "WITH RECURSIVE adj AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), r(id, dist) USING KEY (id) AS (SELECT min(src), CAST(0 AS BIGINT) FROM edges UNION SELECT adj.b, min(r.dist) + 1 FROM r JOIN adj ON r.id = adj.a LEFT JOIN recurring.r c ON c.id = adj.b WHERE c.id IS NULL GROUP BY adj.b) SELECT id, dist FROM r")
register("O-sssp-paths", "edges", lambda e: W.shortest_paths(e, first(e), e.agg(F.max("src").alias("id"))))
register("O-spanning-tree", "forest", lambda e: W.spanning_tree(e, e.select(F.col("src").alias("id")).distinct()), "SELECT src, dst FROM forest")
# one network for each supplier, of its parts in order; the way along it is the only one
register("O-dijkstra", "layered", lambda e: rounded(W.dijkstra(e.groupBy((F.col("dst") - FAR).alias("net")).agg(F.array_sort(F.collect_list("src")).alias("p")).select("net", F.posexplode(F.concat(F.array(F.lit(-1).cast("long")), "p", F.array(F.lit(FAR).cast("long")))).alias("k", "src"), "p").select("net", "src", F.coalesce(F.get("p", "k"), F.lit(FAR)).cast("long").alias("dst"), (F.col("k") + 0.5).alias("weight")).filter("src < dst"), -1, FAR)), f"WITH p AS (SELECT dst - {FAR} AS net, src AS id, row_number() OVER (PARTITION BY dst ORDER BY src) AS pos, count(*) OVER (PARTITION BY dst) AS n FROM layered) SELECT net, pos, id, round(pos * pos / 2.0, 6) AS dist FROM p UNION ALL SELECT net, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0.0 FROM p WHERE pos = 1 UNION ALL SELECT net, n + 1, {FAR}, round((n + 1) * (n + 1) / 2.0, 6) FROM p WHERE pos = 1")
register("O-mst", "positions", lambda p: W.minimum_tree(p.select(F.lit(1).cast("long").alias("net"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.abs("y") + 1).alias("weight")), p, 1))
# a star is covered by the path of its two smallest leaves, a lone edge by itself
STARS = "WITH f AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS n FROM forest) SELECT CASE WHEN count(*) = 2 THEN min(dst) || ',' || src || ',' || max(dst) ELSE src || ',' || min(dst) END AS path FROM f WHERE r <= 2 GROUP BY src"
register("O-sparsenet", "forest", lambda e: W.sparse_net(e).select(F.array_join("path", ",").alias("path")), STARS)
register("O-sparsenet-approx", "forest", lambda e: W.sparse_net_approximate(e).select(F.array_join("path", ",").alias("path")), STARS)

# paths along lines of an order stand for a path cover
lines = lambda l: l.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey"))).alias("p")).select("path_id", F.transform("p", lambda x: x["l_partkey"]).alias("path"))
PLACES = "(SELECT l_orderkey AS path_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos, l_partkey AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) d)"
register("O-edge-paths", "lineitem", lambda l: E.path_edges(lines(l)), f"WITH p AS {PLACES} SELECT a.path_id, a.pos, a.id AS src, b.id AS dst FROM p a JOIN p b ON a.path_id = b.path_id AND b.pos = a.pos + 1")
register("O-vertex-paths", "lineitem", lambda l: W.vertex_paths(lines(l)), f"SELECT path_id, pos, id FROM {PLACES} p")
register("O-path-subgraph", "edges orders", lambda e, o: E.path_subgraph(e, o.select(F.col("o_custkey").alias("path_id"), F.array(F.col("o_orderkey"), F.col("o_custkey") + FAR).alias("path"))), f"WITH v AS (SELECT o_orderkey AS id FROM orders UNION SELECT o_custkey + {FAR} FROM orders) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
register("O-sparsenet-subgraph", "edges lineitem", lambda e, l: E.sparse_net_subgraph(e, l.select(F.col("l_orderkey").alias("path_id"), F.array(F.col("l_orderkey"), F.col("l_partkey") + FAR).alias("path"))), f"SELECT DISTINCT l_orderkey AS src, {FAR} + l_partkey AS dst FROM lineitem")
register("O-path-assign", "edges lineitem", lambda e, l: W.assign_to_paths(e, l.select((F.col("l_linenumber")).cast("long").alias("path_id"), F.array(F.col("l_partkey") + FAR).alias("path"))), f"WITH onp AS (SELECT DISTINCT {FAR} + l_partkey AS id, CAST(l_linenumber AS BIGINT) AS path_id FROM lineitem), n AS (SELECT e.src AS id, o.path_id, count(*) AS n FROM edges e JOIN onp o ON e.dst = o.id GROUP BY 1, 2) SELECT id, path_id, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, path_id) AS r FROM n) x WHERE r = 1")
register("O-landmark-cluster", "forest", lambda e: W.nearest_landmark(e, e.select(F.col("src").alias("id")).distinct()), "SELECT src AS id, CAST(0 AS BIGINT) AS dist, src AS landmark FROM (SELECT DISTINCT src FROM forest) f UNION ALL SELECT dst, 1, src FROM forest")
register("O-landmark-midpoints", "edges lineitem", lambda e, l: W.path_midpoints(e, l.groupBy(F.col("l_returnflag").alias("path_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") + FAR)).alias("path"))), f"WITH p AS (SELECT path_id, id, row_number() OVER (PARTITION BY path_id ORDER BY id) - 1 AS pos FROM (SELECT DISTINCT l_returnflag AS path_id, {FAR} + l_partkey AS id FROM lineitem) d) SELECT e.src AS id, p.path_id, CAST(floor((min(pos) + max(pos)) / 2) AS BIGINT) AS pos FROM edges e JOIN p ON e.dst = p.id GROUP BY e.src, p.path_id")
register("O-solar", "forest", W.solar_merge)
register("O-leaf", "layered", W.next_leaf)
register("O-bcc", "edges", W.blocks)
register("O-bcc-points", "forest", lambda e: W.articulation_points(W.blocks(e)), "SELECT src AS id FROM forest GROUP BY src HAVING count(*) > 1")
register("O-bccpart", "forest", lambda e: P.articulation_metagraph(W.blocks(e))[1], f"WITH p AS (SELECT src FROM forest GROUP BY src HAVING count(*) > 1) SELECT 'b_' || f.src || '-' || f.dst AS src, 'v_' || f.src AS dst FROM forest f JOIN p ON f.src = p.src")
register("O-vccpart", "edges vertices", lambda e, v: P.value_component_metagraph(e, v.select("id", "value"))[0])
UP = "WITH RECURSIVE u(id, level) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM steps WHERE src NOT IN (SELECT dst FROM steps) UNION SELECT s.dst, u.level + 1 FROM u JOIN steps s ON s.src = u.id)"
register("O-topo-levels", "steps", D.topological_levels, f"{UP} SELECT id, max(level) AS level FROM u GROUP BY id")
register("O-dag-longest", "steps", D.longest_paths, f"{UP}, d(id, level) AS (SELECT DISTINCT dst, CAST(0 AS BIGINT) FROM steps WHERE dst NOT IN (SELECT src FROM steps) UNION SELECT s.src, d.level + 1 FROM d JOIN steps s ON s.dst = d.id) SELECT a.id, a.up, b.down FROM (SELECT id, max(level) AS up FROM u GROUP BY id) a JOIN (SELECT id, max(level) AS down FROM d GROUP BY id) b ON a.id = b.id")
register("O-dag-longest-path", "steps", D.longest_path)
register("O-natural-weight", "steps", lambda s: rounded(D.natural_weights(s)), "WITH RECURSIVE o AS (SELECT src, count(*) AS n FROM steps GROUP BY src), w(id, w) AS (SELECT DISTINCT src, CAST(1 AS DOUBLE) FROM steps WHERE src NOT IN (SELECT dst FROM steps) UNION ALL SELECT s.dst, w.w / o.n FROM w JOIN steps s ON s.src = w.id JOIN o ON o.src = w.id) SELECT id, round(sum(w), 6) AS w FROM w GROUP BY id")
register("O-search-expand", "forest", lambda e: rounded(D.search_expand(e, e.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("id2")).select(F.col("id2").alias("id")), 2)), "WITH f AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n, min(dst) OVER (PARTITION BY src) AS hit FROM forest) SELECT DISTINCT hit AS id, CAST(0 AS BIGINT) AS step, CAST(1 AS DOUBLE) AS w, CAST(0 AS BIGINT) AS cut FROM f UNION ALL SELECT DISTINCT src, 1, 1.0, 0 FROM f UNION ALL SELECT dst, 2, round(1.0 / (n - 1), 6), 0 FROM f WHERE dst <> hit")
register("O-dag-meta", "arcs levels", lambda a, l: D.meta_dag(a, l.select("id", "level"))[0])
register("O-dag-meta-links", "arcs levels", lambda a, l: D.meta_dag(a, l.select("id", "level"))[1])
register("O-dag-connect-jump", "steps step_levels", lambda s, l: D.connect_by_jumps(s.join(l.toDF("src", "ls"), "src").join(l.toDF("dst", "lt"), "dst")))
register("O-dagcover", "arcs", lambda a: D.dag_cover(a.select("src", "dst", "ls", "lt")))
register("O-dag-back", "steps step_levels", lambda s, l: W.expand_long_path(D.longest_path(s), s.select("src", "dst", F.col("src").alias("n_src"), F.col("dst").alias("n_dst")), s.select(F.col("src").alias("node"), F.col("src"), F.col("src").alias("dst"))))
register("O-rings-metagraph", "forest forest_parts", lambda e, p: P.ring_metagraph(e, P.rings(e, p, e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))))[0])
register("O-hierarchy-lccs", "layered", lambda e: H.decompose(e).lccs)
register("O-hierarchy-waves", "layered", lambda e: H.decompose(e).waves)
register("O-q-city-vicinity", "layered lccs", lambda e, c: H.decompose(H.vicinity(e.withColumn("lcc", F.col("dst") - FAR), c, 2, 1)).lccs)
