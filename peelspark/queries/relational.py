"""Cleaning, filters, joins, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import edges as E
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import stats as S
from ..operators import text as T
from ..sources import edges as src
from .base import FAR, register, rounded

ENDS = "(SELECT src AS id FROM {0} UNION ALL SELECT dst FROM {0})"
BOTH = "(SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"

register("O-sanitize", "raw_edges", E.sanitize, "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw_edges WHERE src <> dst")
register("O-union", "edges", E.both_ways, f"SELECT src, dst FROM {BOTH} b")
register("O-induced", "edges vertices", lambda e, v: E.induced(e, v.filter("value <= 3").select("id")), "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM vertices WHERE value <= 3) AND dst IN (SELECT id FROM vertices WHERE value <= 3)")
register("O-filter-prop", "edges vertices", lambda e, v: E.filter_vertices(e, v, F.col("price") > 1200), "SELECT e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.price > 1200 AND b.price > 1200")
register("O-filter-vertex-fn", "edges vertices", lambda e, v: E.filter_vertices(e, v, "value BETWEEN 2 AND 30"), "SELECT e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.value BETWEEN 2 AND 30 AND b.value BETWEEN 2 AND 30")
register("O-filter-edge-fn", "priced", lambda p: E.filter_edges(p, "quantity >= 45")[1], "SELECT src AS id FROM priced WHERE quantity >= 45 UNION SELECT dst FROM priced WHERE quantity >= 45")
register("O-egonet", "layered", lambda e: E.ego_net(e.unionByName(e.select((F.col("src") - 1).alias("src"), "src", "layer").toDF("src", "dst", "layer")), 5), "WITH e AS (SELECT src, dst FROM layered UNION ALL SELECT src - 1, src FROM layered), n AS (SELECT dst AS id FROM e WHERE src = 5 UNION SELECT src FROM e WHERE dst = 5) SELECT e.src, e.dst, x.layer FROM (SELECT src, dst, layer FROM layered UNION ALL SELECT src - 1, src, layer FROM layered) x JOIN (SELECT DISTINCT src, dst FROM e) e ON x.src = e.src AND x.dst = e.dst WHERE e.src IN (SELECT id FROM n) AND e.dst IN (SELECT id FROM n)")
register("O-neighbors", "edges", lambda e: E.neighbors(e, FAR + 1), f"SELECT dst AS id FROM {BOTH} b WHERE src = {FAR + 1}")
register("O-project-v", "labels_v vertices", lambda part, v: E.project_vertices(part.select("id"), v, "price"), "SELECT l.id, v.price FROM labels_v l LEFT JOIN vertices v ON l.id = v.id")
register("O-project-e", "edges priced", lambda e, p: E.project_edges(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), p, "quantity"), "SELECT e.dst AS src, e.src AS dst, p.quantity FROM edges e LEFT JOIN priced p ON e.src = p.src AND e.dst = p.dst")
register("O-e-from-v", "edges vertices", lambda e, v: E.edge_from_vertices(e, v, "value"), "SELECT e.src, e.dst, least(a.value, b.value) AS value FROM edges e LEFT JOIN vertices a ON e.src = a.id LEFT JOIN vertices b ON e.dst = b.id")
register("O-v-from-e", "vertices priced", lambda v, p: E.vertex_from_edges(v, p, "quantity"), "SELECT v.id, coalesce(max(q.quantity), 0) AS quantity FROM vertices v LEFT JOIN (SELECT src AS id, quantity FROM priced UNION ALL SELECT dst, quantity FROM priced) q ON v.id = q.id GROUP BY v.id")
register("O-rows", "vertices", lambda v: E.rows(v.select("id", "value"), "value > 20"), "WITH n AS (SELECT id, value, row_number() OVER (ORDER BY id) - 1 AS original_index FROM vertices) SELECT id, value, original_index, row_number() OVER (ORDER BY id) - 1 AS \"index\" FROM n WHERE value > 20")
register("O-frag-filter", "wedges", lambda w: w.filter("wave = 2 AND frag = 1").select("src", "dst"), "SELECT src, dst FROM wedges WHERE wave = 2 AND frag = 1")
register("O-wave-window", "wedges lccs", lambda w, c: w.filter("wave BETWEEN 2 AND 4 AND frag BETWEEN 1 AND 3").join(c.filter("bucket = 1").select(F.col("lcc").alias("wcc")).distinct(), "wcc", "left_semi").select("src", "dst"), "SELECT src, dst FROM wedges WHERE wave BETWEEN 2 AND 4 AND frag BETWEEN 1 AND 3 AND wcc IN (SELECT lcc FROM lccs WHERE bucket = 1)")
register("O-extract-lcc", "wedges lccs", lambda w, c: J.semi(w, c.filter("bucket = 2").select(F.col("lcc").alias("wcc")), ["wcc"]).select("src", "dst"), "SELECT src, dst FROM wedges WHERE wcc IN (SELECT lcc FROM lccs WHERE bucket = 2)")
register("O-node-threshold", "vertices", lambda v: v.withColumn("shown", F.when(F.col("price") >= 1500, "bright").otherwise("dim")).select("id", "shown"), "SELECT id, CASE WHEN price >= 1500 THEN 'bright' ELSE 'dim' END AS shown FROM vertices")

register("O-join-wcc-lcc", "members", lambda m: J.wcc_to_lcc(m.select("layer", F.col("lcc").alias("wcc"), "vertex", F.lit(1).cast("long").alias("wave")), m.groupBy("vertex", "layer").agg(F.min("lcc").alias("lcc"))), "WITH o AS (SELECT layer, lcc AS wcc, min(vertex) AS vertex FROM members GROUP BY layer, lcc), c AS (SELECT vertex, layer, min(lcc) AS lcc FROM members GROUP BY vertex, layer) SELECT o.layer, CAST(1 AS BIGINT) AS wave, o.wcc, c.lcc FROM o JOIN c ON o.vertex = c.vertex AND o.layer = c.layer")
register("O-join-labels", "vertices labels_v", lambda v, l: J.with_labels(v.select("id"), l), "SELECT v.id, coalesce(l.label, CAST(v.id AS VARCHAR)) AS label FROM vertices v LEFT JOIN labels_v l ON v.id = l.id")
register("O-join-vmap", "edges vertices", lambda e, v: J.edges_of_nodes(e, v.select("id", F.col("value").alias("node"))), "SELECT a.value AS node, e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.value = b.value")
register("O-join-vmap-touching", "edges vertices", lambda e, v: J.edges_of_nodes(e, v.select("id", F.col("value").alias("node")), True), "SELECT a.value AS node, e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id UNION ALL SELECT b.value, e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.value <> b.value")
register("O-semi", "vertices labels_v", lambda v, l: J.semi(v.select("id"), l, ["id"]), "SELECT id FROM vertices WHERE id IN (SELECT id FROM labels_v)")
register("O-anti", "vertices labels_v", lambda v, l: J.anti(v.select("id"), l, ["id"]), "SELECT id FROM vertices WHERE id NOT IN (SELECT id FROM labels_v)")
register("O-classify", "orders nation", lambda o, n: J.classify(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")), n.select((F.col("n_nationkey") * 10000.0).alias("lo"), (F.col("n_nationkey") * 10000.0 + 10000).alias("hi"), F.col("n_name").alias("label"))).select("id", "label"), "SELECT o_orderkey AS id, n_name AS label FROM orders LEFT JOIN nation ON o_totalprice > n_nationkey * 10000.0 AND o_totalprice < n_nationkey * 10000.0 + 10000")
register("O-src-extradata", "orders customer nation", lambda o, c, n: J.with_attributes(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n")), on="k").join(n.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("country")), "n", "left").select("id", "country"), "SELECT o_orderkey AS id, n_name AS country FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
register("O-src-sets", "lineitem", lambda l: src.property_from_sets(l.select("l_linenumber", "l_partkey").distinct().groupBy(F.col("l_linenumber").alias("k")).agg(F.collect_list("l_partkey").alias("i")).select(F.map_from_arrays(F.array("k"), F.array("i")).alias("sets"))), "SELECT l_partkey AS id, max(l_linenumber) AS value FROM lineitem GROUP BY l_partkey")
register("O-src-csvstream", "layered", lambda e: src.to_multimap(e, ["src", "dst"], "layer").select("key", F.array_join("values", ",").alias("values")), "SELECT key, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) AS \"values\" FROM (SELECT src AS key, layer FROM layered UNION ALL SELECT dst, layer FROM layered) u GROUP BY key")

register("O-degree", "edges", S.degree, f"SELECT id, count(*) AS degree FROM {ENDS.format('edges')} u GROUP BY id")
register("O-degree-dist", "edges", S.degree_distribution, f"SELECT degree, count(*) AS n FROM (SELECT id, count(*) AS degree FROM {ENDS.format('edges')} u GROUP BY id) d GROUP BY degree")
register("O-layer-dist", "lccs", S.layer_distribution, "SELECT layer, e AS edges, count(*) AS n FROM lccs GROUP BY layer, e")
register("O-mean-degree", "lccs", lambda c: rounded(S.mean_degree(c)), "SELECT layer, round(m, 6) AS mean_degree, m >= layer AND m < 2 * layer AS holds FROM (SELECT layer, 2.0 * CAST(sum(e) AS DOUBLE) / CAST(sum(v) AS DOUBLE) AS m FROM lccs GROUP BY layer) x")
register("O-cc-sizes", "forest_parts forest", S.component_sizes, "SELECT p.component, count(*) AS v, max(f.e) AS e FROM forest_parts p JOIN (SELECT src, count(*) AS e FROM forest GROUP BY src) f ON p.component = f.src GROUP BY p.component")
register("O-main-vertex", "forest_parts forest", S.main_vertices, "WITH s AS (SELECT src, count(*) AS e FROM forest GROUP BY src) SELECT src AS component, CASE WHEN e > 1 THEN src ELSE src END AS id, e AS degree FROM s WHERE e + 1 > (SELECT avg(e + 1) FROM s)")
register("O-wave-stats", "wedges wsources", lambda w, s: S.wave_stats(w, s), "WITH x AS (SELECT w.*, a.wave AS wa, b.wave AS wb FROM wedges w JOIN wsources a ON w.src = a.id JOIN wsources b ON w.dst = b.id), pe AS (SELECT wave, count(*) AS e, count(*) FILTER (WHERE wa = wave AND wb = wave) AS ie, count(*) FILTER (WHERE least(wa, wb) = wave AND greatest(wa, wb) = wave + 1) AS e_next FROM x GROUP BY wave), t AS (SELECT wave, count(*) AS v FROM (SELECT wave, src FROM wedges UNION SELECT wave, dst FROM wedges) u GROUP BY wave), o AS (SELECT wave, count(*) FILTER (WHERE frag = 0) AS s, count(*) AS ss FROM wsources GROUP BY wave) SELECT wave, s, ss, v - s AS t, ie, e - ie AS ee, e_next FROM pe JOIN t USING (wave) JOIN o USING (wave)")
register("O-fork-stats", "wedges wsources", lambda w, s: S.fork_stats(w, s).withColumn("wccs", F.size("wccs").cast("long")), "WITH e AS (SELECT wave, frag, count(*) AS e, count(DISTINCT wcc) AS wccs FROM wedges GROUP BY wave, frag), v AS (SELECT wave, frag, count(*) AS v FROM (SELECT wave, frag, src FROM wedges UNION SELECT wave, frag, dst FROM wedges) u GROUP BY wave, frag), s AS (SELECT wave, frag, count(*) AS sources FROM wsources GROUP BY wave, frag) SELECT e.wave, e.frag, e, wccs, v, coalesce(sources, 0) AS sources, max(e) OVER (PARTITION BY e.wave) AS max_frag_edges FROM e JOIN v ON e.wave = v.wave AND e.frag = v.frag LEFT JOIN s ON e.wave = s.wave AND e.frag = s.frag")
register("O-wave-map", "arcs", S.wave_map, "WITH v AS (SELECT wave, wcc, level, count(*) AS v FROM (SELECT wave, wcc, ls AS level, src FROM arcs UNION SELECT wave, wcc, lt, dst FROM arcs) u GROUP BY wave, wcc, level), e AS (SELECT wave, wcc, ls AS level, count(*) FILTER (WHERE ls = lt) AS e, count(*) FILTER (WHERE ls <> lt) AS ef FROM arcs GROUP BY wave, wcc, ls) SELECT v.wave, v.wcc, v.level, v, coalesce(e, 0) AS e, coalesce(ef, 0) AS ef FROM v LEFT JOIN e ON v.wave = e.wave AND v.wcc = e.wcc AND v.level = e.level")
register("O-level-map", "arcs", S.level_map, "WITH h AS (SELECT id, max(l) AS level FROM (SELECT src AS id, ls AS l FROM arcs UNION ALL SELECT dst, ls FROM arcs) u GROUP BY id), v AS (SELECT level, count(*) AS v FROM h GROUP BY level), e AS (SELECT ls AS level, count(*) FILTER (WHERE ls = lt) AS e, count(*) FILTER (WHERE ls <> lt) AS ef FROM arcs GROUP BY ls) SELECT v.level, v, coalesce(e, 0) AS e, coalesce(ef, 0) AS ef FROM v LEFT JOIN e ON v.level = e.level")
D = "CASE WHEN v > 1 THEN 2.0 * e / (v * (v - 1)) ELSE 0.0 END"
for key in ("layer", "bucket"):
    register(f"O-density-stat-{key}", "lccs", lambda c, k=key: rounded(S.density_stats(c, k)), f"SELECT {key}, round(max(d), 6) AS max_density, round(avg(d), 6) AS avg_density, round(min(d), 6) AS min_density FROM (SELECT {key}, CAST({D} AS DOUBLE) AS d FROM lccs) x GROUP BY {key}")
register("O-bucket-info", "lccs", lambda c: rounded(S.bucket_info(c)), f"WITH g AS (SELECT bucket, layer, count(*) AS components, CAST(sum(v) AS BIGINT) AS v, CAST(sum(e) AS BIGINT) AS e, avg(CAST({D} AS DOUBLE)) AS d FROM lccs GROUP BY GROUPING SETS ((bucket, layer), (bucket))), r AS (SELECT *, CAST(sum(v) OVER w AS DOUBLE) AS rv, CAST(sum(e) OVER w AS DOUBLE) AS re FROM g WINDOW w AS (PARTITION BY bucket, layer IS NULL ORDER BY layer ROWS UNBOUNDED PRECEDING)) SELECT bucket, layer, components, v, e, round(d, 6) AS avg_density, round(CASE WHEN rv > 1 THEN 2.0 * re / (rv * (rv - 1)) ELSE 0.0 END, 6) AS running_density FROM r")
register("O-entropy", "layered", lambda e: rounded(S.diversity(e)), "WITH l AS (SELECT id, layer, count(*) AS d FROM (SELECT src AS id, layer FROM layered UNION ALL SELECT dst, layer FROM layered) u GROUP BY id, layer), t AS (SELECT id, sum(d) AS a, count(*) AS k FROM l GROUP BY id), h AS (SELECT l.id, -sum(d / a * ln(d / a)) / ln(greatest(2, max(k))) AS h FROM l JOIN t ON l.id = t.id GROUP BY l.id) SELECT layer, round(avg(h), 6) AS diversity FROM l JOIN h ON l.id = h.id GROUP BY layer")
register("O-clone-count", "members", S.clone_counts, "SELECT vertex, count(DISTINCT layer) AS clones FROM members GROUP BY vertex")
register("O-local-degree", "layered", S.local_degree, "SELECT id, layer, count(*) AS degree FROM (SELECT src AS id, layer FROM layered UNION ALL SELECT dst, layer FROM layered) u GROUP BY id, layer")
register("O-histogram-std", "orders", lambda o: S.std_histogram(o, "o_totalprice"), "SELECT CAST(floor((o_totalprice - m) / s) AS BIGINT) AS bin, count(*) AS n FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) x GROUP BY 1")
register("O-frag-spread", "wedges", lambda w: S.fragment_spread(w.groupBy(F.col("wcc").alias("lcc"), "wave", "frag").agg(F.count("*").alias("size"))), "WITH f AS (SELECT wcc AS lcc, wave, frag, ln(count(*)) AS x FROM wedges GROUP BY wcc, wave, frag), m AS (SELECT lcc, avg(x) AS a, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi FROM f GROUP BY lcc), b AS (SELECT f.lcc, CASE WHEN s > 1e-9 THEN CAST(ceil((a - lo) / s) AS BIGINT) ELSE 0 END AS below, CASE WHEN s > 1e-9 THEN CAST(ceil((hi - a) / s) AS BIGINT) ELSE 0 END AS above, CASE WHEN s > 1e-9 THEN CAST(floor((x - a) / s) AS BIGINT) ELSE 0 END AS bin FROM f JOIN m ON f.lcc = m.lcc), n AS (SELECT lcc, below, above, bin, count(*) AS n FROM b GROUP BY lcc, below, above, bin) SELECT *, CAST(sum(n) OVER (PARTITION BY lcc ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM n")
register("O-city-summary", "edges members lccs", S.summary, "SELECT (SELECT count(*) FROM edges) AS edges, count(DISTINCT vertex) AS vertices, count(DISTINCT cc) AS con_comp, count(DISTINCT layer) AS peel_values, count(DISTINCT layer * 1000000000 + lcc) AS con_fixpoints, (SELECT count(DISTINCT bucket) FROM lccs) AS buckets, (SELECT count(*) FROM (SELECT DISTINCT layer, v, e FROM lccs) x) AS buildings FROM members")
register("O-avg-connections", "part", lambda p: S.average_connections(p, "p_name", "p_size", "1"), "SELECT CAST(ceil(avg(p_size)) AS BIGINT) AS average FROM part WHERE contains(p_name, '1') AND p_size > 0")
register("O-down-degree", "arcs", S.down_degree, "SELECT node, level, count(*) FILTER (WHERE o > level) AS up, count(*) FILTER (WHERE o < level) AS down, count(*) FILTER (WHERE o = level) AS horizontal FROM (SELECT src AS node, ls AS level, lt AS o FROM arcs UNION ALL SELECT dst, lt, ls FROM arcs) u GROUP BY node, level")
register("O-high-nodes", "arcs", lambda a: rounded(S.high_nodes(S.down_degree(a))), "WITH d AS (SELECT node, level, count(*) FILTER (WHERE o < level) AS down FROM (SELECT src AS node, ls AS level, lt AS o FROM arcs UNION ALL SELECT dst, lt, ls FROM arcs) u GROUP BY node, level), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY down DESC, node) AS rank, count(*) OVER (PARTITION BY level) AS n, avg(down) OVER (PARTITION BY level) AS m FROM d) SELECT level, node, down, CAST(rank AS INTEGER) AS rank, round(m, 6) AS mean_down FROM r WHERE rank <= 1 + floor(log2(n))")
register("O-summary-stat", "lccs", lambda c: rounded(S.summary_stat(c, "e")), "SELECT min(e) AS min, max(e) AS max, round(avg(e), 6) AS avg, round(stddev_pop(e), 6) AS std, CAST(sum(e) AS BIGINT) AS total, count(e) AS length FROM lccs")
register("O-mode", "lccs", lambda c: c.groupBy("v").agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode")), "SELECT v AS mode FROM (SELECT v, count(*) AS n FROM lccs GROUP BY v ORDER BY n DESC, v LIMIT 1) x")
register("O-distinct-sorted", "lccs", lambda c: c.select("e").distinct().orderBy("e"), "SELECT DISTINCT e FROM lccs ORDER BY e")
register("O-split-by-value", "lccs", lambda c: R.level_rank(c.select("layer", "lcc", "e"), ["layer"], ["e"], "part").withColumn("part", F.col("part").cast("long")), "SELECT layer, lcc, e, dense_rank() OVER (PARTITION BY layer ORDER BY e) - 1 AS part FROM lccs")
register("O-scale", "part", lambda p: rounded(p.crossJoin(F.broadcast(p.agg(F.avg("p_retailprice").alias("a")))).select(F.col("p_partkey").alias("id"), scalar.scaled(F.col("p_retailprice"), 1.0, 900.0, 1500.0).alias("clamped"), (F.col("p_retailprice") * 100 / F.col("a")).alias("scaled"))), "SELECT p_partkey AS id, round(least(greatest(p_retailprice, 900.0), 1500.0), 6) AS clamped, round(p_retailprice * 100 / (SELECT avg(p_retailprice) FROM part), 6) AS scaled FROM part")
register("O-rules", "vertices", lambda v: T.rules(v.select("id", "value"), [("value > 40", 40), ("value < 2", 2)], "value"), "SELECT id, CASE WHEN value > 40 THEN 40 WHEN value < 2 THEN 2 ELSE value END AS value FROM vertices")
register("O-count-labels", "part", lambda p: T.count_classes(p.select(F.col("p_name").alias("label"))), "SELECT CASE WHEN contains(p_name, 'TMI') THEN 'TMI' WHEN contains(p_name, 'ATU') THEN 'ATU' WHEN contains(p_name, 'ETK') THEN 'ETK' WHEN len(string_split(p_name, ' ')) <= 1 THEN 'place' ELSE 'person' END AS label_class, count(*) AS n FROM part GROUP BY 1")
register("O-vlog", "lccs", lambda c: rounded(c.filter("v > 1").select("layer", "lcc", scalar.vlog(F.col("v"), F.col("e")).alias("vlog"))), "SELECT layer, lcc, round(ln(e / v) / ln(v), 6) AS vlog FROM lccs WHERE v > 1")
register("O-metanode-size", "lccs", lambda c: rounded(c.select("layer", "lcc", scalar.metanode_size(F.col("v"), F.col("e")).alias("size"))), "SELECT layer, lcc, round(greatest(ln(v + 1) + 0.3, ln(e + 1) + 0.3), 6) AS size FROM lccs")
register("O-graph-props", "forest forest_parts", lambda e, p: rounded(S.graph_properties(e, p)), "WITH x AS (SELECT count(*) AS n, count(DISTINCT component) AS components, (SELECT count(*) FROM forest) AS m FROM forest_parts) SELECT n, m, components, round(2.0 * m / (n * (n - 1)), 6) AS probability, round(2.0 * m / (n - 1), 6) AS np, round(2.0 * m / (n - 1) / ln(n), 6) AS np_ln, round(2.0 * m / n, 6) AS avg_degree, round(ln(m / n) / ln(ln(n)), 6) AS sparsity FROM x")
register("O-vpart-stats", "edges vertices", lambda e, v: S.vertex_partition_stats(e, v.select("id", "value")), "WITH x AS (SELECT a.value AS va, b.value AS vb FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id), i AS (SELECT va AS value, count(*) AS e FROM x WHERE va = vb GROUP BY va), o AS (SELECT value, count(*) AS meta FROM (SELECT va AS value FROM x WHERE va <> vb UNION ALL SELECT vb FROM x WHERE va <> vb) u GROUP BY value), n AS (SELECT value, count(*) AS v FROM vertices GROUP BY value) SELECT n.value, v, coalesce(e, 0) AS e, coalesce(meta, 0) AS meta FROM n LEFT JOIN i ON n.value = i.value LEFT JOIN o ON n.value = o.value")
CLONES = "c AS (SELECT src AS id, layer FROM layered UNION SELECT dst, layer FROM layered), h AS (SELECT id, max(layer) AS highest, count(*) AS clones FROM c GROUP BY id)"
register("O-clones", "layered", S.clones, f"WITH {CLONES} SELECT c.id, c.layer, h.highest, h.clones FROM c JOIN h ON c.id = h.id")
register("O-epart-stats", "layered", S.edge_partition_stats, f"WITH {CLONES}, e AS (SELECT layer, count(*) AS e FROM layered GROUP BY layer), v AS (SELECT layer, count(*) AS v, count(*) FILTER (WHERE clones > 1) AS cloned FROM c JOIN h ON c.id = h.id GROUP BY layer) SELECT e.layer, e, v, cloned FROM e JOIN v ON e.layer = v.layer")
register("O-vertices-by-height", "layered", S.vertices_by_height, f"WITH {CLONES} SELECT layer, id FROM c")
register("O-wave-starts", "levels", S.wave_starts, "SELECT wave, min(level) AS first_level FROM levels GROUP BY wave")
register("O-level-summary", "levels arcs", S.level_summary, "WITH v AS (SELECT level, count(*) AS v, max(wave) AS wave FROM levels GROUP BY level), e AS (SELECT ls AS level, count(*) FILTER (WHERE ls = lt) AS e, count(*) FILTER (WHERE ls <> lt) AS forward FROM arcs GROUP BY ls), w AS (SELECT *, coalesce(lead(wave) OVER (ORDER BY level) <> wave, true) AS ends FROM v) SELECT w.level, v, wave, ends, coalesce(e, 0) AS e, coalesce(forward, 0) AS forward FROM w LEFT JOIN e ON w.level = e.level")
register("O-level-forward", "arcs", S.forward_by_target, "SELECT ls AS level, lt AS target, count(*) AS forward FROM arcs WHERE ls <> lt GROUP BY ls, lt")
register("O-wave-summary", "levels", S.wave_summary, "WITH f AS (SELECT *, level = min(level) OVER (PARTITION BY wave) AS first FROM levels) SELECT wave, min(level) AS first_level, max(level) AS last_level, count(DISTINCT level) AS levels, count(*) FILTER (WHERE first) AS start, count(*) FILTER (WHERE NOT first) AS middle FROM f GROUP BY wave")
register("O-wave-to-wave", "arcs", S.wave_to_wave, "SELECT least(ws, wt) AS wave, greatest(ws, wt) AS other, count(*) AS edges FROM arcs GROUP BY 1, 2")
register("O-wave-cc-ending", "arcs", S.wave_endings, "SELECT w AS wave, count(*) AS ending FROM (SELECT DISTINCT w, v FROM (SELECT ws AS w, wt AS l, dst AS v FROM arcs UNION ALL SELECT wt, ws, src FROM arcs) u WHERE w < l) x GROUP BY w")
register("O-first-seen", "arcs", S.first_seen, "SELECT dst AS id, min(ls) AS first_seen FROM arcs WHERE ls < lt GROUP BY dst")
register("O-lcc-peel-dist", "members", lambda m: m.groupBy("layer").agg(F.countDistinct("lcc").alias("lccs")), "SELECT layer, count(DISTINCT lcc) AS lccs FROM members GROUP BY layer")
for mode, test in (("whole", "contains(label, 'part 1')"), ("all", "contains(label, '1') AND contains(label, '2')"), ("any", "contains(label, '1') OR contains(label, '2')")):
    register(f"O-q-search-{mode}", "labels_v", lambda l, m=mode: T.search(l, "part 1" if m == "whole" else "1 2", m), f"SELECT id, label FROM labels_v WHERE {test}")
