"""Metagraphs, directed levels, rankings, buckets, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bucketing as B
from ..operators import dag as D
from ..operators import edges as E
from ..operators import layout as L
from ..operators import partition as P
from ..operators import ranking as R
from ..operators import stats as S
from ..streaming import edges as stream
from .base import FAR, register, rounded

# metagraphs
VX = "x AS (SELECT a.value AS va, b.value AS vb FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id)"
value = lambda v: v.select("id", "value")
register("O-vpart", "edges vertices", lambda e, v: P.vertex_metagraph(e, value(v))[0], f"WITH {VX}, i AS (SELECT va AS value, count(*) AS e FROM x WHERE va = vb GROUP BY va), n AS (SELECT value, count(*) AS v, min(id) AS f FROM vertices GROUP BY value) SELECT n.value, v, coalesce(e, 0) AS e, CASE WHEN v = 1 THEN 'v_' || f ELSE CAST(n.value AS VARCHAR) END AS name FROM n LEFT JOIN i ON n.value = i.value")
register("O-vpart-edges", "edges vertices", lambda e, v: P.vertex_metagraph(e, value(v))[1], f"WITH {VX} SELECT least(va, vb) AS src, greatest(va, vb) AS dst, count(*) AS e FROM x WHERE va <> vb GROUP BY 1, 2")
EV = "ev AS (SELECT value, src AS vertex FROM priced UNION SELECT value, dst FROM priced)"
register("O-epart", "priced", lambda p: P.edge_metagraph(p)[0], f"WITH {EV} SELECT a.value, e, v FROM (SELECT value, count(*) AS e FROM priced GROUP BY value) a JOIN (SELECT value, count(*) AS v FROM ev GROUP BY value) b ON a.value = b.value")
register("O-epart-edges", "priced", lambda p: P.edge_metagraph(p)[1], f"WITH {EV} SELECT a.value AS value_a, b.value AS value_b, count(*) AS w FROM ev a JOIN ev b ON a.vertex = b.vertex AND a.value < b.value GROUP BY 1, 2")
register("O-epart-profile", "priced", P.vertex_profile, "SELECT id, value, count(*) AS degree FROM (SELECT src AS id, value FROM priced UNION ALL SELECT dst, value FROM priced) u GROUP BY id, value")
SHARED = "s AS (SELECT a.layer AS layer_a, a.lcc AS lcc_a, b.layer AS layer_b, b.lcc AS lcc_b, count(*) AS w FROM members a JOIN members b ON a.vertex = b.vertex AND (a.layer < b.layer OR (a.layer = b.layer AND a.lcc < b.lcc)) GROUP BY 1, 2, 3, 4)"
register("O-self-intersect", "members", lambda m: P.shared_vertices(m, ["layer", "lcc"]), f"WITH {SHARED} SELECT * FROM s")
register("O-set-intersect", "members", lambda m: m.filter("lcc = 1").select("vertex").intersect(m.filter("lcc = 2").select("vertex")), "SELECT vertex FROM members WHERE lcc = 1 INTERSECT SELECT vertex FROM members WHERE lcc = 2")
register("O-layercc-meta", "members", lambda m: P.layer_metagraph(m).select("layer_a", "lcc_a", "layer_b", "lcc_b", "w", F.round("weight", 9).alias("weight")), f"WITH {SHARED}, z AS (SELECT layer, lcc, count(*) AS v FROM members GROUP BY layer, lcc) SELECT layer_a, lcc_a, layer_b, lcc_b, w, round(w / (a.v * b.v), 9) AS weight FROM s JOIN z a ON layer_a = a.layer AND lcc_a = a.lcc JOIN z b ON layer_b = b.layer AND lcc_b = b.lcc")
register("O-fpmeta-norm", "members", lambda m: P.layer_metagraph(m).select(F.concat_ws("_", "layer_a", "lcc_a").alias("s"), F.concat_ws("_", "layer_b", "lcc_b").alias("t"), F.round("weight", 9).alias("weight")), f"WITH {SHARED}, z AS (SELECT layer, lcc, count(*) AS v FROM members GROUP BY layer, lcc) SELECT layer_a || '_' || lcc_a AS s, layer_b || '_' || lcc_b AS t, round(w / (a.v * b.v), 9) AS weight FROM s JOIN z a ON layer_a = a.layer AND lcc_a = a.lcc JOIN z b ON layer_b = b.layer AND lcc_b = b.lcc")
IDS = "i AS (SELECT layer, lcc, row_number() OVER (ORDER BY layer, lcc) - 1 AS id FROM (SELECT DISTINCT layer, lcc FROM members) d)"
register("O-dense-id", "members", lambda m: R.dense_ids(m, ["layer", "lcc"]), f"WITH {IDS} SELECT layer, lcc, id FROM i")
register("O-fpmeta", "members", lambda m: P.fixed_point_metagraph(m)[1], f"WITH {SHARED}, {IDS} SELECT a.id AS s, b.id AS t, w FROM s JOIN i a ON layer_a = a.layer AND lcc_a = a.lcc JOIN i b ON layer_b = b.layer AND lcc_b = b.lcc")
register("O-fpmeta-bucket", "members lccs", lambda m, c: P.bucket_metagraph(P.shared_vertices(m, ["layer", "lcc"]), c), f"WITH {SHARED} SELECT layer_a, a.bucket AS bucket_a, layer_b, b.bucket AS bucket_b, CAST(sum(w) AS BIGINT) AS w FROM s JOIN lccs a ON layer_a = a.layer AND lcc_a = a.lcc JOIN lccs b ON layer_b = b.layer AND lcc_b = b.lcc GROUP BY 1, 2, 3, 4")
register("O-waves-meta", "edges wsources", lambda e, w: P.wave_metagraph(e, w).withColumn("weight", F.round("weight", 9)), "WITH x AS (SELECT least(a.wave, b.wave) AS src, greatest(a.wave, b.wave) AS dst, count(*) AS e FROM edges e JOIN wsources a ON e.src = a.id JOIN wsources b ON e.dst = b.id WHERE a.wave <> b.wave GROUP BY 1, 2), n AS (SELECT wave, count(*) AS v FROM wsources GROUP BY wave) SELECT src, dst, e, round(e / (a.v * b.v), 9) AS weight, 1 AS direction FROM x JOIN n a ON src = a.wave JOIN n b ON dst = b.wave")
register("O-meta-weight", "edges vertices", lambda e, v: P.meta_weight(P.vertex_metagraph(e, value(v))[1], P.vertex_metagraph(e, value(v))[0].select(F.col("value").alias("id"), "v")).withColumn("weight", F.round("weight", 9)), f"WITH {VX}, n AS (SELECT value, count(*) AS v FROM vertices GROUP BY value) SELECT least(va, vb) AS src, greatest(va, vb) AS dst, round(count(*) / max(a.v * b.v), 9) AS weight FROM x JOIN n a ON va = a.value JOIN n b ON vb = b.value WHERE va <> vb GROUP BY 1, 2")
register("O-wave-arcs", "wedges", lambda w: rounded(P.wave_arcs(w.groupBy("wave", "wcc").agg(F.count("*").alias("v")))), "WITH s AS (SELECT wave, wcc, count(*) AS v FROM wedges GROUP BY wave, wcc), r AS (SELECT *, sum(v) OVER (PARTITION BY wave) AS t, sum(v) OVER (PARTITION BY wave ORDER BY wcc ROWS UNBOUNDED PRECEDING) AS r FROM s) SELECT wave, wcc, v, round(2 * pi() * r / t, 6) AS to_angle, round(2 * pi() * (r - v) / t, 6) AS from_angle FROM r")
register("O-rings-meta", "forest forest_parts", lambda e, p: P.rings(e, p, S.degree(e)), f"WITH s AS (SELECT src, count(*) AS d FROM forest GROUP BY src) SELECT src AS id, src AS component, CAST(floor(ln(d + 1) / ln(2) + 1e-9) AS BIGINT) AS size_bucket, CAST(floor(ln(d) / ln(2) + 1e-9) AS BIGINT) AS ring FROM s UNION ALL SELECT {FAR} + o_orderkey, o_custkey, CAST(floor(ln(d + 1) / ln(2) + 1e-9) AS BIGINT), 0 FROM orders JOIN s ON o_custkey = src")
register("O-region-graph", "sets_v", lambda s: P.regions(s)[0], "SELECT region, count(*) AS v FROM (SELECT id, string_agg(set_id, '+' ORDER BY set_id) AS region FROM sets_v GROUP BY id) x GROUP BY region")
register("O-region-graph-neighbors", "sets_v", lambda s: P.regions(s, max_distance=1, min_overlap=1)[1].select("a", "b", F.col("overlap").cast("long").alias("overlap")), "WITH r AS (SELECT DISTINCT list(set_id ORDER BY set_id) AS s FROM sets_v GROUP BY id), p AS (SELECT array_to_string(x.s, '+') AS a, array_to_string(y.s, '+') AS b, x.s AS sa, y.s AS sb FROM r x, r y) SELECT a, b, CAST(len(list_intersect(sa, sb)) AS BIGINT) AS overlap FROM p WHERE a < b AND len(list_intersect(sa, sb)) >= 1 AND len(sa) + len(sb) - 2 * len(list_intersect(sa, sb)) <= 1")
register("O-graph-union", "layered", lambda e: E.union_graphs(e.withColumnRenamed("layer", "graph_id"))[0], "SELECT id, max(layer) AS graph_id FROM (SELECT src AS id, layer FROM layered UNION ALL SELECT dst, layer FROM layered) u GROUP BY id")
register("O-append", "edges forest", lambda a, b: E.append(a, b, FAR), f"SELECT src, dst FROM edges UNION ALL SELECT src + {FAR}, dst + {FAR} FROM forest")
register("O-set-union", "edges layered", lambda a, b: a.select("src").union(b.select("src")).distinct(), "SELECT src FROM edges UNION SELECT src FROM layered")
register("O-set-union-all", "edges layered", lambda a, b: a.select("src").unionAll(b.select("src")), "SELECT src FROM edges UNION ALL SELECT src FROM layered")
register("O-set-except", "lccs", lambda c: c.select("layer", "lcc").exceptAll(B.dedup_lccs(c).select("layer", "lcc")), "SELECT layer, lcc FROM lccs EXCEPT ALL SELECT layer, min(lcc) FROM lccs GROUP BY layer, v, e")
register("O-set-unique", "members", lambda m: m.select("layer", "lcc").distinct(), "SELECT DISTINCT layer, lcc FROM members")

# directed levels
ARC = "(SELECT CASE WHEN a.level > b.level OR (a.level = b.level AND e.src > e.dst) THEN e.dst ELSE e.src END AS src, CASE WHEN a.level > b.level OR (a.level = b.level AND e.src > e.dst) THEN e.src ELSE e.dst END AS dst, least(a.level, b.level) AS ls, greatest(a.level, b.level) AS lt FROM edges e JOIN levels a ON e.src = a.id JOIN levels b ON e.dst = b.id)"
register("O-join-level", "edges levels", lambda e, l: D.with_levels(e, l), f"SELECT src, dst, ls, lt FROM {ARC} a")
register("O-level-rank", "wsources", lambda w: R.level_rank(w, [], ["wave", "frag"]).select("id", "wave", "frag", F.col("level").cast("long").alias("level")), "SELECT id, wave, frag, level FROM levels")
register("O-level-filter", "arcs", lambda a: D.level_filter(a, ["span", "induce"], (2, 12), (3, 12)).select("src", "dst", "kind"), "SELECT src, dst, CASE WHEN lt = ls THEN 'induce' ELSE 'span' END AS kind FROM arcs WHERE lt - ls <= 1 AND ls BETWEEN 2 AND 12 AND lt BETWEEN 3 AND 12")
register("O-wave-edges", "edges wsources", lambda e, w: D.edge_waves(e, w), "SELECT e.src, e.dst, CASE WHEN a.wave < b.wave OR (a.wave = b.wave AND a.frag <= b.frag) THEN a.wave ELSE b.wave END AS wave, CASE WHEN a.wave < b.wave OR (a.wave = b.wave AND a.frag <= b.frag) THEN a.frag ELSE b.frag END AS frag FROM edges e JOIN wsources a ON e.src = a.id JOIN wsources b ON e.dst = b.id")
register("O-direction", "edges vertices", lambda e, v: D.direction(e, value(v)), "SELECT e.src, e.dst, CAST(sign(b.value - a.value) AS INTEGER) AS direction FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id")
register("O-span-dag", "steps step_levels", lambda s, l: D.span_dag(s, l), "SELECT s.src, s.dst FROM steps s JOIN step_levels a ON s.src = a.id JOIN step_levels b ON s.dst = b.id WHERE b.level = a.level + 1")
for group in ("wcc", "level"):
    name = "O-dag-wcc" if group == "wcc" else "O-dag-wf"
    both = f"x AS (SELECT a.{group} AS ga, b.{group} AS gb, l.e FROM links l JOIN nodes a ON l.src = a.node JOIN nodes b ON l.dst = b.node)"
    register(name, "nodes links", lambda n, l, g=group: D.regroup(n, l, g)[0], f"WITH {both}, i AS (SELECT ga, count(*) AS m, sum(e) AS e FROM x WHERE ga = gb GROUP BY ga) SELECT n.{group}, CAST(sum(v) AS BIGINT) AS v, CAST(sum(n.e) + coalesce(max(i.e), 0) AS BIGINT) AS e, count(*) AS meta_v, coalesce(max(m), 0) AS meta_e FROM nodes n LEFT JOIN i ON n.{group} = ga GROUP BY n.{group}")
    register(f"{name}-links", "nodes links", lambda n, l, g=group: D.regroup(n, l, g)[1], f"WITH {both} SELECT ga AS src, gb AS dst, CAST(sum(e) AS BIGINT) AS e, count(*) AS meta_e FROM x WHERE ga <> gb GROUP BY ga, gb")
register("O-dag-check", "nodes links lineitem", lambda n, l, t: D.check_sizes(n, l, t), "SELECT CAST(a AS BIGINT) AS inside, CAST(b AS BIGINT) AS between, c AS edges, a + b = c AS holds FROM (SELECT sum(e) AS a FROM nodes) x, (SELECT sum(e) AS b FROM links) y, (SELECT count(*) AS c FROM lineitem) z")
register("O-dag-buck", "nodes", lambda n: rounded(B.node_buckets(n, "level")).select("node", "std_bucket", "log_bucket"), "WITH m AS (SELECT level, avg(e) AS m, stddev_pop(e) AS s, sum(e + touch) AS t FROM nodes GROUP BY level) SELECT node, CASE WHEN s > 0 THEN CAST(floor((e - m) / s) AS BIGINT) ELSE 0 END AS std_bucket, CAST(floor(log2(1 + e + touch) / log2(1 + log2(greatest(t, 2)))) AS BIGINT) AS log_bucket FROM nodes n JOIN m ON n.level = m.level")
register("O-bucket-node", "nodes", lambda n: B.node_sample(n, "level"), "SELECT level, v, e, touch, min(node) AS node, count(*) AS n FROM nodes GROUP BY level, v, e, touch")
register("O-large-nondense", "nodes", lambda n: B.nodes_not_dense(n).select("node"), "SELECT node FROM nodes WHERE CASE WHEN v > 1 THEN 2.0 * e / (v * (v - 1)) ELSE 0.0 END < 0.95")
register("O-minicity-list", "nodes lccs", lambda n, c: B.nodes_not_dense(n, keep_equal=True).join(c.select((F.col("lcc") * 10 + F.col("layer")).alias("node")).filter("node % 3 = 0"), "node", "left_anti").select("node"), "SELECT node FROM nodes WHERE CASE WHEN v > 1 THEN 2.0 * e / (v * (v - 1)) ELSE 0.0 END <= 0.95 AND node NOT IN (SELECT lcc * 10 + layer FROM lccs WHERE (lcc * 10 + layer) % 3 = 0)")
register("O-filter-small-large", "nodes", lambda n: B.split_by_size(n, 30, 60).select("node", "size_class"), "SELECT node, CASE WHEN e <= 30 THEN 'sample' WHEN e <= 60 THEN 'vicinity' ELSE 'beyond' END AS size_class FROM nodes")
register("O-mall-state", "nodes lccs", lambda n, c: n.join(c.select((F.col("lcc") * 10 + F.col("layer")).alias("node"), F.lit("done").alias("s")).filter("node % 2 = 0"), "node", "left").select("node", F.coalesce("s", F.lit("open")).alias("state")), "SELECT node, CASE WHEN node % 2 = 0 AND node IN (SELECT lcc * 10 + layer FROM lccs) THEN 'done' ELSE 'open' END AS state FROM nodes")

# rankings
register("O-best-label", "labels_v members", lambda l, m: R.log_top(l.join(m.select((F.col("vertex") + FAR).alias("id"), "lcc").distinct(), "id"), ["lcc"], ["label", "id"]).select("lcc", "id", "label"), f"WITH j AS (SELECT DISTINCT m.lcc, l.id, l.label FROM labels_v l JOIN members m ON l.id = m.vertex + {FAR}), r AS (SELECT *, row_number() OVER (PARTITION BY lcc ORDER BY label, id) AS r, count(*) OVER (PARTITION BY lcc) AS n FROM j) SELECT lcc, id, label FROM r WHERE r <= ceil(log2(n + 1))")
register("O-high-weight", "vertices", lambda v: D.best_by_weight(v.select("id", F.col("price").alias("w"))).select("id", "w"), "SELECT id, price AS w FROM (SELECT *, row_number() OVER (ORDER BY price DESC, id) AS r, count(*) OVER () AS n FROM vertices) x WHERE r <= ceil(log2(n + 1))")
register("O-median-rep", "lccs", lambda c: R.median_row(c.select("bucket", "layer", "lcc", "e", "v"), ["bucket", "layer"], ["e", "v", "lcc"]), "SELECT bucket, layer, lcc, e, v FROM (SELECT *, row_number() OVER (PARTITION BY bucket, layer ORDER BY e, v, lcc) AS r, count(*) OVER (PARTITION BY bucket, layer) AS n FROM lccs) x WHERE r = CAST(floor(n / 2) AS BIGINT) + 1")
register("O-bucket-order", "lccs", lambda c: B.bucket_order(c).select("bucket", "layer", "lcc", "place"), "SELECT bucket, layer, lcc, CAST(row_number() OVER (PARTITION BY bucket, layer ORDER BY e DESC, v DESC, lcc) AS INTEGER) AS place FROM lccs")
register("O-sort-multi", "lccs", lambda c: R.sort_multi(c.select("layer", "e", "lcc"), [F.col("layer"), F.desc("e"), F.col("lcc")]), "SELECT layer, e, lcc FROM lccs ORDER BY layer, e DESC, lcc")
register("O-top-buildings", "buildings", B.top_buildings, "WITH d AS (SELECT building, CASE WHEN v > 1 THEN 2.0 * e / (v * (v - 1)) ELSE 0.0 END AS d FROM buildings WHERE bucket >= (SELECT max(bucket) / 2.0 FROM buildings)) SELECT building FROM (SELECT building, row_number() OVER (ORDER BY d DESC, building) AS r, count(*) OVER () AS n FROM d) x WHERE r <= ceil(log2(n + 1)) UNION " + " UNION ".join(f"SELECT building FROM (SELECT building, row_number() OVER (ORDER BY {by} DESC, building) AS r, count(*) OVER () AS n FROM buildings) x WHERE r <= ceil(log2(n + 1))" for by in ("e", "height", "floors", "road")))
register("O-split-frag", "wedges", lambda w: R.split_at(w.groupBy("wave", "frag").agg(F.count("*").alias("e")), "e", [F.col("wave"), F.col("frag")], 100), "SELECT wave, frag, e, CAST(floor((sum(e) OVER (ORDER BY wave, frag ROWS UNBOUNDED PRECEDING) - e) / 100) AS BIGINT) AS \"file\" FROM (SELECT wave, frag, count(*) AS e FROM wedges GROUP BY wave, frag) x")
register("O-stream-chunks", "part", lambda p: stream.chunks(p.select("p_partkey", "p_name"), "p_partkey", "p_name").select("p_partkey", "chunk"), "SELECT p_partkey, CAST(floor((sum(length(p_name)) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - length(p_name)) / 256) AS BIGINT) AS chunk FROM part")
register("O-pack-buckets", "lccs", lambda c: R.pack_buckets(c.select("layer", "lcc", "e"), ["layer"], "e", "lcc", 100), None)
register("O-bucketize", "part", lambda p: R.pack_buckets(p.select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("p_size")), ["p_brand"], "p_size", "p_partkey", 120), None)

# buckets
TH = "c AS (SELECT count(*) AS n FROM (SELECT src FROM edges UNION SELECT dst FROM edges) u), b AS (SELECT ln(n) / 2 AS b FROM c), t AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE floor(pow(b, i)) END AS th FROM b, range(0, 40) r(i))"
register("O-bucket-log", "edges lccs", lambda e, c: B.bucket_log(c.drop("bucket"), E.endpoints(e).count()).select("layer", "lcc", "e", "bucket"), f"WITH {TH} SELECT layer, lcc, e, (SELECT min(i) FROM t WHERE th > l.e) - 1 AS bucket FROM lccs l")
register("O-bucket-linear", "lccs", lambda c: B.bucket_linear(c.drop("bucket")).select("layer", "lcc", "e", "bucket"), "SELECT layer, lcc, e, dense_rank() OVER (ORDER BY e) - 1 AS bucket FROM lccs")
register("O-bucket-client", "lccs", lambda c: B.bucket_client(c.drop("bucket")).select("layer", "lcc", "e", "bucket"), "WITH b AS (SELECT ln(sum(e)) AS b FROM lccs), t AS (SELECT i, CASE WHEN i = 0 THEN 0 ELSE floor(pow(b, i)) END AS th FROM b, range(0, 40) r(i)) SELECT layer, lcc, e, (SELECT min(i) FROM t WHERE th > l.e) - 1 AS bucket FROM lccs l")
register("O-bucket-degcode", "members", lambda m: B.degree_code_duplicates(m.groupBy("layer", "lcc", "vertex").agg(F.count("*").alias("degree"))), "WITH h AS (SELECT layer, lcc, count(*) AS n FROM members GROUP BY layer, lcc) SELECT layer, '1:' || n AS code, count(*) AS n, min(lcc) AS \"first\" FROM h GROUP BY layer, h.n")
register("O-dedup-lcc", "lccs", B.dedup_lccs, "SELECT layer, v, e, min(lcc) AS lcc, count(*) AS duplicates FROM lccs GROUP BY layer, v, e")
register("O-dedup-lcc-members", "lccs", B.lcc_members, "SELECT layer, lcc, min(lcc) OVER (PARTITION BY layer, v, e) AS \"first\" FROM lccs")
register("O-sample-dup", "members lccs", lambda m, c: B.sample_without_duplicates(m.select("vertex", "layer", "lcc"), c).select("layer", "lcc", "vertex"), "SELECT m.layer, m.lcc, m.vertex FROM members m JOIN (SELECT layer, min(lcc) AS lcc FROM lccs GROUP BY layer, v, e) k ON m.layer = k.layer AND m.lcc = k.lcc")
register("O-split-single-spiral", "lccs", B.building_or_spiral, "SELECT bucket, layer, count(*) AS n, CASE WHEN count(*) = 1 THEN 'building' ELSE 'spiral' END AS kind FROM lccs GROUP BY bucket, layer")
register("O-viewer-bucket-nodes", "lccs", B.summed_by_bucket, "SELECT bucket, layer, CAST(sum(v) AS BIGINT) AS v, CAST(sum(e) AS BIGINT) AS e, count(*) AS n, count(*) > 1 AS spiral FROM lccs GROUP BY bucket, layer")

# layout
VOL = "3 * log2(ie + ee + 1) / (pi() * (pow(log2(t + 1), 2) + log2(t + 1) * log2(s + 1) + pow(log2(s + 1), 2)))"
register("O-frustum", "floors", lambda f: rounded(L.frusta(f).select("lcc", "wave", "height", "top")), f"SELECT lcc, wave, round(h, 6) AS height, round(sum(h) OVER (PARTITION BY lcc ORDER BY wave ROWS UNBOUNDED PRECEDING), 6) AS top FROM (SELECT *, {VOL} AS h FROM floors) x")
register("O-density-floor", "floors", lambda f: rounded(L.floor_densities(f)), "SELECT lcc, wave, round(CASE WHEN s * (s - 1) > 0 THEN 2.0 * ie / (s * (s - 1)) END, 6) AS ground, round(CASE WHEN s * (s + t) > 0 THEN (2.0 * ie + ee) / (s * (s + t)) END, 6) AS \"inner\", round(CASE WHEN s * t > 0 THEN ee / (s * t) END, 6) AS ceiling, round(CASE WHEN s * l > 0 THEN e_next / (s * l) END, 6) AS \"next\" FROM (SELECT *, lead(ss) OVER (PARTITION BY lcc ORDER BY wave) AS l FROM floors) x")
register("O-color-factor", "floors", lambda f: rounded(L.color_factor(f.select("lcc", ((F.col("ie") + 2.5) / (F.col("ee") + 1)).alias("density")))), "SELECT lcc, round(pow(d / (d - 1), 2), 6) AS factor FROM (SELECT lcc, avg((ie + 2.5) / (ee + 1)) AS d FROM floors GROUP BY lcc) x")
register("O-bush", "floors", lambda f: rounded(L.bush(f).select("lcc", "wave", "length", "width", "branches", "below")), "SELECT lcc, wave, round(log2(ie + ee + 1), 6) AS length, round(sqrt(log2(s + 1)), 6) AS width, CAST(ceil(log2(t + 1)) AS BIGINT) AS branches, round(coalesce(sum(log2(ie + ee + 1)) OVER (PARTITION BY lcc ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS below FROM floors")
register("O-floor-metrics", "floors", lambda f: rounded(L.floor_metrics(L.frusta(f))), f"SELECT lcc, round(sum({VOL}), 6) AS height, count(*) AS floors, CAST(sum(ie + ee) AS BIGINT) AS edges FROM floors GROUP BY lcc")
register("O-spiral", "buildings", lambda b: L.spiral(b.select(F.col("bucket").alias("spiral"), "building", "v", "e")), None)
register("O-voronoi", "positions", lambda p: L.plane_neighbors(p.select(F.floor(F.col("x") / 5).cast("long").alias("city"), "id", "x", "y")), None)
register("O-road-weight", "positions", lambda p: rounded(L.road_weights(p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), p)), "SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS weight FROM positions a JOIN positions b ON b.id = a.id + 1")
register("O-breakx", "layered", lambda e: rounded(L.broken_axis(e.select(F.col("layer").alias("peel")).distinct())), "SELECT peel, round(sum(1 + log10(1 + log10(gap))) OVER (ORDER BY peel ROWS UNBOUNDED PRECEDING), 6) AS x FROM (SELECT peel, peel - coalesce(lag(peel) OVER (ORDER BY peel), peel - 1) AS gap FROM (SELECT DISTINCT layer AS peel FROM layered) d) g")
