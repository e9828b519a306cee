"""Look-ups on the tables of a hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ranking as R
from ..plans import hierarchy as H
from ..sources import edges as src
from ..sources import sinks
from .base import FAR, register

part_id = lambda: F.concat_ws("_", "layer", "lcc")
summary = lambda c: c.select(part_id().alias("id"), "v", "e")
register("O-q-subgraph-id", "lccs", lambda c: H.find_subgraphs(summary(c), min_v=20, max_e=600, min_e=5), "SELECT layer || '_' || lcc AS id FROM lccs WHERE v >= 20 AND e BETWEEN 5 AND 600")
register("O-q-subgraph-id-first", "lccs", lambda c: H.find_subgraphs(summary(c), first=True, min_v=10), "SELECT min(layer || '_' || lcc) AS id FROM lccs WHERE v >= 10")
register("O-q-summary", "lccs", lambda c: sinks.size_histograms(c.select(F.col("lcc").alias("part"), "v", "e")), "SELECT v, e, count(*) AS n, min(lcc) AS \"first\", max(lcc) AS \"last\" FROM lccs GROUP BY v, e")
register("O-q-path", "members", lambda m: H.at_path(m, "set/layer/1+3/CC/2"), "SELECT * FROM members WHERE layer IN (1, 3) AND lcc = 2")
register("O-q-idmap", "vertices labels_v", lambda v, l: v.select("id").join(l, "id", "left"), "SELECT v.id, l.label FROM vertices v LEFT JOIN labels_v l ON v.id = l.id")
register("O-q-metadag-wcc", "nodes", lambda n: n.filter("wcc = 3").select("node", "level", "v", "e"), "SELECT node, level, v, e FROM nodes WHERE wcc = 3")
register("O-q-metadag-links", "nodes links", lambda n, l: l.join(n.filter("wcc <= 5").select(F.col("node").alias("src")), "src", "left_semi").join(n.filter("wcc <= 5").select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "e"), "SELECT src, dst, e FROM links WHERE src IN (SELECT node FROM nodes WHERE wcc <= 5) AND dst IN (SELECT node FROM nodes WHERE wcc <= 5)")
register("O-q-metadag-node", "edges vertices labels_v", lambda e, v, l: J.with_labels(J.edges_of_nodes(e, v.select("id", F.col("value").alias("node")), True).filter(F.col("node").isin(3, 7)).select("node", "src", F.col("dst").alias("id")), l), "SELECT x.node, x.src, x.id, coalesce(l.label, CAST(x.id AS VARCHAR)) AS label FROM (SELECT a.value AS node, e.src, e.dst AS id FROM edges e JOIN vertices a ON e.src = a.id UNION ALL SELECT b.value, e.src, e.dst FROM edges e JOIN vertices a ON e.src = a.id JOIN vertices b ON e.dst = b.id WHERE a.value <> b.value) x LEFT JOIN labels_v l ON x.id = l.id WHERE x.node IN (3, 7)")
LABELED = f"j AS (SELECT DISTINCT m.layer, m.lcc, l.id, l.label FROM labels_v l JOIN members m ON l.id = m.vertex + {FAR})"
labeled = lambda m, l: m.select("layer", "lcc", (F.col("vertex") + FAR).alias("id")).distinct().join(l, "id")
register("O-q-label", "members labels_v", lambda m, l: labeled(m, l).filter("layer = 2 AND lcc = 4").select("id", "label"), f"WITH {LABELED} SELECT id, label FROM j WHERE layer = 2 AND lcc = 4")
register("O-q-label-bucketed", "members labels_v", lambda m, l: R.log_top(labeled(m, l), ["layer", "lcc"], ["label", "id"]).select("layer", "lcc", "id", "label"), f"WITH {LABELED}, r AS (SELECT *, row_number() OVER (PARTITION BY layer, lcc ORDER BY label, id) AS r, count(*) OVER (PARTITION BY layer, lcc) AS n FROM j) SELECT layer, lcc, id, label FROM r WHERE r <= ceil(log2(1 + n))")
register("O-pair-labels", "members", lambda m: J.pair_labels(m.sparkSession.createDataFrame([(1, 2)], "a long, b long"), m.select(F.col("lcc").alias("part"), F.col("vertex").alias("id")).distinct(), m.select(F.col("vertex").alias("id"), F.concat(F.lit("v"), F.col("vertex").cast("string")).alias("label")).distinct()), "SELECT CAST(1 AS BIGINT) AS a, CAST(2 AS BIGINT) AS b, vertex AS id, 'v' || vertex AS label FROM (SELECT vertex FROM members WHERE lcc = 1 INTERSECT SELECT vertex FROM members WHERE lcc = 2) x")
register("O-src-random", "region", lambda r: src.random_graph(r.sparkSession, 300, 0.05), None)
