"""Look-ups and exports by the forms of a meta-DAG, data sets, csv forms, and the decomposition of a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dag as D
from ..operators import joins as J
from ..operators import layout as L
from ..operators import peel
from ..plans import cache
from ..plans import hierarchy as H
from ..sources import edges as src
from ..sources import sinks
from ..sources.datasets import DataFolder
from ..store import new_path
from .base import FAR, register, rounded

# meta nodes with every grouping: a level stands for (wave, fragment), three fragments a wave
WIDTH = "(SELECT min(w) FROM (SELECT CAST(power(2, i) AS BIGINT) AS w FROM range(0, 40) t(i)) x WHERE (SELECT count(*) FROM links l JOIN nodes a ON l.src = a.node JOIN nodes b ON l.dst = b.node WHERE a.level // w <> b.level // w) < 8192)"
GROUPED = f"g AS (SELECT *, level // {WIDTH} AS cut, level // 3 AS wave, level % 3 AS frag, CAST(floor(log2(1 + e)) AS BIGINT) AS size_class FROM nodes)"


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    bucket = F.floor(F.log2(1 + F.col("e"))).cast("long")
    return D.edge_cut(nodes, links).withColumns({"wave": F.floor(F.col("level") / 3).cast("long"), "frag": F.col("level") % 3, "size_class": bucket})


register("O-dag-edgecut", "nodes links", lambda n, l: D.edge_cut(n, l, 8192).select("node", "cut"), f"SELECT node, level // {WIDTH} AS cut FROM nodes")
register("O-dag-edgecut-narrow", "nodes links", lambda n, l: D.edge_cut(n, l, 300).select("node", "cut"), f"SELECT node, level // {WIDTH.replace('8192', '300')} AS cut FROM nodes")
FORMS = {"edgeCut": ("cut", [0]), "wf-frag": ("level", [2, 3]), "wf-dag": ("wave", [1]), "wf-frag-bucket": ("size_class", [6]), "full": ("layer", [1]), "wave-mini": ("wave", [0, 1])}
for form, (group, values) in FORMS.items():
    few = ", ".join(map(str, values))
    with_layer = lambda n: n.withColumn("layer", F.lit(1))
    where = f"SELECT node FROM (SELECT *, 1 AS layer FROM g) y WHERE {group} IN ({few})"
    register(f"O-q-metadag-{form}", "nodes links", lambda n, l, g=group, v=values: D.inside(with_layer(grouped(n, l)), l, g, v)[0].select("node", "level", "v", "e"), f"WITH {GROUPED} SELECT node, level, v, e FROM nodes WHERE node IN ({where})")
    register(f"O-q-metadag-{form}-links", "nodes links", lambda n, l, g=group, v=values: D.inside(with_layer(grouped(n, l)), l, g, v)[1].select("src", "dst", "e"), f"WITH {GROUPED} SELECT src, dst, e FROM links WHERE src IN ({where}) AND dst IN ({where})")

for name, group in (("O-dag-wf-wave", "wave"), ("O-dag-wf-frag", "frag")):
    both = f"{GROUPED}, x AS (SELECT a.{group} AS ga, b.{group} AS gb, l.e FROM links l JOIN g a ON l.src = a.node JOIN g b ON l.dst = b.node)"
    register(name, "nodes links", lambda n, l, g=group: D.regroup(grouped(n, l), l, g)[0], f"WITH {both}, i AS (SELECT ga, count(*) AS m, sum(e) AS e FROM x WHERE ga = gb GROUP BY ga) SELECT n.{group}, CAST(sum(v) AS BIGINT) AS v, CAST(sum(n.e) + coalesce(max(i.e), 0) AS BIGINT) AS e, count(*) AS meta_v, coalesce(max(m), 0) AS meta_e FROM g n LEFT JOIN i ON n.{group} = ga GROUP BY n.{group}")
    register(f"{name}-links", "nodes links", lambda n, l, g=group: D.regroup(grouped(n, l), l, g)[1], f"WITH {both} SELECT ga AS src, gb AS dst, CAST(sum(e) AS BIGINT) AS e, count(*) AS meta_e FROM x WHERE ga <> gb GROUP BY ga, gb")

SHOWN = f"""{GROUPED}, x AS (SELECT a.wcc AS wa, b.wcc AS wb, a.cut AS ca, b.cut AS cb, a.level AS la, b.level AS lb, l.e FROM links l JOIN g a ON l.src = a.node JOIN g b ON l.dst = b.node),
by_wcc AS (SELECT wa AS src, wb AS dst, CAST(sum(e) AS BIGINT) AS e, count(*) AS meta_e FROM x WHERE wa <> wb GROUP BY wa, wb),
by_cut AS (SELECT ca AS src, cb AS dst, CAST(sum(e) AS BIGINT) AS e, count(*) AS meta_e FROM x WHERE ca <> cb GROUP BY ca, cb),
by_level AS (SELECT la AS src, lb AS dst, CAST(sum(e) AS BIGINT) AS e, count(*) AS meta_e FROM x WHERE la <> lb GROUP BY la, lb),
c AS (SELECT CASE WHEN (SELECT count(*) FROM by_wcc) < 8192 OR (SELECT count(*) FROM links) < 8192 THEN 1 WHEN (SELECT count(*) FROM by_cut) < 8192 THEN 2 ELSE 3 END AS form)"""
register("O-q-metadag", "nodes links", D.chosen_form, f"WITH {SHOWN} SELECT * FROM by_wcc WHERE (SELECT form FROM c) = 1 UNION ALL SELECT * FROM by_cut WHERE (SELECT form FROM c) = 2 UNION ALL SELECT * FROM by_level WHERE (SELECT form FROM c) = 3")
register("O-dag-topsrc", "arcs", D.top_source_links, "SELECT src, dst FROM arcs WHERE lt = ls + 1")

# labels of the vertices under a node of each form
LABEL = "coalesce(l.label, CAST(v.id AS VARCHAR)) AS label"
register("O-q-label-node", "vertices labels_v", lambda v, l: J.with_labels(v.filter("value IN (3, 5)").select("value", "id"), l), f"SELECT v.value, v.id, {LABEL} FROM vertices v LEFT JOIN labels_v l ON v.id = l.id WHERE v.value IN (3, 5)")
register("O-q-label-edgeCut", "levels labels_v", lambda v, l: J.with_labels(v.select(F.floor(F.col("level") / 4).cast("long").alias("cut"), "id").filter("cut = 1"), l), f"SELECT v.level // 4 AS cut, v.id, {LABEL} FROM levels v LEFT JOIN labels_v l ON v.id = l.id WHERE v.level // 4 = 1")
register("O-q-label-wcc", "wedges labels_v", lambda w, l: J.with_labels(w.filter("wcc = 3").select("wcc", F.explode(F.array("src", "dst")).alias("id")).distinct(), l), f"SELECT v.wcc, v.id, {LABEL} FROM (SELECT wcc, src AS id FROM wedges WHERE wcc = 3 UNION SELECT wcc, dst FROM wedges WHERE wcc = 3) v LEFT JOIN labels_v l ON v.id = l.id")


def exported(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A selection through the files with header that a viewer reads: each edge with the label of its end."""
    spark, path = edges.sparkSession, new_path(edges.sparkSession, "export")
    sinks.export_selection(edges, labels.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"), path)
    names = spark.read.csv(f"{path}/labels", header=True).select(F.col("new_id").alias("target"), "name")
    back = src.read_edges(spark, f"{path}/edges").toDF("source", "target").join(names, "target", "left")
    return back.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "name")


def viewed(edges: DataFrame) -> DataFrame:
    """A selection through a plain edge list."""
    path = new_path(edges.sparkSession, "view")
    sinks.write_edge_list(edges, path, sep="\t")
    return src.read_edge_list(edges.sparkSession, path)


WITH_NAMES = "SELECT e.src AS source, e.dst AS target, l.label AS name FROM {} e LEFT JOIN labels_v l ON e.dst = l.id WHERE {}"
SELECTED = {"building": ("edges vertices", lambda e, v: J.semi(e, v.filter("value = 5").select(F.col("id").alias("src")), ["src"]), "edges", "e.src IN (SELECT id FROM vertices WHERE value = 5)"), "edgeCut": ("edges levels", lambda e, v: J.semi(e, v.filter("level BETWEEN 4 AND 7").select(F.col("id").alias("src")), ["src"]), "edges", "e.src IN (SELECT id FROM levels WHERE level BETWEEN 4 AND 7)"), "wcc": ("wedges levels", lambda w, _: w.filter("wcc = 3").select("src", "dst"), "wedges", "e.wcc = 3")}
for name, (inputs, select, table, where) in SELECTED.items():
    register(f"O-q-{name}2export", f"{inputs} labels_v", lambda a, b, l, f=select: exported(f(a, b), l), WITH_NAMES.format(table, where))
    register(f"O-q-{name}2edges", inputs, lambda a, b, f=select: viewed(f(a, b)), f"SELECT e.src, e.dst FROM {table} e WHERE {where}")
register("O-q-edgeCut-export", "arcs labels_v", lambda a, l: exported(a.filter("floor(ls / 16) = 2 AND floor(lt / 16) = 2").select("src", "dst"), l), WITH_NAMES.format("arcs", "e.ls // 16 = 2 AND e.lt // 16 = 2"))

# a (layer, bucket) as a graph of its own, for either viewer
VICINITY = "FROM layered e JOIN lccs c ON c.layer = e.layer AND c.lcc = e.dst - {} WHERE e.layer = 2 AND c.bucket = 1".format(FAR)
near = lambda e, c: H.vicinity(e.withColumn("lcc", F.col("dst") - FAR), c, 2, 1)
register("O-q-city-vicinity-edges", "layered lccs", lambda e, c: viewed(near(e, c)), f"SELECT e.src, e.dst {VICINITY}")
register("O-q-city-vicinity-export", "layered lccs labels_v", lambda e, c, l: exported(near(e, c), l), f"SELECT e.src AS source, e.dst AS target, l.label AS name FROM (SELECT e.src, e.dst {VICINITY}) e LEFT JOIN labels_v l ON e.dst = l.id")

# writers and readers that other queries leave out
register("O-snk-edgelist", "priced", lambda p: src.read_edges(p.sparkSession, _written(p, lambda d, at: sinks.write_edge_list(d, at, "quantity > 40"))).select(F.col("src").cast("long"), F.col("dst").cast("long")), "SELECT src, dst FROM priced WHERE quantity > 40")
register("O-snk-subgraphs", "layered", lambda e: e.sparkSession.read.parquet(_written(e, _by_parts)).select("part", "src", "dst"), f"SELECT dst - {FAR} AS part, src, dst FROM layered")
register("O-snk-subgraphs-buckets", "lccs", lambda c: _limits(c), "SELECT true AS within")
register("O-src-labels", "labels_v", lambda l: src.read_labels(l.sparkSession, _written(l, lambda d, at: d.select("id", "label").write.csv(at, quote='"', escape='"', quoteAll=True))), "SELECT id, label FROM labels_v")
register("O-src-csvstream-array", "priced", lambda p: src.to_array(p, "quantity * 2", "quantity > 10"), "SELECT quantity * 2 AS value FROM priced WHERE quantity > 10")
register("O-src-csvstream-map", "priced", lambda p: src.to_map(p, "src", "quantity", ["quantity", "dst"], "value = 1"), "SELECT src AS key, max(quantity) AS value FROM priced WHERE value = 1 GROUP BY src")
register("O-src-csvstream-multimap", "layered", lambda e: src.to_multimap(e, ["src"], "layer", "layer > 1").select("key", F.array_join("values", ",").alias("values")), "SELECT src AS key, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) AS \"values\" FROM layered WHERE layer > 1 GROUP BY src")
register("O-src-csvstream-both", "priced", lambda p: src.to_both(p, "value", "src % 100", "quantity").select("key", F.array_join("values", ",").alias("values"), "size"), "SELECT value AS key, string_agg(CAST(src % 100 AS VARCHAR), ',' ORDER BY src % 100) AS \"values\", CAST(sum(quantity) AS BIGINT) AS size FROM priced GROUP BY value")
register("O-src-scan-datadir", "region edges", lambda r, e: _folder(e)[0].names(), "SELECT * FROM (VALUES ('a', 'tsv'), ('b', 'txt')) t(name, kind)")
register("O-q-datasets", "region edges", lambda r, e: _folder(e, "a")[0].names(), "SELECT * FROM (VALUES ('b', 'txt')) t(name, kind)")
register("O-q-dataset-edges", "edges", lambda e: _folder(e)[0].edges("b").select(F.col("src").cast("long"), F.col("dst").cast("long")), "SELECT src, dst FROM edges")
register("O-q-extradata", "vertices labels_v positions", lambda v, l, p: J.with_attributes(v.select("id", "value"), l, p.select((F.col("id") + FAR).alias("id"), "x")), f"SELECT v.id, v.value, l.label, p.x FROM vertices v LEFT JOIN labels_v l ON v.id = l.id LEFT JOIN (SELECT id + {FAR} AS id, x FROM positions) p ON v.id = p.id")
ORDER = "ORDER BY e DESC, building"
register("O-q-best-cache", "buildings", lambda b: cache.best_buildings(b, "e", [F.desc("e"), F.col("building")], 20_000).select("building", "e"), f"SELECT building, e FROM (SELECT building, e, sum(e) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS s FROM buildings) x WHERE s <= 15000")
register("O-q-cache", "layered buildings", lambda e, b: _warmed(e, b), f"SELECT src, dst, layer FROM layered WHERE dst - {FAR} IN (SELECT building FROM (SELECT building, sum(e) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS s FROM buildings) x WHERE s <= 15000)")
register("O-q-checkBuildingCache", "buildings", lambda b: _asked(b), f"SELECT building, building IN (SELECT building FROM (SELECT building, sum(e) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS s FROM buildings) x WHERE s <= 15000) AS cached FROM buildings WHERE building IN (1, 2, 3)")
DIAL = "(SELECT lcc AS building, wave, s AS source, s + t AS vertices, ie + ee AS edges FROM floors)"
register("O-speedometer", "floors", lambda f: _dials(f), f"WITH q AS (SELECT building, wave, ln(edges + 1) / (ln(vertices + 1) * ln(source + 1)) AS ratio FROM {DIAL} d), h AS (SELECT building, wave, asin(ratio / (SELECT max(ratio) FROM q)) AS share FROM q), w AS (SELECT building, wave, share * pi() * 7 / 4 / (SELECT max(s) FROM (SELECT sum(share) AS s FROM h GROUP BY building) x) AS width FROM h), b AS (SELECT building, (2.0 * sum(edges) / sum(vertices) / (1 + building % 5) - 1) * pi() AS start FROM {DIAL} d GROUP BY building) SELECT w.building, wave, round(start + sum(width) OVER o - width, 6) AS opens, round(start + sum(width) OVER o, 6) AS closes FROM w JOIN b ON w.building = b.building WINDOW o AS (PARTITION BY w.building ORDER BY wave ROWS UNBOUNDED PRECEDING)")

# a forest of stars has known layers and waves: leaves go first, a centre of several then stands alone
SIZES = "f AS (SELECT src, count(*) AS n FROM forest GROUP BY src)"
CORE = """adj AS (SELECT src AS a, dst AS b FROM {0} UNION ALL SELECT dst, src FROM {0}),
r(id, core) USING KEY (id) AS (SELECT a, count(*) FROM adj GROUP BY a UNION
SELECT h.a, h.core FROM (SELECT x.a, max(least(x.core, x.n)) AS core FROM (SELECT adj.a, c.core, row_number() OVER (PARTITION BY adj.a ORDER BY c.core DESC) AS n FROM adj JOIN recurring.r c ON c.id = adj.b WHERE adj.a IN (SELECT t.a FROM adj t JOIN r ON r.id = t.b)) x GROUP BY x.a) h JOIN recurring.r o ON o.id = h.a WHERE h.core < o.core)"""
TOP = "JOIN r a ON a.id = e.src JOIN r b ON b.id = e.dst WHERE a.core = (SELECT max(core) FROM r) AND b.core = (SELECT max(core) FROM r)"
for name, graph in (("O-coreness", "edges"), ("O-coreness-dense", "layered")):
    register(name, graph, peel.coreness, f"WITH RECURSIVE {CORE.format(graph)} SELECT id, core FROM r")
for name, graph in (("O-fixedpoint-top", "edges"), ("O-fixedpoint-top-dense", "layered")):
    register(name, graph, lambda e: _top(peel.fixed_point_layers(e)), f"WITH RECURSIVE {CORE.format(graph)} SELECT e.src, e.dst, a.core AS layer FROM {graph} e {TOP}")
register("O-fixedpoint-forest", "forest", peel.fixed_point_layers, "SELECT src, dst, CAST(1 AS BIGINT) AS layer FROM forest")
register("O-waves-forest", "forest", lambda e: peel.waves(e.withColumn("layer", F.lit(1).cast("long"))), f"WITH {SIZES} SELECT CAST(1 AS BIGINT) AS layer, src AS id, CAST(0 AS BIGINT) AS wave, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS BIGINT) AS frag FROM f UNION ALL SELECT 1, dst, 0, 0 FROM forest")
register("O-hierarchy-forest", "forest", lambda e: H.decompose(e).lccs.select("layer", "lcc", "v", "e"), f"WITH {SIZES} SELECT CAST(1 AS BIGINT) AS layer, src AS lcc, n + 1 AS v, n AS e FROM f")
register("O-hierarchy-forest-waves", "forest", lambda e: H.decompose(e).wave_edges.select("layer", "lcc", "src", "dst", "wave", "frag", "wcc"), "SELECT CAST(1 AS BIGINT) AS layer, src AS lcc, src, dst, CAST(0 AS BIGINT) AS wave, CAST(0 AS BIGINT) AS frag, src AS wcc FROM forest")
register("O-hierarchy-forest-levels", "forest", lambda e: H.decompose(e).waves.select("layer", "id", "lcc", F.col("level").cast("long").alias("level")), f"WITH {SIZES} SELECT CAST(1 AS BIGINT) AS layer, src AS id, src AS lcc, CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS BIGINT) AS level FROM f UNION ALL SELECT 1, dst, src, 0 FROM forest")


def _top(layers: DataFrame) -> DataFrame:
    return layers.join(F.broadcast(layers.agg(F.max("layer").alias("layer"))), "layer").select("src", "dst", "layer")


def _dials(floors: DataFrame) -> DataFrame:
    own = floors.select(F.col("lcc").alias("building"), "wave", F.col("s").alias("source"), (F.col("s") + F.col("t")).alias("vertices"), (F.col("ie") + F.col("ee")).alias("edges"))
    mean = (2.0 * F.sum("edges") / F.sum("vertices")).alias("mean_degree")
    return rounded(L.speedometer(own, own.groupBy("building").agg(mean, (1 + F.first("building") % 5).alias("layer"))))


def _written(df: DataFrame, write) -> str:
    path = new_path(df.sparkSession, "written")
    write(df, path)
    return path


def _parts(edges: DataFrame) -> DataFrame:
    return edges.select((F.col("dst") - FAR).alias("part"), "src", "dst")


def _by_parts(edges: DataFrame, path: str) -> None:
    own = _parts(edges)
    sizes = own.groupBy("part").agg((F.count("*") + 1).alias("v"), F.count("*").alias("e"))
    sinks.write_subgraphs(own, sizes, path, 1_000)


def _limits(lccs: DataFrame) -> DataFrame:
    """Whether every bucket of several parts stays within the limit."""
    edges = lccs.select((F.col("lcc") * 10 + F.col("layer")).alias("part"), F.lit(1).alias("src"), F.lit(2).alias("dst"))
    packed = sinks.write_subgraphs(edges, lccs.select((F.col("lcc") * 10 + F.col("layer")).alias("part"), "v", "e"), new_path(lccs.sparkSession, "packed"), 500)
    sums = packed.groupBy("bucket").agg(F.sum(F.greatest("v", "e")).alias("s"), F.count("*").alias("n"))
    return sums.agg(F.max(F.when(F.col("n") > 1, F.col("s")).otherwise(0)).alias("most")).select((F.col("most") <= 500).alias("within"))


def _folder(edges: DataFrame, without: str | None = None) -> tuple[DataFolder]:
    folder = DataFolder(edges.sparkSession, new_path(edges.sparkSession, "folder"))
    for name, kind in (("a", "csv"), ("a", "tsv"), ("b", "txt")):
        folder.add(name, edges, kind)
    if without:
        folder.delete(without)
    return (folder,)


def _best(buildings: DataFrame) -> DataFrame:
    return cache.best_buildings(buildings, "e", [F.desc("e"), F.col("building")], 20_000)


def _warmed(edges: DataFrame, buildings: DataFrame) -> DataFrame:
    own = edges.withColumn("building", F.col("dst") - FAR)
    return cache.warm(own, _best(buildings), ["building"]).select("src", "dst", "layer")


def _asked(buildings: DataFrame) -> DataFrame:
    best = _best(buildings)
    rows = [(i, cache.cached(best, {"building": i})) for i in (1, 2, 3)]
    return buildings.sparkSession.createDataFrame(rows, "building long, cached boolean")
