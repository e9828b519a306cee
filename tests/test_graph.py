import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from peelspark.operators import bucketing, components, dag, layout, partition, paths, peel, ranking
from peelspark.operators.components import component_edges, connected_components
from peelspark.operators.edges import sanitize
from peelspark.plans import hierarchy
from peelspark.sources import edges as src
from peelspark.sources import sinks
from peelspark.streaming import edges as stream

from . import brute

T1 = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (6, 7)]
T2 = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)] + [(5, 6), (6, 7)] + [(a, b) for a in range(7, 11) for b in range(a + 1, 11)] + [(20, 21), (20, 22), (21, 22)]
T3 = [(1, x) for x in range(2, 7)] + [(10, 11), (11, 12), (12, 13), (10, 13), (1, 10)]


def rand(n, p, seed):
    r = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < p]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("edges", [T1, T2, T3, rand(30, 0.2, 1), rand(40, 0.06, 2)])
def test_layers_and_waves(spark, edges):
    got = {(r.src, r.dst): r.layer for r in peel.fixed_point_layers(frame(spark, edges)).collect()}
    assert got == brute.layers(edges)
    layered = spark.createDataFrame([(*e, k) for e, k in got.items()], "src long, dst long, layer long")
    w = {(r.layer, r.id): (r.wave, r.frag) for r in peel.waves(layered).collect()}
    assert w == {(k, v): x for k in set(got.values()) for v, x in brute.waves([e for e in got if got[e] == k], k).items()}


def test_wide_ways_agree(spark, monkeypatch):
    edges = rand(25, 0.2, 5)
    monkeypatch.setattr(peel, "LOCAL", 0)
    assert {r.id: r.core for r in peel.coreness(frame(spark, edges)).collect()} == brute.cores(edges)
    got = {(r.src, r.dst): r.layer for r in peel.fixed_point_layers(frame(spark, edges)).collect()}
    assert got == brute.layers(edges)
    k = max(got.values())
    top = [e for e in got if got[e] == k]
    layered = spark.createDataFrame([(*e, k) for e in top], "src long, dst long, layer long")
    assert {r.id: (r.wave, r.frag) for r in peel.waves(layered).collect()} == brute.waves(top, k)


def test_components_are_closed_or_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "PART", 5)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.component for r in connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(path, max_steps=1)


def test_wide_waves_raise_the_threshold(spark, monkeypatch):
    # a tail on four linked vertices, a ring with a chord and a path, in components of their own
    edges = [(1, 2), (2, 3), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6), (10, 11), (11, 12), (12, 13), (10, 13), (10, 12), (20, 21), (21, 22)]
    layered = frame(spark, edges).withColumn("layer", F.lit(1).cast("long"))
    rows = lambda: {(r.id, r.wave, r.frag) for r in peel.waves(layered).collect()}
    rounds = lambda: {(r.src, r.dst): r.round for r in peel.iterative_waves(frame(spark, edges)).collect()}
    want = rows(), rounds()
    monkeypatch.setattr(peel, "LOCAL", 0)
    assert (rows(), rounds()) == want and set(want[1]) == set(edges)


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART", part)
    edges = rand(60, 0.02, 3)
    assert {r.id: r.component for r in component_edges(frame(spark, edges)).collect()} == brute.components(edges)
    line = [(i, i + 1) for i in range(50)]
    assert {r.component for r in component_edges(frame(spark, line)).collect()} == {0}
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, 4), (3, 4)], "u long, v long")
    assert {r.id: r.component for r in connected_components(odd).collect()} == {1: 1, 3: 3, 4: 3}
    assert connected_components(odd.limit(0)).count() == 0
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x"), ("z", "y")], "u string, v string")
    assert {r.id: r.component for r in connected_components(words).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "y", "z": "y"}
    # components inside equal keys, one of them null, and ids beyond 2^53
    big = 1 << 60
    keyed = spark.createDataFrame([(None, 1, big + 1), (None, big + 1, 5), (3, 1, 9), (3, big + 1, big), (4, 1, 1)], "layer long, src long, dst long")
    assert {(r.layer, r.id): r.component for r in component_edges(keyed, ("layer",)).collect()} == {(None, 1): 1, (None, 5): 1, (None, big + 1): 1, (3, 1): 1, (3, 9): 1, (3, big): big, (3, big + 1): big, (4, 1): 1}


def test_contraction_joins_what_edges_join():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 80))
        i, j = r.integers(0, n, (2, int(r.integers(0, 100))))
        want = brute.components([(int(a), int(b)) for a, b in zip(i, j)])
        got = components.least_joined(n, i, j)
        assert all(got[v] == want.get(v, v) for v in range(n))


def test_peeling_by_numbers_alone():
    for seed in range(40):
        edges = rand(5 + seed, 0.3 if seed % 2 else 0.08, seed)
        if not edges:
            continue
        ids = sorted({v for e in edges for v in e})
        u, v = (np.array([ids.index(e[k]) for e in edges]) for k in (0, 1))
        assert dict(zip(ids, peel.local_coreness(u, v, len(ids)).tolist())) == brute.cores(edges)
        assert dict(zip(edges, peel.local_layers(u, v, len(ids)).tolist())) == brute.layers(edges)
        wave, frag = peel.local_waves(u, v, len(ids), 1)
        assert dict(zip(ids, zip(wave.tolist(), frag.tolist()))) == brute.waves(edges, 1)


def test_edge_lists_with_more_columns(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# note\n1\t2\t0.5\n\n2\t3\t0.7\tx\n3\t4\n")
    assert sorted(map(tuple, src.read_edge_list(spark, str(tmp_path / "e.tsv")).collect())) == [(1, 2), (2, 3), (3, 4)]
    (tmp_path / "bad.tsv").write_text("1\t2\nx\t3\n4\n5\t6\t7\n")
    with pytest.raises(Exception, match="not an edge"):
        src.read_edge_list(spark, str(tmp_path / "bad.tsv")).collect()
    assert sorted(map(tuple, src.read_edge_list(spark, str(tmp_path / "bad.tsv"), bad="drop").collect())) == [(1, 2), (5, 6)]
    assert sorted(r.value for r in src.bad_edge_lines(spark, str(tmp_path / "bad.tsv")).collect()) == ["4", "x\t3"]


def test_random_graph(spark):
    pairs = [(r.src, r.dst) for r in src.random_graph(spark, 500, 0.1, 3).collect()]
    assert len(set(pairs)) == len(pairs) and all(0 <= a < b < 500 for a, b in pairs)
    assert abs(len(pairs) - 12_475) < 5 * (12_475 * 0.9) ** 0.5
    degree = np.bincount(np.array(pairs).ravel(), minlength=500)
    assert abs(degree[:250].mean() - degree[250:].mean()) < 3
    assert {(r.src, r.dst) for r in src.random_graph(spark, 30, 1.0).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}
    assert src.random_graph(spark, 30, 0.0).count() == 0 and src.random_graph(spark, 1, 0.5).count() == 0
    few = [(r.src, r.dst) for r in src.random_graph(spark, 200_000, 1e-7, 1).collect()]
    assert all(0 <= a < b < 200_000 for a, b in few) and 1_700 < len(few) < 2_300


def test_sanitize_empty_and_loops(spark):
    assert sanitize(frame(spark, [(1, 1), (2, 1), (1, 2), (None, 3)])).collect() == [(1, 2)]
    assert peel.fixed_point_layers(frame(spark, [(1, 1)])).count() == 0


def test_searches(spark):
    edges = rand(40, 0.08, 7)
    one = spark.createDataFrame([(edges[0][0],)], "id long")
    got = {r.id: r.dist for r in paths.bfs(frame(spark, edges), one).collect()}
    want = brute.distances(edges, [edges[0][0]])
    assert got == want
    far = max(want, key=want.get)
    path = paths.shortest_paths(frame(spark, edges), one, spark.createDataFrame([(far,)], "id long")).first().path
    assert len(path) == want[far] + 1 and all((min(a, b), max(a, b)) in edges for a, b in zip(path, path[1:]))


def test_sparse_net_covers(spark):
    edges = [(i, i + 1) for i in range(12)] + [(4, 20), (20, 21), (21, 22), (8, 30), (30, 31)]
    net = paths.sparse_net(frame(spark, edges)).collect()
    on = {v for r in net for v in r.path}
    assert set(brute.distances(edges, list(on)).values()) <= {0, 1}
    assert len(paths.sparse_net_approximate(frame(spark, edges)).collect()) <= len(net)


def test_follow_and_paths(spark):
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101)], "id long, to long")
    on = paths.follow(links, spark.createDataFrame([("a", 37), ("b", 3), ("c", 100), ("d", 500)], "key string, id long"))
    assert {(r.key, r.id) for r in on.collect()} == {("a", i) for i in range(38)} | {("b", i) for i in range(4)} | {("c", 100), ("c", 101), ("d", 500)}
    edges = rand(30, 0.12, 9)
    start = edges[0][0]
    want = brute.distances(edges, [start])
    targets = spark.createDataFrame([(v,) for v in (*want, 900)], "id long")
    got = {r.id: r.path for r in paths.shortest_paths(frame(spark, edges), spark.createDataFrame([(start,)], "id long"), targets).collect()}
    assert set(got) == set(want) and all(len(p) == want[v] + 1 and p[0] == start and p[-1] == v for v, p in got.items())
    assert all((min(a, b), max(a, b)) in edges for p in got.values() for a, b in zip(p, p[1:]))


def test_sparse_net_of_several_components(spark):
    edges = [(i, i + 1) for i in range(9)] + [(4, 20), (20, 21), (21, 22)] + [(50, 51), (51, 52)] + [(60, 61)]
    net = paths.sparse_net(frame(spark, edges)).collect()
    assert sorted(r.path_id for r in net) == list(range(len(net)))
    on = {v for r in net for v in r.path}
    reach = brute.distances(edges, list(on))
    assert set(reach) == {v for e in edges for v in e} and set(reach.values()) <= {0, 1}
    assert all((min(a, b), max(a, b)) in edges for r in net for a, b in zip(r.path, r.path[1:]))
    assert paths.sparse_net(frame(spark, [])).count() == 0


def test_ways_inside_nodes(spark):
    # nodes 1, 2, 3 of a longest path; the way through 2 takes three steps inside it, that through 3 none
    path = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 3, 4)], "pos long, src long, dst long")
    arcs = spark.createDataFrame([(10, 20, 1, 2), (11, 29, 1, 2), (22, 30, 2, 3), (30, 40, 3, 4)], "src long, dst long, n_src long, n_dst long")
    inner = spark.createDataFrame([(2, 20, 21), (2, 21, 22), (2, 20, 25), (2, 25, 26), (3, 30, 31)], "node long, src long, dst long")
    got = paths.expand_long_path(path, arcs, inner).orderBy("pos").collect()
    assert [r.id for r in got] == [10, 20, 21, 22, 30, 40]


def test_blocks(spark):
    # two triangles joined by a bridge, with a tail
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (6, 7)]
    found = paths.blocks(frame(spark, edges))
    by = {}
    for r in found.collect():
        by.setdefault(r.block, set()).add((r.src, r.dst))
    assert sorted(map(sorted, by.values())) == [[(1, 2), (1, 3), (2, 3)], [(3, 4)], [(4, 5), (4, 6), (5, 6)], [(6, 7)]]
    assert {r.id for r in paths.articulation_points(found).collect()} == {3, 4, 6}
    _, links = partition.articulation_metagraph(found)
    assert ("v_3", "v_4") in {tuple(r) for r in links.collect()}


@pytest.mark.parametrize("bound", [0, 30, 1 << 20])
def test_blocks_of_large_and_small_components(spark, monkeypatch, bound):
    monkeypatch.setattr(paths, "BLOCK_EDGES", bound)
    r = random.Random(bound)
    edges = {(a, b) for base, n, m in ((0, 40, 48), (100, 60, 150), (200, 9, 12), (300, 30, 26)) for a, b in (sorted((base + r.randrange(n), base + r.randrange(n))) for _ in range(m)) if a < b}
    edges |= {(400 + i, 401 + i) for i in range(12)} | {(400, 412), (405, 420), (500, 501)}
    # edges are in one block if no vertex parts them
    sides = {e: [] for e in edges}
    for x in {v for e in edges for v in e}:
        near = brute.components([e for e in edges if x not in e])
        for a, b in edges:
            end = b if a == x else a
            sides[a, b].append(near.get(end, end))
    all_, first = brute.components(edges), {}
    key = {e: (all_[e[0]], *sides[e]) for e in edges}
    for e in sorted(edges):
        first.setdefault(key[e], e)
    got = paths.blocks(frame(spark, [*edges, (7, 7), *((b, a) for a, b in edges)])).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, "-".join(map(str, first[key[a, b]]))) for a, b in edges)
    assert paths.blocks(frame(spark, [])).count() == 0


def test_blocks_are_searched_in_bounded_memory():
    r = np.random.default_rng(3)
    edges = np.unique(np.sort(r.integers(0, 15_000, (50_000, 2)), 1), axis=0)
    u, v = edges[edges[:, 0] < edges[:, 1]].T
    tracemalloc.start()
    paths._blocks_of(u, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 * len(u)


def test_orders_and_weights(spark):
    arcs = frame(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)])
    assert {r.id: r.level for r in dag.topological_levels(arcs).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert [(r.src, r.dst) for r in dag.longest_path(arcs).orderBy("pos").collect()] == [(1, 2), (2, 4), (4, 5)]
    w = {r.id: r.w for r in dag.natural_weights(arcs).collect()}
    assert w[5] == pytest.approx(1.0) and w[4] == pytest.approx(2 / 3)


def test_meta_dag_conserves_edges(spark):
    h = hierarchy.decompose(frame(spark, T2 + T3))
    for layer, lcc in [(r.layer, r.lcc) for r in h.lccs.collect()]:
        nodes, links = hierarchy.meta_dag_of(h, layer, lcc)
        here = h.edges.filter((F.col("layer") == layer) & (F.col("lcc") == lcc))
        assert dag.check_sizes(nodes, links, here).first().holds
    for r in h.lccs.collect():
        assert r.layer <= 2 * r.e / r.v < 2 * r.layer
    assert h.wave_edges.filter("wcc IS NULL").count() == 0


def test_connecting_arcs(spark):
    a = spark.createDataFrame([(1, 2, 0, 1), (3, 4, 2, 3), (2, 4, 1, 3), (1, 4, 0, 3)], "src long, dst long, ls long, lt long")
    assert {(r.src, r.dst) for r in dag.connect_by_jumps(a).collect()} == {(2, 4)}


def test_peeling_variants(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)]
    assert {r.id: r.step for r in paths.next_leaf(frame(spark, edges)).collect()} == {5: 0, 4: 1, 1: -1, 2: -1, 3: -1}
    assert {(r.src, r.dst) for r in peel.iterative_waves(frame(spark, edges)).collect()} == set(edges)
    got = peel.iterative_edges(frame(spark, edges), lambda e: peel.coreness(e).withColumnRenamed("core", "value")).collect()
    assert {(r.src, r.dst): r.value for r in got} == brute.layers(edges)
    assert {r.id for r in paths.solar_merge(frame(spark, edges)).collect()} == {1, 2, 3, 4, 5}


def test_rankings(spark):
    df = spark.range(100).withColumn("v", F.lit(3))
    assert [r["index"] for r in ranking.row_numbers(df, [F.desc("id")]).orderBy(F.desc("id")).collect()] == list(range(100))
    assert ranking.running_sum(df, "v", [F.col("id")], "s").filter("s <> 3 * (id + 1)").count() == 0
    packed = ranking.pack_buckets(spark.createDataFrame([(1, 5), (2, 6), (3, 20), (4, 1), (5, 9)], "id long, n long"), [], "n", "id", 10)
    assert [r.bucket for r in packed.orderBy("id").collect()] == [0, 1, 2, 3, 3]


def test_thresholds():
    # fixed values: thresholds of a graph of 18,337 vertices
    assert bucketing.log_thresholds(18337, 13000)[:7] == [0, 4, 24, 118, 580, 2848, 13983]
    assert bucketing.log_thresholds(5, 2) == [0, 1, 2, 3]


def test_layout(spark):
    square = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.1), (1, 3, 0.0, 1.0), (1, 4, 1.2, 1.3), (1, 5, 0.5, 0.5)], "city long, id long, x double, y double")
    got = {(r.a, r.b) for r in layout.plane_neighbors(square).collect()}
    assert {(1, 5), (2, 5), (3, 5), (4, 5)} <= got and (1, 4) not in got
    b = spark.createDataFrame([(1, i, 10 * i, 20 * i) for i in range(1, 8)], "spiral long, building long, v long, e long")
    assert layout.spiral(b).count() == 7


def test_trees(spark):
    s = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 1, 3, 5.0), (1, 3, 4, 1.0)], "net long, src long, dst long, weight double")
    assert [(r.id, r.dist) for r in paths.dijkstra(s, 1, 4).orderBy("pos").collect()] == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    at = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 5)], "id long, x double, y double")
    assert {(r.id, r.parent) for r in paths.minimum_tree(s, at, 1).collect()} == {(1, None), (2, 1), (3, 2), (4, 3)}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nSource,Target,w\n(1,2,5)\n2,3,7\n\n3,3,x\n")
    e = src.read_edges(spark, str(tmp_path / "a.txt"), {"w": "int"}, "w > 5")
    assert [tuple(r) for r in e.collect()] == [("2", "3", 7)]
    (tmp_path / "b.tsv").write_text("1\t2\n2\t3\n")
    assert src.read_edge_list(spark, str(tmp_path / "b.tsv")).count() == 2
    (tmp_path / "b.txt").write_text("")
    assert {(r.name, r.kind) for r in src.list_datasets(spark, f"file://{tmp_path}").collect()} == {("a", "txt"), ("b", "tsv")}
    (tmp_path / "l.csv").write_text('1,"a, ""b"""\n')
    labels = src.read_labels(spark, str(tmp_path / "l.csv"))
    assert labels.first().label == 'a, "b"'
    edges = frame(spark, T1)
    sinks.write_edge_list(edges, f"{tmp_path}/out", "src < 3")
    assert spark.read.text(f"{tmp_path}/out").count() == 3
    sinks.export_selection(edges, labels, f"{tmp_path}/sel")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.export_selection(edges, labels, f"{tmp_path}/sel")
    assert sinks.saved_or(spark, f"{tmp_path}/res", "x", lambda: edges).count() == 6
    assert sinks.saved_or(spark, f"{tmp_path}/res", "x", lambda: None).count() == 6
    parts = spark.createDataFrame([(1, 3, 2), (2, 9, 9), (3, 1, 1)], "part long, v long, e long")
    sinks.write_subgraphs(edges.withColumn("part", F.lit(1).cast("long")), parts, f"{tmp_path}/sub", 10)
    assert sinks.delete(spark, f"{tmp_path}/sub")
    sinks.write_properties(labels, f"{tmp_path}/props")
    assert spark.read.json(f"{tmp_path}/props/label").count() == 1
    assert src.random_graph(spark, 50, 0.5).count() in range(450, 780)


def test_paths_in_the_hierarchy(spark):
    h = hierarchy.decompose(frame(spark, T2))
    assert hierarchy.at_path(h.edges, "set/layer/4").count() == 10
    assert hierarchy.at_path(h.edges, "set/layer/2+3").count() == 9
    assert hierarchy.vicinity(h.edges, h.lccs, 4, h.lccs.filter("layer = 4").first().bucket).count() == 10


def test_streaming_degrees(spark, tmp_path):
    frame(spark, T1).write.parquet(f"{tmp_path}/in")
    live = stream.degrees_of_stream(spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in"))
    q = live.writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.degree for r in spark.table("degrees").collect()}[3] == 3
    seen = []
    q = stream.recompute_each_batch(spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in"), f"{tmp_path}/table", lambda df, n: seen.append(df.count()), f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == 6
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(7)], "i long, t string")
    assert len(list(stream.deliver(stream.chunks(rows, "i", "t"), "i", "t"))) == 3
