"""Edge lists: cleaning, both directions, subgraphs, projections of properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sanitize(edges: DataFrame) -> DataFrame:
    """Each undirected edge once as ``src < dst``; self loops and edges with a null end go."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each once."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def _inside(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    s, d = (vertices.select(F.col("id").alias(c)) for c in ("src", "dst"))
    return edges.join(s, "src", "left_semi").join(d, "dst", "left_semi").select(*edges.columns)


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices(id)``."""
    return _inside(edges, vertices)


def filter_vertices(edges: DataFrame, vertices: DataFrame, predicate: str | Column) -> DataFrame:
    """Edges between vertices that satisfy a predicate over the vertex columns."""
    return _inside(edges, vertices.filter(predicate).select("id"))


def filter_edges(edges: DataFrame, predicate: str | Column) -> tuple[DataFrame, DataFrame]:
    """Edges that satisfy a predicate, and their ends."""
    kept = edges.filter(predicate)
    return kept, endpoints(kept)


def neighbors(edges: DataFrame, vertex) -> DataFrame:
    return both_ways(edges).filter(F.col("src") == vertex).select(F.col("dst").alias("id"))


def ego_net(edges: DataFrame, vertex) -> DataFrame:
    """Edges among the neighbours of a vertex, without it."""
    return _inside(edges, neighbors(edges, vertex))


def project_vertices(part: DataFrame, parent: DataFrame, prop: str) -> DataFrame:
    """A property of the parent's vertices on those of a subgraph."""
    return part.join(parent.select("id", prop), "id", "left")


def project_edges(part: DataFrame, parent: DataFrame, prop: str) -> DataFrame:
    """A property of the parent's edges on those of a subgraph, whatever the direction."""
    ends = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    return part.select("*", *ends).join(parent.select(*ends, prop), ["_a", "_b"], "left").drop("_a", "_b")


def edge_from_vertices(edges: DataFrame, vertices: DataFrame, prop: str, fold=F.least) -> DataFrame:
    """An edge property from its ends' values, the smaller by default."""
    s, d = (vertices.select(F.col("id").alias(c), F.col(prop).alias(f"_{c}")) for c in ("src", "dst"))
    return edges.join(s, "src", "left").join(d, "dst", "left").withColumn(prop, fold("_src", "_dst")).select("src", "dst", prop)


def vertex_from_edges(vertices: DataFrame, edges: DataFrame, prop: str, fold=F.max, isolated=0) -> DataFrame:
    """A vertex property from its incident edges, the largest by default; ``isolated`` without edges."""
    held = edges.select(F.col("src").alias("id"), prop).unionAll(edges.select("dst", prop)).groupBy("id").agg(fold(prop).alias(prop))
    return vertices.select("id").join(held, "id", "left").fillna({prop: isolated})


def rows(table: DataFrame, predicate: str | Column, order: str = "id") -> DataFrame:
    """Rows that satisfy a predicate with their original position and their new one (both from 0)."""
    from .ranking import row_numbers

    numbered = row_numbers(table, [F.col(order)], "original_index")
    return row_numbers(numbered.filter(predicate), [F.col(order)], "index")


def path_edges(paths: DataFrame) -> DataFrame:
    """Edges along ``paths(path_id, path)``, with their place."""
    steps = paths.select("path_id", F.posexplode("path").alias("pos", "src"), "path")
    return steps.select("path_id", "pos", "src", F.try_element_at("path", F.col("pos") + 2).alias("dst")).filter("dst IS NOT NULL")


def path_subgraph(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges between any two vertices of the paths."""
    return _inside(edges, paths.select(F.explode("path").alias("id")).distinct())


def sparse_net_subgraph(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges that paths run along."""
    on = path_edges(paths).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.join(on, ["src", "dst"], "left_semi")


def union_graphs(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of subgraphs ``(graph_id, src, dst)``: vertices with their largest graph, edges once."""
    v = graphs.select("graph_id", F.col("src").alias("id")).unionAll(graphs.select("graph_id", "dst")).groupBy("id").agg(F.max("graph_id").alias("graph_id"))
    return v, sanitize(graphs)


def append(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """Edges of two data sets; the second's vertex numbers follow the first's ``size`` ones."""
    return first.select("src", "dst").unionAll(second.select(F.col("src") + size, F.col("dst") + size))
