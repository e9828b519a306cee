"""The whole decomposition as one function of an edge table, and the look-ups on its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bucketing, dag, peel
from ..operators import edges as e
from ..operators.components import component_edges
from ..operators.ranking import level_rank
from ..store import keep


@dataclass
class Hierarchy:
    """Tables of a decomposition; ids of components are their smallest vertex."""

    edges: DataFrame  # src, dst, layer, lcc
    members: DataFrame  # vertex, cc, layer, lcc
    lccs: DataFrame  # layer, lcc, v, e, bucket
    waves: DataFrame  # layer, lcc, id, wave, frag, level
    wave_edges: DataFrame  # layer, lcc, src, dst, wave, frag, wcc


def decompose(raw: DataFrame) -> Hierarchy:
    """Components, fixed points, their components, waves and fragments, size buckets of any ``raw(src, dst)``."""
    clean = keep(e.sanitize(raw), "edges")
    cc = keep(component_edges(clean).select(F.col("id").alias("vertex"), F.col("component").alias("cc")), "cc")
    layered = keep(peel.fixed_point_layers(clean), "layered")
    parts = keep(component_edges(layered, ("layer",)).select("layer", F.col("id").alias("vertex"), F.col("component").alias("lcc")), "lcc")
    members = parts.join(cc, "vertex").select("vertex", "cc", "layer", "lcc")
    placed = keep(layered.join(parts.select("layer", F.col("vertex").alias("src"), "lcc"), ["layer", "src"]).select("src", "dst", "layer", "lcc"), "placed")
    lccs = parts.groupBy("layer", "lcc").agg(F.count("*").alias("v")).join(placed.groupBy("layer", "lcc").agg(F.count("*").alias("e")), ["layer", "lcc"])
    lccs = bucketing.bucket_log(keep(lccs, "lccs"), cc.count())
    w = peel.waves(layered).join(parts.select("layer", F.col("vertex").alias("id"), "lcc"), ["layer", "id"])
    w = keep(level_rank(w, ["layer", "lcc"], ["wave", "frag"]), "waves")
    ends = [w.select("layer", F.col("id").alias(c), F.struct("wave", "frag").alias(f"k_{c}")) for c in ("src", "dst")]
    we = placed.join(ends[0], ["layer", "src"]).join(ends[1], ["layer", "dst"]).withColumn("k", F.least("k_src", "k_dst"))
    we = keep(we.select("layer", "lcc", "src", "dst", "k.wave", "k.frag"), "wave-edges")
    wcc = component_edges(we, ("layer", "wave")).select("layer", "wave", F.col("id").alias("src"), F.col("component").alias("wcc"))
    return Hierarchy(placed, members, lccs, w, we.join(wcc, ["layer", "wave", "src"]))


def at_path(edges: DataFrame, path: str) -> DataFrame:
    """Edges under a data path such as ``set/layer/3/CC/7`` or, as a union, ``set/layer/1+2+3``."""
    names = {"layer": "layer", "cc": "lcc", "wave": "wave", "frag": "frag", "wcc": "wcc"}
    steps = path.strip("/").split("/")[1:]
    for name, value in zip(steps[::2], steps[1::2], strict=True):
        edges = edges.filter(F.col(names[name.lower()]).isin([int(v) for v in value.split("+")]))
    return edges


def find_subgraphs(summary: DataFrame, first: bool = False, **bounds: int) -> DataFrame:
    """Ids of the parts whose sizes keep the bounds v, min_v, max_v, e, min_e, max_e."""
    for name, value in bounds.items():
        kind, _, column = name.rpartition("_")
        c = F.col(column)
        summary = summary.filter(c >= value if kind == "min" else c <= value if kind == "max" else c == value)
    ids = summary.select("id")
    return ids.orderBy("id").limit(1) if first else ids


def vicinity(edges: DataFrame, buckets: DataFrame, layer: int, bucket: int) -> DataFrame:
    """Edges of a (layer, bucket), to be decomposed as a graph of their own."""
    lccs = buckets.filter((F.col("layer") == layer) & (F.col("bucket") == bucket)).select("layer", "lcc")
    return edges.join(lccs, ["layer", "lcc"], "left_semi").select("src", "dst")


def meta_dag_of(h: Hierarchy, layer: int, lcc: int) -> tuple[DataFrame, DataFrame]:
    """Meta-DAG of one building."""
    here = (F.col("layer") == layer) & (F.col("lcc") == lcc)
    levels = h.waves.filter(here).select("id", "level")
    return dag.meta_dag(dag.with_levels(h.edges.filter(here).select("src", "dst"), levels), levels)
