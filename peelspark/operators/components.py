"""Connected components by contraction in partitions and alternating stars.

Edges are dealt into partitions of about ``PART`` edges, and each partition joins
what its edges connect: a row for each vertex but the least remains.  One
partition is then done.  Several go on by alternating large-star and small-star
steps; each is one shuffle by vertex, and stars shorten paths so that the number
of steps grows with the logarithm of the longest path.  State is a table in the
shared folder, so a lost executor costs a task and not the run.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import drop, keep

#: Edges that one task contracts (some 100 bytes each while it does).
PART = 1 << 20


def least_joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the least one that the pairs join with it."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label = nearer


def _fields(c: str, kind: T.DataType) -> list[Column] | None:
    """A vertex column as longs in its order, a struct's each with whether it is there; None for vertices of other types."""
    parts = [F.col(f"{c}.`{f.name}`") for f in kind.fields] if isinstance(kind, T.StructType) else [F.col(c)]
    types = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind]
    if not all(isinstance(t, T.IntegralType) for t in types):
        return None
    if not isinstance(kind, T.StructType):
        return [parts[0].cast("long")]
    return [x for p in parts for x in (p.isNotNull().cast("long"), F.coalesce(p.cast("long"), F.lit(0)))]


def _contracted(edges: DataFrame, partitions: int) -> DataFrame:
    """Edges ``u > v`` that join in every partition what its edges join, ``v`` being the least."""
    kind = edges.schema["u"].dataType
    of_u, of_v = _fields("u", kind), _fields("v", kind)
    if of_u is None:
        return edges.distinct()
    width = len(of_u)
    names = [f"{c}{i}" for c in "uv" for i in range(width)]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = [b.to_numpy(np.int64) for b in batches if len(b)]
        if not seen:
            return
        pairs = np.concatenate(seen)
        ends = np.concatenate((pairs[:, :width], pairs[:, width:]))
        if width == 1:
            vertices, number = np.unique(ends, return_inverse=True)
            vertices, number = vertices[:, None], number.ravel()
        else:
            order = np.lexsort(ends.T[::-1])
            new = np.concatenate(([True], (ends[order][1:] != ends[order][:-1]).any(1)))
            number = np.empty(len(ends), np.int64)
            number[order] = np.cumsum(new) - 1
            vertices = ends[order][new]
        least = least_joined(len(vertices), number[: len(pairs)], number[len(pairs) :])
        at = np.flatnonzero(least != np.arange(len(least)))
        for i in range(0, len(at), 100_000):
            own = at[i : i + 100_000]
            yield pd.DataFrame(np.concatenate((vertices[own], vertices[least[own]]), 1), columns=names)

    flat = edges.select(*(x.alias(n) for x, n in zip([*of_u, *of_v], names, strict=True))).repartition(partitions)
    out = flat.mapInPandas(join, ", ".join(f"{n} long" for n in names))

    def vertex(c: str) -> Column:
        if not isinstance(kind, T.StructType):
            return F.col(f"{c}0").cast(kind).alias(c)
        own = [F.when(F.col(f"{c}{i}") == 1, F.col(f"{c}{i + 1}")) for i in range(0, width, 2)]
        return F.struct(*(x.cast(f.dataType).alias(f.name) for x, f in zip(own, kind.fields, strict=True))).alias(c)

    return out.select(vertex("u"), vertex("v"))


def forest(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` that join what ``edges(u, v)`` join, in every partition at most one less than its vertices."""
    edges = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), "forest-edges")
    out = keep(_contracted(edges, max(1, -(-edges.count() // PART))), "forest")
    drop(edges)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: link each vertex's larger neighbours to its least neighbour or itself.  Small: link its smaller ones and itself."""
    if large:
        seen = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = seen.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, max_steps: int | None = None) -> DataFrame:
    """``edges(u, v)`` of any sortable type -> ``(id, component)`` of every endpoint, the component being its least vertex.

    Nulls and self loops are ignored (a vertex that has only a self loop is its
    own component); repeated edges count once; no edges give no rows.  Steps go on
    until nothing changes; more than ``max_steps`` of them are an error.
    """
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    # the input is read once
    given = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "cc-edges")
    partitions = max(1, -(-given.count() // PART))
    state = keep(_contracted(given.filter("u <> v"), partitions), "cc")
    before, done = None, partitions == 1 and _fields("u", given.schema["u"].dataType) is not None
    for step in itertools.count():
        if done:
            break
        if step == max_steps:
            raise RuntimeError(f"components aren't closed after {max_steps} steps")
        new = keep(_star(_star(state, True), False), "cc")
        # a fixed point keeps the number of edges and the sum of their hashes
        mark = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast(T.DecimalType(38, 0)))).first()
        drop(state)
        state, done = new, mark == before
        before = mark
    # every other vertex now has one edge, to the least of its component
    out = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = out.unionAll(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    loops = given.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    if loops.isEmpty():
        drop(given)
        return out
    return out.unionAll(loops.join(out.select("id"), "id", "left_anti"))


def component_edges(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Components of ``edges(src, dst)``, inside equal ``keys`` if any: ``*keys, id, component``."""
    if not keys:
        return connected_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    tag = lambda c: F.struct(*(F.col(k) for k in keys), F.col(c).alias("vertex"))
    parts = connected_components(edges.select(tag("src").alias("u"), tag("dst").alias("v")))
    return parts.select(*(F.col(f"id.{k}").alias(k) for k in keys), F.col("id.vertex").alias("id"), F.col("component.vertex").alias("component"))


def partition_components(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Components of the edges between vertices of equal ``values(id, value)``; lone vertices are their own."""
    s, d = (values.select(F.col("id").alias(c), F.col("value").alias(f"v_{c}")) for c in ("src", "dst"))
    same = edges.join(s, "src").join(d, "dst").filter("v_src = v_dst")
    return values.join(component_edges(same), "id", "left").select("id", "value", F.coalesce("component", "id").alias("component"))
