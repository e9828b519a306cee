"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors with equal components are one class.  The values of ``WINDOWS`` random
projections are sorted one after the other, every vector's window of half width
``width`` around its own value is found in the sorted order, and the windows that
each pair shares are counted.  Pairs with the count that a pair at the threshold
reaches with probability ``RECALL`` are verified by their cosine in double
precision.

A window that a pair at 0.9 seldom leaves holds a quarter of all vectors,
whatever their number, so counting over a whole table is quadratic.  Classes are
therefore routed first, by the sides they take of the origin on ``bits`` further
projections, ``tables`` times over.  ``bits`` follows the number of vectors, so
that buckets stay small, and ``tables`` follows ``bits``, so that a pair at the
threshold meets in a bucket with probability ``RECALL``: both chances are
computed, not tuned to data.  A bucket of more than ``CHUNK`` vectors is cut into
chunks and every two chunks are compared apart, so that no task holds a bucket
and no pair is lost.

A pair counts in the first table where it meets.  A bucket returns no pairs but,
for each class, how many vectors it is linked to, and a forest that joins what is
linked, so that a group of near copies costs rows in proportion to its size.

Null vectors, zero vectors and those with null or non-finite components link
with nothing, whatever other rows their id has.  Vectors of different lengths
never link.  Rows that share a ``vec_id`` are one vertex, and ``n_links`` counts
distinct other ids.  Rows without a ``vec_id`` link with nothing, have no
component and are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..store import drop, keep, sized

COSINE = 0.9
RECALL = 0.97
WINDOWS = 32
BUCKET, CHUNK = 256, 1_024


@lru_cache(maxsize=8)
def projections(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def meeting(cosine: float, bits: int) -> int:
    """Tables in which a pair at ``cosine`` shares a bucket at least once with probability RECALL."""
    alike = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - alike)))


def least_count(cosine: float, width: float) -> int:
    """The count of shared windows that a pair at ``cosine`` reaches with probability RECALL."""
    p = math.erf(width / math.sqrt(2 - 2 * cosine) / math.sqrt(2))
    total = 0.0
    for c in range(WINDOWS + 1):
        total += math.comb(WINDOWS, c) * p**c * (1 - p) ** (WINDOWS - c)
        if total > 1 - RECALL:
            return c
    return WINDOWS


def collisions(x: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """How many projections put ``y[j]`` into the window around ``x[i]``, a row for each i."""
    out = np.zeros((len(x), len(y)), np.int16)
    for p in range(x.shape[1]):
        order = np.argsort(y[:, p], kind="stable")
        line = y[order, p]
        low, high = np.searchsorted(line, x[:, p] - width, "left"), np.searchsorted(line, x[:, p] + width, "right")
        # the window's ends as steps up and down along the sorted line
        steps = np.zeros((len(x), len(y) + 1), np.int16)
        at = np.arange(len(x))
        np.add.at(steps, (at, low), 1)
        np.add.at(steps, (at, high), -1)
        out[:, order] += np.cumsum(steps[:, :-1], axis=1, dtype=np.int16)
    return out


def sides(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket number of each vector in each table; einsum, as its sums don't depend on the other rows."""
    if not bits:
        return np.zeros((len(v), tables), np.int64)
    side = np.einsum("ij,jk->ik", v, projections(v.shape[1], bits * tables, 1)) > 0
    return side.reshape(len(v), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number joined with each of ``n`` by the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def linked(classes: DataFrame, bits: int, tables: int, cosine: float) -> DataFrame:
    """What the links between ``classes(cid, singles, marked, embedding)`` give: ``kind, a, b, w``.

    Kind 0: class ``a`` is linked to classes of ``w`` single ids.  Kind 1: an edge of
    a forest of the links.  Kind 2: ``a`` is linked to the marked class ``b``.
    """
    width = math.sqrt(2 - 2 * cosine)
    least = least_count(cosine, width)
    floats = np.dtype("<f4" if "float" in classes.schema["embedding"].dataType.simpleString() else "<f8")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, g in b.groupby(b["embedding"].map(len)):
                v = np.stack(g["embedding"].to_list()).astype(floats)
                code = sides(v.astype(np.float64), bits, tables)
                raw = np.repeat(np.array([x.tobytes() for x in v], object), tables)
                yield pd.DataFrame({"size": size, "t": np.tile(np.arange(tables), len(v)), "code": code.ravel(), "v": raw} | {c: np.repeat(g[c].to_numpy(), tables) for c in ("cid", "singles", "marked")})

    bucket = ["size", "t", "code"]
    routed = keep(classes.mapInPandas(route, "size int, t int, code long, cid long, singles long, marked boolean, v binary"), "routed")
    chunks = routed.groupBy(*bucket).count().select(*bucket, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    dealt = routed.join(chunks, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"c1": F.least("own", "other"), "c2": F.greatest("own", "other")})

    def search(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        table, same = int(key[1]), key[3] == key[4]
        raw = np.frombuffer(b"".join(g["v"]), floats).reshape(len(g), -1).astype(np.float64)
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        lines = unit @ projections(raw.shape[1], WINDOWS, 2)
        first = np.flatnonzero((g["own"] == key[3]).to_numpy())
        second = first if same else np.flatnonzero((g["own"] == key[4]).to_numpy())
        found = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(first), 256):
            p, q = np.nonzero(collisions(lines[first[at : at + 256]], lines[second], width) >= least)
            p, q = first[p + at], second[q]
            if same:
                p, q = p[p < q], q[p < q]
            near = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
            found.append(np.stack((p[near], q[near]), 1))
        i, j = np.concatenate(found).T
        if table and len(i):  # what met in an earlier table has been counted there
            held, at = np.unique(np.concatenate((i, j)), return_inverse=True)
            code = sides(raw[held], bits, tables)[:, :table]
            new = ~(code[at[: len(i)]] == code[at[len(i) :]]).any(1)
            i, j = i[new], j[new]
        ids, singles, marked = (g[c].to_numpy() for c in ("cid", "singles", "marked"))
        sums = np.zeros(len(g), np.int64)
        np.add.at(sums, i, singles[j])
        np.add.at(sums, j, singles[i])
        root = forest(len(g), i, j)
        joined, counted = np.flatnonzero(root != np.arange(len(g))), np.flatnonzero(sums)
        a, b = np.concatenate((i, j)), np.concatenate((j, i))
        a, b = a[marked[b]], b[marked[b]]
        out = [(0, ids[counted], ids[counted], sums[counted]), (1, ids[joined], ids[root[joined]], 0), (2, ids[a], ids[b], 0)]
        return pd.concat([pd.DataFrame({"kind": k, "a": x, "b": y, "w": w}) for k, x, y, w in out if len(x)] or [pd.DataFrame({"kind": [], "a": [], "b": [], "w": []}, dtype=np.int64)])

    found = dealt.select(*bucket, "c1", "c2", "own", "cid", "singles", "marked", "v").groupBy(*bucket, "c1", "c2").applyInPandas(search, "kind int, a long, b long, w long")
    out = keep(found, "vector-links")
    drop(routed)
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = finite & F.exists("embedding", lambda x: x != 0)
    number = F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))
    v = v.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", number), 256)))
    v = keep(v.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    ids = v.filter("class IS NOT NULL AND vec_id IS NOT NULL").select("class", "vec_id").distinct()
    # ids with vectors of several classes
    several = keep(ids.groupBy("vec_id").count().filter("count > 1").select("vec_id", F.lit(1).alias("several")), "ids-of-several")
    ids = ids.join(sized(several, 32), "vec_id", "left").fillna(0, ["several"])
    sizes = ids.groupBy("class").agg(F.sum(1 - F.col("several")).alias("singles"), (F.max("several") > 0).alias("marked"), F.min("vec_id").alias("least"))
    first = v.filter("vec_id IS NOT NULL").groupBy("class").agg(F.min("rid").alias("rid"))
    classes = keep(sizes.join(first, "class").withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    bits = max(0, min(40, math.ceil(math.log2(max(1, classes.count()) / BUCKET))))
    found = linked(v.select("rid", "embedding").join(sized(classes.select("rid", "cid", "singles", "marked"), 64), "rid").drop("rid"), bits, meeting(cosine, bits), cosine)

    edges = found.filter("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("w").alias("links"))
    repeated = None
    if not several.isEmpty():
        own = keep(ids.filter("several = 1").join(classes.select("class", "cid"), "class").select("vec_id", "cid"), "classes-of-several")
        edges = edges.unionByName(own.join(own.groupBy("vec_id").agg(F.min("cid").alias("u")), "vec_id").select("u", F.col("cid").alias("v")))
        to = keep(found.filter("kind = 2").select("a", F.col("b").alias("cid")).unionByName(own.select(F.col("cid").alias("a"), "cid")).distinct(), "marked-links")
        # the ids of several classes among the neighbours of a class, and all neighbours of such an id
        met = to.join(own, "cid").select(F.col("a").alias("cid"), "vec_id").distinct().groupBy("cid").agg(F.count("*").alias("met"))
        links = links.join(met, "cid", "full").select("cid", (F.coalesce("links", F.lit(0)) + F.coalesce("met", F.lit(0))).alias("links"))
        near = own.join(to, "cid").select("vec_id", F.col("a").alias("cid")).distinct()
        one = near.join(classes.select("cid", "singles"), "cid").groupBy("vec_id").agg(F.sum("singles").alias("n_single"))
        more = near.join(own.withColumnRenamed("vec_id", "other"), "cid").select("vec_id", "other").distinct().groupBy("vec_id").agg(F.count("*").alias("n_several"))
        repeated = one.join(more, "vec_id").select("vec_id", (F.col("n_single") + F.col("n_several") - 1).alias("n_repeated"))

    parts = keep(connected_components(edges).select(F.col("id").alias("cid"), "component"), "vector-parts")
    placed = classes.join(parts, "cid", "left").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = placed.join(least, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("singles") - 1).alias("n_links"), "component_id")
    out = v.select("vec_id", "class").join(of_class, "class", "left").withColumn("sound", F.col("class").isNotNull() & F.col("vec_id").isNotNull())
    n_links = F.col("n_links")
    if repeated is not None:
        out = out.join(repeated, "vec_id", "left")
        n_links = F.coalesce("n_repeated", n_links)
    out = out.select("vec_id", F.when(F.col("sound"), n_links).otherwise(0).cast("long").alias("n_links"), F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
