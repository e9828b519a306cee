"""Numbers behind the drawings: floors, colours, spirals, neighbours in the plane."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frusta(waves: DataFrame) -> DataFrame:
    """Floor by floor height, radii and running height of ``waves(lcc, wave, s, t, ie, ee)``."""
    r, big = F.log2(F.col("s") + 1), F.log2(F.col("t") + 1)
    volume = F.log2(F.col("ie") + F.col("ee") + 1)
    base = math.pi * (big * big + big * r + r * r)
    out = waves.withColumns({"r": r, "big_r": big, "volume": volume, "height": F.when(base > 0, 3 * volume / base).otherwise(0.0)})
    return out.withColumn("top", F.sum("height").over(Window.partitionBy("lcc").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0)))


def floor_densities(waves: DataFrame) -> DataFrame:
    """Densities of the ground, inside, ceiling and towards the next wave."""
    later = F.lead("ss").over(Window.partitionBy("lcc").orderBy("wave"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    v = F.col("s") + F.col("t")
    return waves.withColumn("later", later).select(
        "lcc", "wave",
        ratio(2.0 * F.col("ie"), F.col("s") * (F.col("s") - 1)).alias("ground"),
        ratio(2.0 * F.col("ie") + F.col("ee"), F.col("s") * v).alias("inner"),
        ratio(1.0 * F.col("ee"), F.col("s") * F.col("t")).alias("ceiling"),
        ratio(1.0 * F.col("e_next"), F.col("s") * F.col("later")).alias("next"),
    )


def color_factor(floors: DataFrame) -> DataFrame:
    """``(d / (d - 1))^2`` of the mean density d of a building's floors."""
    m = floors.groupBy("lcc").agg(F.avg("density").alias("d"))
    return m.select("lcc", F.when(F.col("d") != 1, F.pow(F.col("d") / (F.col("d") - 1), 2.0)).alias("factor"))


def speedometer(floors: DataFrame, buildings: DataFrame) -> DataFrame:
    """``building, wave, opens, closes``: the arc of each floor on the building's dial, one after the other.

    ``floors(building, wave, source, vertices, edges)`` and ``buildings(building,
    mean_degree, layer)``.  A floor is as wide as the arc sine of its log edges per
    log vertices and log sources, relative to the widest floor; all dials are scaled
    alike, so that the fullest takes seven eighths of a circle.  A dial begins at
    ``mean_degree / layer - 1`` half circles.
    """
    ratio = F.log(F.col("edges") + 1) / F.nullif(F.log(F.col("vertices") + 1) * F.log(F.col("source") + 1), F.lit(0.0))
    ratios = floors.select("building", "wave", F.coalesce(ratio, F.lit(0.0)).alias("ratio"))
    widest = ratios.agg(F.nullif(F.max("ratio"), F.lit(0.0)).alias("widest"))
    shares = ratios.crossJoin(F.broadcast(widest)).select("building", "wave", F.asin(F.coalesce(F.col("ratio") / F.col("widest"), F.lit(0.0))).alias("share"))
    fullest = shares.groupBy("building").agg(F.sum("share").alias("s")).agg(F.nullif(F.max("s"), F.lit(0.0)).alias("fullest"))
    width = F.coalesce(F.col("share") * (math.pi * 7 / 4) / F.col("fullest"), F.lit(0.0))
    wide = shares.crossJoin(F.broadcast(fullest)).withColumn("width", width).join(buildings, "building")
    closes = (F.col("mean_degree") / F.col("layer") - 1) * math.pi + F.sum("width").over(Window.partitionBy("building").orderBy("wave").rowsBetween(Window.unboundedPreceding, 0))
    return wide.select("building", "wave", (closes - F.col("width")).alias("opens"), closes.alias("closes"))


def bush(waves: DataFrame) -> DataFrame:
    """Branch length, width and the height below it, by wave."""
    out = waves.withColumns({"length": F.log2(F.col("ie") + F.col("ee") + 1), "width": F.sqrt(F.log2(F.col("s") + 1)), "branches": F.ceil(F.log2(F.col("t") + 1)).cast("long")})
    run = Window.partitionBy("lcc").orderBy("wave").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("below", F.coalesce(F.sum("length").over(run), F.lit(0.0)))


def spiral(buildings: DataFrame) -> DataFrame:
    """Places of each spiral's buildings, the largest innermost: radius and angle follow one another; a spiral is at most a few hundred rows."""

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["e", "building"], ascending=[False, True], ignore_index=True)
        rad = np.sqrt(np.log2(g["v"].to_numpy(float) + 1))
        theta, dist, x, y = 0.0, 0.0, [], []
        for i, r in enumerate(rad):
            if i:
                dist += (rad[i - 1] + r) / (2 * math.pi)
                dist = max(dist, rad[0] + r)
                theta += 2 * math.asin(min(1.0, (rad[i - 1] + r) / (2 * dist)))
            x.append(dist * math.cos(theta))
            y.append(dist * math.sin(theta))
        return g[["spiral", "building"]].assign(x=x, y=y, rad=rad)

    return buildings.groupBy("spiral").applyInPandas(place, "spiral long, building long, x double, y double, rad double")


def _triangles(p: np.ndarray) -> set[tuple[int, int]]:
    """Edges of the Delaunay triangulation (points added one by one)."""
    span = float(np.ptp(p, axis=0).max()) or 1.0
    mid = p.mean(0)
    far = np.vstack((p, mid + [-30 * span, -10 * span], mid + [30 * span, -10 * span], mid + [0, 30 * span]))
    n = len(p)
    tri = {(n, n + 1, n + 2)}

    def inside(t: tuple[int, int, int], q: np.ndarray) -> bool:
        a, b, c = (far[i] - q for i in t)
        m = np.array([[*a, a @ a], [*b, b @ b], [*c, c @ c]])
        ab, ac = far[t[1]] - far[t[0]], far[t[2]] - far[t[0]]
        return np.linalg.det(m) * np.sign(ab[0] * ac[1] - ab[1] * ac[0]) > 1e-12

    for i in range(n):
        bad = [t for t in tri if inside(t, far[i])]
        sides: dict[tuple[int, int], int] = {}
        for a, b, c in bad:
            for s in ((a, b), (b, c), (a, c)):
                sides[tuple(sorted(s))] = sides.get(tuple(sorted(s)), 0) + 1
        tri -= set(bad)
        tri |= {(*s, i) for s, k in sides.items() if k == 1}
    return {tuple(sorted(s)) for a, b, c in tri for s in ((a, b), (b, c), (a, c)) if max(s) < n}


def plane_neighbors(positions: DataFrame) -> DataFrame:
    """Pairs whose Voronoi cells touch, per city ``positions(city, id, x, y)``; all pairs below four points.  A city is a few hundred points."""

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        p, ids = g[["x", "y"]].to_numpy(float), g["id"].to_numpy()
        found = _triangles(p) if len(p) >= 4 else {(i, j) for i in range(len(p)) for j in range(i + 1, len(p))}
        return pd.DataFrame({"city": g["city"].iloc[0], "a": [ids[i] for i, _ in sorted(found)], "b": [ids[j] for _, j in sorted(found)]})

    return positions.groupBy("city").applyInPandas(pairs, "city long, a long, b long")


def road_weights(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    a, b = positions.toDF("a", "xa", "ya"), positions.toDF("b", "xb", "yb")
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("weight"))


def broken_axis(peels: DataFrame) -> DataFrame:
    """Place of each peel value: running ``1 + log10(1 + log10(gap))``."""
    w = Window.orderBy("peel")
    gap = F.col("peel") - F.coalesce(F.lag("peel").over(w), F.col("peel") - 1)
    return peels.withColumn("x", F.sum(1 + F.log10(1 + F.log10(gap))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def floor_metrics(floors: DataFrame) -> DataFrame:
    return floors.groupBy("lcc").agg(F.max("top").alias("height"), F.count("*").alias("floors"), F.sum(F.col("ie") + F.col("ee")).alias("edges"))
