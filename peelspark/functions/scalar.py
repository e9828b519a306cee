"""Scalar helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metanode_size(v: Column, e: Column) -> Column:
    """``max(ln(V + 1), ln(E + 1)) + 0.3``; 1 where neither is known."""
    return F.coalesce(F.greatest(F.ln(v + 1) + 0.3, F.ln(e + 1) + 0.3), F.lit(1.0))


def vlog(v: Column, e: Column) -> Column:
    return F.ln(e / v) / F.ln(v)


def scaled(x: Column, ratio: float, low: float, high: float) -> Column:
    return F.least(F.greatest(x * ratio, F.lit(low)), F.lit(high))


def part_name(layer: Column, lcc: Column) -> Column:
    return F.concat_ws("_", layer, lcc)


def parse_part(name: Column) -> Column:
    """``L_lcc`` as a struct."""
    at = F.split(name, "_")
    return F.struct(F.try_element_at(at, F.lit(1)).try_cast("long").alias("layer"), F.try_element_at(at, F.lit(2)).try_cast("long").alias("lcc"))
