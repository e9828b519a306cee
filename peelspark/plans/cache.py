"""Warming the tables of the buildings that are asked for most."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_sum

#: Part of the cache that is warmed.
FILL = 0.75


def best_buildings(buildings: DataFrame, size: str, order: list, capacity: int) -> DataFrame:
    """The first buildings in ``order`` whose sizes together stay within ``FILL`` of the capacity."""
    return running_sum(buildings, size, order, "_sum").filter(F.col("_sum") <= FILL * capacity).drop("_sum")


def warm(edges: DataFrame, best: DataFrame, on: list[str]) -> DataFrame:
    """The edges of the chosen buildings, held in memory and on disk."""
    held = edges.join(best.select(*on), on, "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    return held


def cached(best: DataFrame, building: dict[str, int]) -> bool:
    """Whether a building is among the warmed ones."""
    for c, x in building.items():
        best = best.filter(F.col(c) == x)
    return not best.isEmpty()
