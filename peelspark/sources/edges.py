"""Readers of edge lists, vertex files, labels, sets and nested files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pairs(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``value, src, dst`` of the lines of an edge list; nulls where there is no integer."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    cells = lines.select("value", F.split("value", re.escape(sep), 3).alias("c"))
    cell = lambda i: F.trim(F.try_element_at("c", F.lit(i))).try_cast("long")
    return cells.select("value", cell(1).alias("src"), cell(2).alias("dst"))


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", bad: str = "fail") -> DataFrame:
    """Header-free integer pairs; further columns are ignored, lines that begin with # and empty lines are left out.

    Any other line without two integers ends the query, or with ``bad="drop"`` is
    left out as well; ``bad_edge_lines`` shows those.
    """
    pairs, right = _pairs(spark, path, sep), F.col("src").isNotNull() & F.col("dst").isNotNull()
    if bad == "drop":
        return pairs.filter(right).select("src", "dst")
    wrong = F.raise_error(F.concat(F.lit("not an edge: "), F.substring("value", 1, 100))).cast("long")
    return pairs.select(F.when(right, F.col("src")).otherwise(wrong).alias("src"), F.when(right, F.col("dst")).otherwise(wrong).alias("dst"))


def bad_edge_lines(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """The lines that ``read_edge_list`` can't read."""
    return _pairs(spark, path, sep).filter("src IS NULL OR dst IS NULL").select("value")


def read_edges(spark: SparkSession, path: str, properties: dict[str, str] | None = None, filters: str | None = None) -> DataFrame:
    """Text edges with a found separator (comma, tab, space), an optional header and optional parentheses.

    A header names the ends ``source`` and ``target`` in any case; without one
    they are the first two columns.  ``properties`` maps further header columns
    to types; ``filters`` is a SQL predicate over all columns kept.
    """
    text = spark.read.text(path).select(F.trim(F.regexp_replace(F.trim("value"), r"^\(|\)$", "")).alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    first = text.first()
    if first is None:
        return spark.createDataFrame([], "src string, dst string")
    sep = next((s for s in (",", "\t") if s in first["line"]), " ")
    head = [h.strip().strip('"') for h in first["line"].split(sep)]
    lower = [h.lower() for h in head]
    named = "source" in lower and "target" in lower
    cells = text.select(F.split("line", r"\s+" if sep == " " else sep).alias("c"))
    if named:
        cells = cells.filter(F.lower(F.trim(F.try_element_at("c", F.lit(1)))) != lower[0])
    at = {"src": lower.index("source") if named else 0, "dst": lower.index("target") if named else 1}
    cell = lambda i: F.trim(F.try_element_at("c", F.lit(i + 1)))
    out = cells.select(*(cell(i).alias(n) for n, i in at.items()), *(cell(lower.index(p.lower())).try_cast(t).alias(p) for p, t in (properties or {}).items()))
    return out.filter(filters) if filters else out


def read_vertices(spark: SparkSession, path: str, properties: dict[str, str], filters: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Vertex file with typed property columns; with ``known`` other vertices are left out."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(F.col(raw.columns[0]).alias("id"), *(F.col(p).try_cast(t).alias(p) for p, t in properties.items()))
    out = out.filter(filters) if filters else out
    return out.join(known.select(F.col("id").cast("string")), "id", "left_semi") if known is not None else out


def property_from_sets(sets: DataFrame) -> DataFrame:
    """``sets`` is a map column value -> ids: ``id, value``, the largest value if several hold an id."""
    return sets.select(F.explode("sets").alias("value", "ids")).select(F.explode("ids").alias("id"), "value").groupBy("id").agg(F.max("value").alias("value"))


def read_labels(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    return spark.read.csv(path, schema="id LONG, label STRING", header=header, quote='"', escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: str, documents: bool = False) -> DataFrame:
    """Objects a line, or with ``documents`` a file that is one object or array."""
    return spark.read.schema(schema).json(path, multiLine=documents)


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 1) -> DataFrame:
    """Each pair with chance ``p``, drawn from the seed.

    The pairs, numbered row by row, are cut into blocks; inside a block the gaps
    between chosen pairs are drawn, so that work follows the edges and not the pairs.
    """
    total = n * (n - 1) // 2
    if total <= 0 or p <= 0:
        return spark.createDataFrame([], "src long, dst long")
    block = max(1, int(min(total, 100_000 / min(1.0, p))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b["id"]:
                rng, first = np.random.default_rng([seed, int(k)]), int(k) * block
                size, at = min(block, total - first), -1
                chosen = []
                while at < size:
                    steps = at + np.cumsum(rng.geometric(min(1.0, p), 65_536))
                    chosen.append(steps[steps < size])
                    at = int(steps[-1])
                t = first + np.concatenate(chosen)
                # the row of a pair's number, mended where the root is not exact
                i = np.floor((2 * n - 1 - np.sqrt((2.0 * n - 1) ** 2 - 8.0 * t)) / 2).astype(np.int64)
                before = lambda i: i * (2 * n - i - 1) // 2
                i = np.where(before(i) > t, i - 1, i)
                i = np.where(before(i + 1) <= t, i + 1, i)
                yield pd.DataFrame({"src": i, "dst": t - before(i) + i + 1})

    return spark.range(-(-total // block)).mapInPandas(draw, "src long, dst long")


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets of a folder: one per name, of its files the one of the first ending among tsv, csv, txt."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath().getName() for s in fs.listStatus(at)]
    rank = {"tsv": 0, "csv": 1, "txt": 2}
    rows = [(f.rpartition(".")[0], f.rpartition(".")[2], rank[f.rpartition(".")[2]]) for f in files if f.rpartition(".")[2] in rank]
    df = spark.createDataFrame(rows, "name string, kind string, rank int")
    return df.groupBy("name").agg(F.min_by("kind", "rank").alias("kind"))


def to_array(df: DataFrame, value: str, predicate: str | None = None) -> DataFrame:
    """``value`` (an expression) of each row that the predicate keeps."""
    return (df.filter(predicate) if predicate else df).select(F.expr(value).alias("value"))


def to_map(df: DataFrame, key: str, value: str, order: list[str], predicate: str | None = None) -> DataFrame:
    """``key, value``: of rows with equal keys the last one in ``order`` counts."""
    kept = df.filter(predicate) if predicate else df
    return kept.groupBy(F.expr(key).alias("key")).agg(F.max_by(F.expr(value), F.struct(*order)).alias("value"))


def to_both(df: DataFrame, key: str, value: str, size: str, predicate: str | None = None) -> DataFrame:
    """``key, values, size``: all values of a key (ascending) and the sum of their sizes."""
    kept = df.filter(predicate) if predicate else df
    return kept.groupBy(F.expr(key).alias("key")).agg(F.array_sort(F.collect_list(F.expr(value))).alias("values"), F.sum(F.expr(size)).alias("size"))


def to_multimap(df: DataFrame, keys: list[str], value: str, predicate: str | None = None) -> DataFrame:
    """Rows under each of several keys: ``key, values`` (ascending)."""
    kept = df.filter(predicate) if predicate else df
    return kept.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), F.col(value).alias("v")).groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("values"))
