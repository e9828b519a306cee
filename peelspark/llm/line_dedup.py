"""Line dedup over levelled sorted runs of line hashes.

The index holds runs: tables of (128-bit key hash, documents that hold the key,
``last``), hash-bucketed and sorted, unique by key.  Documents come in batches of
descending ids: one for up to ``BATCH`` documents, and one more each time they
double, so that a batch is a share of the input and jobs stay few.  A batch's
keys are counted and merge-anti-joined with every run (bucketed alike, so neither
side is dealt again).  A key that no run holds is fresh: the largest ``doc_id``
with it in this batch is the largest of all, and is stored as ``last``; a key seen
before adds to the count alone.  The batch becomes a run of level 0, and two runs
of one level are merged into one of the next, so that ``n`` batches leave about
``log2 n`` runs and each key is rewritten as often.

A document's decision needs the totals of its keys, so after the last batch the
runs are merged into one, its keys with enough documents are joined back to the
lines, and every document but ``last`` gets the positions it loses.  Texts are
split once; batches and the join back read the table of line hashes.

Everything is DataFrame functions.  The hot key of a line that a third of all
documents hold is summed before the shuffle and, joined back, is a skewed join
that adaptive execution splits.

Defined results: a null or empty text is one empty line; documents are told
apart by ``doc_id`` and rows that share one count as one document, all of them
with the largest one keep their lines; rows without a ``doc_id`` are told apart by
their text and are smaller than any other; ids that aren't numbers make one
batch; an empty table gives an empty result; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import BROADCAST, delete, drop, keep, new_path, sized

#: Documents that make one batch.
BATCH = 16_384
SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """The index: ``levels[i]`` holds the runs of level i, at most one after ``add`` returns."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels, self.paths = spark, [], {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merge(self, one: str, two: str) -> str:
        a, b = (self.spark.table(x) for x in (one, two))
        both = a.join(b.select("h1", "h2", *(F.col(c).alias(f"{c}_2") for c in ("docs", "last"))), ["h1", "h2"], "full")
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("docs_2", F.lit(0))
        name = self.write(both.select("h1", "h2", docs.alias("docs"), F.coalesce("last", "last_2").alias("last")))
        for old in (one, two):
            self.drop(old)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.paths.pop(name))

    def add(self, keys: DataFrame) -> None:
        """``keys``: a row (h1, h2, doc, ...) for each key of each document of a new batch, whose ids are below all before."""
        new = keys.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
        fresh = F.lit(True)
        for i, run in enumerate(self.runs()):
            new = new.join(run.select("h1", "h2", F.lit(True).alias(f"seen_{i}")), ["h1", "h2"], "left")
            fresh = fresh & F.col(f"seen_{i}").isNull()
        name, level = self.write(new.select("h1", "h2", "docs", F.when(fresh, F.col("last")).alias("last"))), 0
        while level < len(self.levels) and self.levels[level]:
            name = self.merge(self.levels[level].pop(), name)
            level += 1
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def total(self) -> DataFrame:
        """All runs merged into one."""
        names = [x for level in self.levels for x in level]
        while len(names) > 1:
            names = [self.merge(names[0], names[1]), *names[2:]]
        self.levels = [names]
        return self.spark.table(names[0])


def cuts(ids: DataFrame, column: str, batches: int) -> list[float]:
    """Ascending ids that cut the rows into about equal batches."""
    if batches == 1 or not isinstance(ids.schema[column].dataType, T.NumericType):
        return []
    return sorted(set(ids.approxQuantile(column, [i / batches for i in range(1, batches)], 0.01)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_chars: int = 20, batches: int | None = None) -> DataFrame:
    """The rows of ``docs`` as ``row``, with ``lines`` (all), ``dropped`` (their positions, ascending) and ``kept`` (the text left)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.col(f"row.`{doc_id}`").alias("doc"), F.col(f"row.`{text}`").alias("body"))
    if batches is None:
        batches = max(0, -(-docs.count() // BATCH) - 1).bit_length() + 1
    below = cuts(rows.select("doc"), "doc", batches)
    batch = sum(((F.col("doc") <= x).cast("int") for x in below), F.lit(0))
    # a row's body is part of its identity: rows that share a doc_id lose what their own text holds
    lines = rows.select("doc", F.xxhash64("body").alias("body_hash"), F.posexplode(lines_of(F.col("body"))).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.filter(F.char_length("key") >= min_chars).select(F.coalesce(batch, F.lit(len(below))).alias("batch"), "doc", "body_hash", "pos", *hashed(F.col("key")))
    lines = keep(lines, "line-hashes")
    index = LineRuns(docs.sparkSession)
    lone = F.when(F.col("doc").isNull(), F.col("body_hash")).alias("lone")
    for b in range(len(below) + 1):
        index.add(lines.filter(F.col("batch") == b).select("h1", "h2", "doc", lone))
    repeated = keep(index.total().filter(F.col("docs") >= min_docs).select("h1", "h2", "last"), "repeated-lines")
    index.drop(index.levels[0][0])
    lost = lines.join(sized(repeated, 40), ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("last")))
    lost = keep(lost.groupBy("doc", "body_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "lost-lines")
    drop(lines, repeated)
    if (lost.agg(F.sum(F.size("dropped") * 4 + 80)).first()[0] or 0) <= BROADCAST:
        lost = F.broadcast(lost)
    named = lost.withColumnsRenamed({"doc": "doc_2", "body_hash": "hash_2"})
    same = F.col("doc").eqNullSafe(F.col("doc_2")) & (F.xxhash64("body") == F.col("hash_2"))
    out = rows.join(named, same, "left")
    none = F.array().cast("array<int>")
    out = out.select("row", lines_of(F.col("body")).alias("lines"), F.coalesce("dropped", none).alias("dropped"))
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("dropped", lambda p: p + 1)).alias("a"), F.concat("dropped", F.array(F.size("lines"))).alias("b"))
    runs = F.transform(bounds, lambda z: F.slice("lines", z["a"] + 1, z["b"] - z["a"]))
    return out.withColumn("kept", F.array_join(F.flatten(runs), "\n"))
