"""Stages of the corpus pipeline: each maps documents to documents, the last to packed pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import keep, table, without
from . import decontamination, line_dedup, ngram_join, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rated toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that at least three documents hold, but for the largest ``doc_id``; ``n_chars`` follows."""
    out = line_dedup.dedup_lines(docs)
    changed = {"text": F.when(F.size("dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("dropped") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles and a similarity of 0.8 the smallest ``doc_id`` stays; rows without one come last."""
    lone = docs.filter("doc_id IS NULL")
    if not lone.isEmpty():
        lone = keep(lone.withColumn("_row", F.monotonically_increasing_id()), "no-id")
        after = (docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0) + 1
        docs = docs.filter("doc_id IS NOT NULL").withColumn("_row", F.col("doc_id").cast("long")).unionByName(lone.withColumn("_row", F.col("_row") + F.lit(after)))
    else:
        docs = docs.withColumn("_row", F.col("doc_id").cast("long"))
    groups = ngram_join.jaccard_components(docs, k=5, percent=80, doc_id="_row")
    return without(docs, groups.filter("doc_id <> component_id").withColumnRenamed("doc_id", "_row"), "_row").drop("_row")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs.withColumn("_doc", decontamination.key_of("doc_id", "text")), found.select(F.col("doc").alias("_doc")), "_doc").drop("_doc")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences."""
    at = public_tokenizers.path
    return packing.pack(docs, at("byte_bpe_50k.tiktoken"), at("byte_bpe_50k.json"), public_tokenizers.PATTERN)
