"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peelspark.llm import stages
from peelspark.store import drop, keep, scratch, table

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_join", stages.drop_similar),
    ("decontamination", stages.drop_leaks),
    ("packing", stages.pack),
]

#: SQL cannot express the trained, tokenizing and retrieval stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass every stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        read = docs
        with scratch(spark) as stay:  # what a stage keeps besides its result goes when that is written
            docs = keep(stage(spark, read, sf_dir), f"stage-{name}")
            stay.append(docs)
        if name != STAGES[0][0]:
            drop(read)
    return docs
