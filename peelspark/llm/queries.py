"""The registered queries of the operators, ``opN_<name>``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, langid, line_dedup, ngram_join, packing, pii, token_count, tool_calls, toxicity
from ..store import table


#: Session setting with the secret key of the surrogates; the fallback is for the test tables, which are public.
PII_KEY = "spark.peelspark.pii.key"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = public_tokenizers.path
    return packing.pack(table(spark, sf_dir, "documents"), at("byte_bpe_50k.tiktoken"), at("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return rated.select("row.doc_id", toxicity.held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, "surrogates of the public test tables")
    out = pii.replace(table(spark, sf_dir, "documents"), key=key.encode())
    return out.select("row.doc_id", "n_entities", "kinds", F.col("text_out").alias("text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    none = F.array().cast("array<bigint>")
    out = docs.select("doc_id", decontamination.key_of("doc_id", "text").alias("doc")).join(found.drop("doc_id"), "doc", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), "cosine", "cover")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(table(spark, sf_dir, "conversations"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_token_counts": op8_token_counts,
    "op9_tool_calls": op9_tool_calls,
    "op10_ngram_join": op10_ngram_join,
}

#: SQL for DuckDB, where SQL can express a query over whole tables.
ORACLES: dict[str, str] = {
    "op1_line_dedup": """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
held AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM held),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
