"""Problem 1: message texts of codex and claude in pieces under the chunk limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.split_text import split_texts
from skein.session import allow_duplicate_keys, json_kind, parse_line, table


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(runtime, rec_id, block_no, text) of the texts of claude `message.content` and codex message `payload.content`."""
    allow_duplicate_keys(spark)
    claude = table(spark, sf_dir, "claude_records").select(F.lit("claude").alias("runtime"), "rec_id", parse_line(F.col("record")).alias("v"))
    claude = claude.select("runtime", "rec_id", F.try_variant_get("v", "$.message.content", "variant").alias("content"))
    codex = table(spark, sf_dir, "codex_records").select(F.lit("codex").alias("runtime"), "rec_id", parse_line(F.col("payload")).alias("v"))
    codex = codex.where(F.try_variant_get("v", "$.type", "string") == "message")
    codex = codex.select("runtime", "rec_id", F.try_variant_get("v", "$.content", "variant").alias("content"))
    rows = claude.unionByName(codex)
    listed = F.transform(F.try_variant_get("content", "$", "array<variant>"), lambda b: _string(F.try_variant_get(b, "$.text", "variant")))
    texts = F.when(json_kind(F.col("content")) == "array", listed).otherwise(F.array(_string(F.col("content"))))
    return rows.select("runtime", "rec_id", F.posexplode(texts).alias("block_no", "text")).where(F.col("text").isNotNull()).withColumn("block_no", F.col("block_no").cast("bigint"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(message_texts(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that had to be cut: the first of several pieces."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("runtime", "rec_id", "block_no")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": r"""
WITH c AS (
  SELECT 'claude' AS runtime, rec_id, json_extract(record, '$.message.content') AS content FROM claude_records WHERE json_valid(record)
  UNION ALL
  SELECT 'codex', rec_id, json_extract(payload, '$.content') FROM codex_records WHERE json_valid(payload) AND (payload ->> '$.type') = 'message'),
t AS (
  SELECT runtime, rec_id, 0::BIGINT AS block_no, content ->> '$' AS txt FROM c WHERE json_type(content) = 'VARCHAR'
  UNION ALL
  SELECT runtime, rec_id, i, json_extract_string(content, '$[' || i || '].text')
  FROM (SELECT *, unnest(range(json_array_length(content)::BIGINT)) AS i FROM c WHERE json_type(content) = 'ARRAY')
  WHERE json_type(content, '$[' || i || '].text') = 'VARCHAR')
SELECT runtime, rec_id, block_no FROM t WHERE length(trim(txt, E' \t\r\n')) > 1600
"""
}
