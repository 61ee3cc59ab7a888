"""Problem 3: codex payloads and claude records as flat tables with parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.nested import flatten
from skein.session import table


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    claude = table(spark, sf_dir, "claude_records").select(F.lit("claude").alias("runtime"), "rec_id", "record")
    codex = table(spark, sf_dir, "codex_records").select(F.lit("codex").alias("runtime"), "rec_id", F.col("payload").alias("record"))
    return claude.unionByName(codex)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(nested_records(spark, sf_dir), "files").select("runtime", "rec_id", "block_no", "json_path")


def _of(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten(nested_records(spark, sf_dir), name)

    return query


QUERIES = {"p3_found": p3_found} | {f"p3_{n}": _of(n) for n in ("records", "blocks", "calls", "files")}
_FILES = r"""
WITH RECURSIVE b AS (
  SELECT rec_id, i AS block_no, json_extract(record, '$.message.content[' || i || ']') AS b FROM (
    SELECT rec_id, record, unnest(range(json_array_length(record, '$.message.content')::BIGINT)) AS i
    FROM claude_records WHERE json_valid(record) AND json_type(record, '$.message.content') = 'ARRAY')),
raw AS (
  SELECT 'claude' AS runtime, rec_id, block_no, json_extract(b, '$.input') AS j FROM b WHERE json_type(b, '$.type') = 'VARCHAR' AND (b ->> '$.type') = 'tool_use'
  UNION ALL
  SELECT 'codex', rec_id, 0, json_extract(payload, '$.arguments') FROM codex_records WHERE json_valid(payload) AND (payload ->> '$.type') = 'function_call'),
docs AS (
  SELECT runtime, rec_id, block_no, '$' AS prefix, CASE json_type(j) WHEN 'VARCHAR' THEN CASE WHEN runtime = 'codex' AND json_valid(j ->> '$') THEN (j ->> '$')::JSON END ELSE j END AS j FROM raw
  UNION ALL
  SELECT runtime, rec_id, block_no, prefix || substr(fullkey, 2), (atom ->> '$')::JSON FROM (
    SELECT d.runtime, d.rec_id, d.block_no, d.prefix, t.fullkey, t.atom FROM docs d, json_tree(d.j) t
    WHERE t.key = 'arguments' AND t.type = 'VARCHAR' AND json_valid(t.atom ->> '$') AND ltrim(t.atom ->> '$', E' \t\r\n')[1] = '{'))
SELECT d.runtime, d.rec_id, d.block_no, d.prefix || substr(t.fullkey, 2) AS json_path, t.atom ->> '$' AS file_path
FROM docs d, json_tree(d.j) t WHERE t.key = 'file_path' AND t.type = 'VARCHAR' AND (t.atom ->> '$') <> ''
"""
SQL = {"p3_files": _FILES, "p3_found": f"SELECT runtime, rec_id, block_no, json_path FROM ({_FILES})"}
