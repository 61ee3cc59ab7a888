"""Problem 6: claude, codex and pi records in one table, with each file's departures from schema_fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.drift import TargetSchema, drift_report, ingest, parse_records, promote
from skein.session import allow_duplicate_keys, table


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    allow_duplicate_keys(spark)
    none = F.lit(None).cast("string")

    def rows(name: str, runtime: str, text: str, fallback, message: bool) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(runtime).alias("runtime"), "rec_id", "file_name", F.col(text).alias("text"), fallback.alias("fallback_kind"), F.lit(message).alias("has_message"))

    claude = rows("claude_records", "claude", "record", none, True)
    codex = rows("codex_records", "codex", "payload", F.col("rec_type"), False)
    pi = rows("pi_records", "pi", "record", none, True)
    return parse_records(claude.unionByName(codex).unionByName(pi))


def _schema(spark: SparkSession, sf_dir: str) -> TargetSchema:
    return TargetSchema.read(table(spark, sf_dir, "schema_fields"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_report(_parsed(spark, sf_dir), _schema(spark, sf_dir))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in the one consistent table with its rescue column."""
    return ingest(_parsed(spark, sf_dir), _schema(spark, sf_dir))


def p6_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after text stamps of number form and the branch field were approved."""
    return promote(p6_table(spark, sf_dir), {"timestamp": "string", "branch": "string"})


QUERIES = {"p6_found": p6_found, "p6_table": p6_table, "p6_promoted": p6_promoted}
SQL = {
    "p6_found": """
WITH docs AS (
  SELECT 'claude' AS runtime, file_name, record AS j, NULL AS fb, true AS msg FROM claude_records WHERE json_valid(record)
  UNION ALL SELECT 'codex', file_name, payload, rec_type, false FROM codex_records WHERE json_valid(payload)
  UNION ALL SELECT 'pi', file_name, record, NULL, true FROM pi_records WHERE json_valid(record)),
kinded AS (SELECT *, coalesce(j ->> '$.type', fb) AS rec_kind FROM docs WHERE json_type(j) = 'OBJECT'),
fields AS (
  SELECT runtime, file_name, rec_kind, unnest(json_keys(j)) AS k, j, '' AS prefix FROM kinded
  UNION ALL
  SELECT runtime, file_name, rec_kind, unnest(json_keys(j, '$.message')), json_extract(j, '$.message'), 'message.'
  FROM kinded WHERE msg AND json_type(j, '$.message') = 'OBJECT'),
typed AS (SELECT runtime, file_name, rec_kind, prefix || k AS field_path, json_type(j, '$."' || k || '"') AS t FROM fields),
seen AS (
  SELECT DISTINCT runtime, file_name, rec_kind, field_path,
    CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS json_type
  FROM typed WHERE t <> 'NULL'),
kinds AS (SELECT DISTINCT runtime, rec_kind FROM schema_fields),
per_file AS (SELECT DISTINCT runtime, file_name, rec_kind FROM kinded)
SELECT p.runtime, p.file_name, p.rec_kind, 'type' AS field_path, 'new_kind' AS change_kind FROM per_file p
WHERE NOT EXISTS (SELECT 1 FROM kinds k WHERE k.runtime = p.runtime AND k.rec_kind = p.rec_kind)
UNION ALL
SELECT DISTINCT s.runtime, s.file_name, s.rec_kind, s.field_path,
  CASE WHEN EXISTS (SELECT 1 FROM schema_fields f WHERE f.runtime = s.runtime AND f.rec_kind = s.rec_kind AND f.field_path = s.field_path) THEN 'retyped' ELSE 'added' END
FROM seen s JOIN kinds k ON k.runtime = s.runtime AND k.rec_kind = s.rec_kind
WHERE NOT EXISTS (SELECT 1 FROM schema_fields f WHERE f.runtime = s.runtime AND f.rec_kind = s.rec_kind AND f.field_path = s.field_path AND f.json_type = s.json_type)
UNION ALL
SELECT DISTINCT p.runtime, p.file_name, p.rec_kind, f.field_path, 'removed'
FROM per_file p JOIN schema_fields f ON f.runtime = p.runtime AND f.rec_kind = p.rec_kind AND f.is_required
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.runtime = p.runtime AND s.file_name = p.file_name AND s.rec_kind = p.rec_kind AND s.field_path = f.field_path)
"""
}
