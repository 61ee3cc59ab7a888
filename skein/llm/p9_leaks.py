"""Problem 9: documents that hold passages of eval_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.leakage import leaks
from skein.session import table


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with up to two character edits, and whether they are there word for word."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where("exact").select("doc_id", "item_id").distinct()


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
SQL: dict[str, str] = {}
