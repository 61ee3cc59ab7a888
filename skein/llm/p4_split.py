"""Problem 4: eval_queries in splits that keep queries tied by episodes together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.grouped_split import grouped_split
from skein.operators.components import components
from skein.session import table


def _plain(col: Column) -> Column:
    return F.nullif(F.lower(F.btrim(col, F.lit(" \t\r\n"))), F.lit(""))


def query_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, tie): each query with each episode it names, a null one for queries without any."""
    rows = table(spark, sf_dir, "eval_queries").where(F.col("id").isNotNull())
    named = rows.select(F.col("id").alias("item"), F.explode_outer("target_episode_ids").alias("episode"))
    return named.select("item", _plain(F.col("episode")).alias("tie"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of groups that carry more than one split."""
    comp = components(query_ties(spark, sf_dir))
    rows = table(spark, sf_dir, "eval_queries").where(F.col("id").isNotNull())
    carried = rows.groupBy(F.col("id").alias("item")).agg(F.min(_plain(F.col("split"))).alias("low"), F.max(_plain(F.col("split"))).alias("high"))
    rated = comp.join(carried, "item")
    mixed = rated.groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("component")
    return comp.join(mixed, "component").select(F.col("item").alias("query_id"), F.col("component").alias("group_id"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped_split(query_ties(spark, sf_dir))
    return out.select(F.col("item").alias("query_id"), F.col("component").alias("group_id"), "group_size", "split")


QUERIES = {"p4_found": p4_found, "p4_splits": p4_splits}
SQL = {
    "p4_found": r"""
WITH RECURSIVE ties AS (
  SELECT DISTINCT id, nullif(lower(trim(e, E' \t\r\n')), '') AS ep
  FROM (SELECT id, unnest(target_episode_ids) AS e FROM eval_queries WHERE id IS NOT NULL)),
ok AS (SELECT id, ep FROM ties WHERE ep IS NOT NULL),
near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.ep = b.ep),
reach AS (
  SELECT DISTINCT id AS a, id AS b FROM eval_queries WHERE id IS NOT NULL
  UNION
  SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
grp AS (SELECT a AS query_id, min(b) AS group_id FROM reach GROUP BY a),
mixed AS (
  SELECT g.group_id FROM grp g JOIN eval_queries q ON q.id = g.query_id
  GROUP BY g.group_id HAVING count(DISTINCT nullif(lower(trim(q.split, E' \t\r\n')), '')) > 1)
SELECT g.query_id, g.group_id FROM grp g WHERE g.group_id IN (SELECT group_id FROM mixed)
"""
}
