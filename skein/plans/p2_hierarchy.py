"""Problem 2: session links of parent_links and reduction_docs as hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hierarchy import bare_id, descendants, hierarchy, one_parent
from skein.session import table


def session_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, node, parent, at) of every session named as a child; the parent holds for rows in state resolved."""
    links = table(spark, sf_dir, "parent_links")
    parent = F.when(F.col("state") == "resolved", bare_id(F.col("parent_session")))
    direct = links.select(F.col("runtime").alias("tree"), bare_id(F.col("child_session")).alias("node"), parent.alias("parent"), F.col("observed_at").alias("at"))
    docs = table(spark, sf_dir, "reduction_docs").select("produced_at", F.explode("session_parents").alias("e"))
    reduced = docs.select(F.col("e.runtime").alias("tree"), bare_id(F.col("e.session_id")).alias("node"), bare_id(F.col("e.parent")).alias("parent"), F.col("produced_at").alias("at"))
    return direct.unionByName(reduced).where(F.col("tree").isNotNull() & F.col("node").isNotNull())


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_parent(session_links(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy(_nodes(spark, sf_dir), paths=False).where(F.col("cycle_id").isNotNull())
    return rows.select(F.col("tree").alias("runtime"), F.col("node").alias("session_id"), "cycle_id")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_nodes(spark, sf_dir)).select(F.col("tree").alias("runtime"), F.col("node").alias("session_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), "n_descendants", "cycle_id")


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(_nodes(spark, sf_dir)).select(F.col("tree").alias("runtime"), F.col("node").alias("session_id"), F.col("descendant").alias("descendant_id"), "distance")


_LINKS = r"""
WITH RECURSIVE raw AS (
  SELECT runtime, child_session AS c, CASE WHEN state = 'resolved' THEN parent_session END AS p, observed_at AS seen FROM parent_links
  UNION ALL
  SELECT e.runtime, e.session_id, e.parent, produced_at FROM (SELECT produced_at, unnest(session_parents) AS e FROM reduction_docs)),
bare AS (
  SELECT runtime, seen,
    nullif(regexp_replace(regexp_extract(lower(trim(c, E' \t\r\n')), '([^/\\]*)$', 1), '\.jsonl$', ''), '') AS c,
    nullif(regexp_replace(regexp_extract(lower(trim(p, E' \t\r\n')), '([^/\\]*)$', 1), '\.jsonl$', ''), '') AS p
  FROM raw),
links AS (SELECT runtime, c, arg_max(p, seen) AS p FROM bare WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY runtime, c),
nodes AS (
  SELECT runtime, c AS n FROM bare WHERE c IS NOT NULL UNION SELECT runtime, p FROM bare WHERE p IS NOT NULL AND c IS NOT NULL),
rooted AS (
  SELECT n.runtime, n.n, NULL::VARCHAR AS parent_id, n.n AS root_id, 0::BIGINT AS depth, n.n AS path
  FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.runtime = n.runtime AND l.c = n.n)
  UNION ALL
  SELECT l.runtime, l.c, l.p, r.root_id, r.depth + 1, r.path || '/' || l.c FROM rooted r JOIN links l ON l.runtime = r.runtime AND l.p = r.n),
"""
_LOST = """
lost AS (SELECT l.runtime, l.c, l.p FROM links l WHERE NOT EXISTS (SELECT 1 FROM rooted r WHERE r.runtime = l.runtime AND r.n = l.c)),
walk AS (
  SELECT runtime, c AS start, p AS stop FROM lost
  UNION
  SELECT w.runtime, w.start, l.p FROM walk w JOIN lost l ON l.runtime = w.runtime AND l.c = w.stop),
ring AS (SELECT runtime, start AS n FROM walk WHERE start = stop),
found AS (
  SELECT w.runtime, w.start AS session_id, min(w.stop) AS cycle_id
  FROM walk w JOIN ring r ON r.runtime = w.runtime AND r.n = w.stop GROUP BY w.runtime, w.start)"""
_DOWN = """
down AS (
  SELECT runtime, p AS n, c AS d, 1::BIGINT AS distance FROM links l
  WHERE EXISTS (SELECT 1 FROM rooted r WHERE r.runtime = l.runtime AND r.n = l.c)
  UNION ALL
  SELECT w.runtime, w.n, l.c, w.distance + 1 FROM down w JOIN links l ON l.runtime = w.runtime AND l.p = w.d)"""
SQL = {
    "p2_found": _LINKS + _LOST + " SELECT runtime, session_id, cycle_id FROM found",
    "p2_paths": _LINKS
    + _LOST
    + ","
    + _DOWN
    + """, sizes AS (SELECT runtime, n, count(*) AS k FROM down GROUP BY runtime, n)
SELECT r.runtime, r.n AS session_id, r.parent_id, r.root_id, r.depth, r.path, coalesce(s.k, 0) AS n_descendants, NULL::VARCHAR AS cycle_id
FROM rooted r LEFT JOIN sizes s ON s.runtime = r.runtime AND s.n = r.n
UNION ALL
SELECT f.runtime, f.session_id, l.p, NULL, NULL, NULL, NULL, f.cycle_id FROM found f JOIN lost l ON l.runtime = f.runtime AND l.c = f.session_id""",
    "p2_descendants": _LINKS + _DOWN + " SELECT runtime, n AS session_id, d AS descendant_id, distance FROM down",
}
QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants}
