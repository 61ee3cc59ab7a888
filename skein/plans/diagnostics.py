"""Retrieval diagnostics: recall by episode and chunk, means with and without zeros, relevance of single rows, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import evaluation
from skein.operators.vector import dot, unit
from skein.plans import records, retrieval
from skein.session import materialize, table

_RECALLS = [f"r_{k}" for k in evaluation.R_AT] + ["chunk_r_100"]


def _recall(spark, d):
    """Eight vectors are an episode; sought are the episodes of the query's label, of labels below eight only."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.call_function("div", F.col("vec_id"), F.lit(8)).alias("episode"), "label")
    queries = v.where(F.col("id") % retrieval.EVERY == 0).select(F.col("id").alias("query_id"), "label")
    labels = v.where("label < 8 AND id % 3 = 0").select("episode", "label").distinct()
    relevant = queries.join(labels, "label").select("query_id", "episode")
    return evaluation.recall_diagnostics(queries, materialize(records._run(spark, d), "run"), v.select("id", "episode"), relevant)


def recall_by_episode(spark, d):
    return _recall(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in _RECALLS])


def recall_means(spark, d):
    """Means of the recalls by label and over all: of all known ones, and of the positive ones."""
    q = table(spark, d, "embeddings").where(F.col("vec_id") % retrieval.EVERY == 0)
    groups = q.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit("overall"), F.concat(F.lit("label:"), F.col("label").cast("string")))).alias("slice"))
    return evaluation.means(_recall(spark, d), groups, _RECALLS).select("slice", "metric", F.round("mean", 6).alias("mean"), F.round("positive_mean", 6).alias("positive_mean"))


def token_relevance(spark, d):
    """Of the three best chunks of each query how relevant each row is: its best product with a row of the query."""
    top = retrieval.vector.maxsim_top(retrieval._chunks(spark, d), retrieval._chunk_queries(spark, d), 3, digits=5).select("query_id", "id")
    rows = retrieval._vectors(spark, d).select("vec_id", F.call_function("div", F.col("vec_id"), F.lit(4)).alias("id"), unit(F.col("vector")).alias("x"))
    asked = rows.where(F.col("id") % retrieval.EVERY == 0).select(F.col("id").alias("query_id"), F.col("x").alias("q"))
    pairs = top.join(rows, "id").join(asked, "query_id")
    return pairs.groupBy("query_id", "id", "vec_id").agg(F.round(F.max(dot(F.col("x"), F.col("q"))), 5).alias("relevance"))


def reference_parts(spark, d):
    """References of the form session:ep:number among the targets of queries, taken apart; all others are counted as invalid."""
    named = table(spark, d, "eval_queries").select("id", F.explode("target_episode_ids").alias("target")).where("target IS NOT NULL")
    ref = F.regexp_replace(F.col("target"), r":(\d+)$", ":ep:$1")
    session, number = T.reference(ref)
    return named.select(session.alias("session"), number.alias("number")).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("number").alias("last"))


def epoch_units(spark, d):
    """Opencode times in seconds or milliseconds, all as milliseconds, and message texts under a bound."""
    rows = table(spark, d, "oc_message").where("id IS NOT NULL AND time_created IS NOT NULL")
    mixed = F.when(F.col("time_created") % 2 == 0, F.col("time_created")).otherwise(F.call_function("div", F.col("time_created"), F.lit(1000)))
    return rows.select("id", T.epoch_to_millis(mixed).alias("ms"), F.md5(T.bounded(F.col("data"), 120)).alias("digest")).distinct()


_D = (
    records._R
    + """, mem AS (SELECT vec_id AS id, vec_id // 8 AS episode, label FROM embeddings),
rel AS (SELECT DISTINCT q.vec_id AS query_id, e.episode FROM embeddings q JOIN mem e ON e.label = q.label WHERE q.vec_id % 50 = 0 AND e.label < 8 AND e.id % 3 = 0),
be AS (SELECT query_id, episode, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS er FROM run JOIN mem USING (id) GROUP BY query_id, episode),
ge AS (SELECT query_id, count(*) FILTER (WHERE er <= 10) AS e10, count(*) FILTER (WHERE er <= 50) AS e50, count(*) FILTER (WHERE er <= 100) AS e100 FROM be JOIN rel USING (query_id, episode) GROUP BY query_id),
gc AS (SELECT query_id, count(*) AS c FROM run JOIN mem USING (id) JOIN rel USING (query_id, episode) GROUP BY query_id),
tt AS (SELECT query_id, count(DISTINCT rel.episode) AS ne, count(*) AS nc FROM rel JOIN mem USING (episode) GROUP BY query_id),
dg AS (SELECT q.vec_id AS query_id, CASE WHEN ne > 0 THEN coalesce(e10, 0)::DOUBLE / ne END AS r_10, CASE WHEN ne > 0 THEN coalesce(e50, 0)::DOUBLE / ne END AS r_50,
  CASE WHEN ne > 0 THEN coalesce(e100, 0)::DOUBLE / ne END AS r_100, CASE WHEN nc > 0 THEN coalesce(c, 0)::DOUBLE / nc END AS chunk_r_100
  FROM embeddings q LEFT JOIN tt ON tt.query_id = q.vec_id LEFT JOIN ge ON ge.query_id = q.vec_id LEFT JOIN gc ON gc.query_id = q.vec_id WHERE q.vec_id % 50 = 0)"""
)
SQL = {
    "recall_by_episode": _D + " SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _RECALLS) + " FROM dg",
    "recall_means": _D
    + ", g AS (SELECT vec_id AS query_id, unnest(['overall', 'label:' || label]) AS slice FROM embeddings WHERE vec_id % 50 = 0), l AS ("
    + " UNION ALL ".join(f"SELECT query_id, '{m}' AS metric, {m} AS v FROM dg" for m in _RECALLS)
    + ") SELECT slice, metric, round(avg(v), 6) AS mean, round(avg(v) FILTER (WHERE v > 0), 6) AS positive_mean FROM l JOIN g USING (query_id) GROUP BY slice, metric",
    "token_relevance": retrieval._CH
    + """, top AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM raw) WHERE r <= 3)
SELECT t.query_id, t.id, c.vec_id, round(max(list_dot_product(c.e, q.e)), 5) AS relevance FROM top t JOIN u c ON c.id = t.id JOIN u q ON q.id = t.query_id GROUP BY t.query_id, t.id, c.vec_id""",
    "reference_parts": r"""WITH t AS (SELECT unnest(target_episode_ids) AS e FROM eval_queries), p AS (SELECT nullif(regexp_extract(e, '^(.+):(\d+)$', 1), '') AS session, TRY_CAST(nullif(regexp_extract(e, '^(.+):(\d+)$', 2), '') AS BIGINT) AS number FROM t WHERE e IS NOT NULL)
SELECT session, count(*) AS n, max(number) AS last FROM p GROUP BY session""",
    "epoch_units": "SELECT DISTINCT id, CASE WHEN time_created % 2 = 0 THEN time_created ELSE time_created // 1000 * 1000 END AS ms, md5(CASE WHEN length(data) > 120 THEN data[1:120] || chr(10) || '[cut]' ELSE data END) AS digest FROM oc_message WHERE id IS NOT NULL AND time_created IS NOT NULL",
}
QUERIES = {f.__name__: f for f in (recall_by_episode, recall_means, token_relevance, reference_parts, epoch_units)}
