"""Retrieval queries over documents, eval_items and embeddings.

The search queries are every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical, vector
from skein.session import table

EVERY = 50


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _item_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tokenize_terms(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.array_join(F.slice(t, 1, 5), " ").alias("first_tokens"))


def corpus_stats(spark, d):
    return lexical.corpus_stats(_docs(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


def document_frequency(spark, d):
    return lexical.document_frequency(_docs(spark, d))


def rarity_milli(spark, d):
    docs = _docs(spark, d)
    df = lexical.document_frequency(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    joined = df.crossJoin(F.broadcast(n))  # one row
    rare = F.floor(1000 * F.log2((F.col("n") + 1) / (F.col("df") + 1)) + 1e-9).cast("bigint")
    return joined.select("token", "df", rare.alias("rarity_milli"), F.when(rare >= 8000, "conservative").when(rare >= 6000, "central").when(rare >= 4000, "optimistic").alias("gate"))


def _scores(spark, d):
    return lexical.bm25(_docs(spark, d), _item_queries(spark, d))


def bm25_topk(spark, d):
    return lexical.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), 10).select("query_id", "id", "score", "rank")


def best_chunk_bm25_per_group(spark, d):
    """The best document of each project for each query."""
    groups = table(spark, d, "documents").where(F.col("project").isNotNull()).select(F.col("doc_id").alias("id"), "project")
    return lexical.best_per_group(_scores(spark, d).withColumn("score", F.round("score", 6)).join(groups, "id"), "project")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _chunks(spark, d):
    """Four vectors make the matrix of a chunk."""
    rows = _vectors(spark, d).withColumn("id", F.call_function("div", F.col("vec_id"), F.lit(4)))
    return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))), lambda s: s["vector"]).alias("matrix"))


def _chunk_queries(spark, d):
    return _chunks(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "matrix")


def _single_rows(spark, d):
    """Vectors as matrices of one row; every fiftieth is a query."""
    rows = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.array("vector").alias("matrix"))
    return rows, rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")


def cosine_topk(spark, d):
    return vector.maxsim_top(*_single_rows(spark, d), 10, digits=5).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def unit_mean_vector(spark, d):
    rows = _vectors(spark, d).withColumn("id", F.call_function("div", F.col("vec_id"), F.lit(4)))
    means = vector.unit_mean(rows, "id")
    return means.select("id", F.posexplode("proxy").alias("at", "x")).select("id", F.col("at").cast("bigint").alias("at"), F.round("x", 5).alias("x"))


def maxsim_multivector(spark, d):
    out = vector.maxsim_top(_chunks(spark, d), _chunk_queries(spark, d), 10, digits=5)
    return out.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def two_stage_search(spark, d):
    rows = _vectors(spark, d).withColumn("id", F.call_function("div", F.col("vec_id"), F.lit(4)))
    proxies = vector.unit_mean(rows, "id")
    qp = proxies.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "proxy")
    out = vector.two_stage(_chunks(spark, d), proxies, _chunk_queries(spark, d), qp, 10)
    return out.select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def token_pooling(spark, d):
    """Rows left of each chunk's matrix when every two are merged."""
    pooled = vector.pool_rows(_chunks(spark, d), 2)
    return pooled.select("id", F.size("matrix").cast("bigint").alias("n_rows"))


def token_vector_census(spark, d):
    return _chunks(spark, d).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size("matrix")).cast("bigint").alias("n_vectors"))


def episode_rollup(spark, d):
    """Chunks rolled up to groups of eight: the best chunk, and its score with a tenth of the next two."""
    scores = vector.maxsim(_chunks(spark, d), _chunk_queries(spark, d))
    clean = F.when(F.isnan("score") | F.col("score").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.round("score", 5)))
    rows = scores.select("query_id", F.call_function("div", F.col("id"), F.lit(8)).alias("episode"), "id", clean.alias("score"))
    w = Window.partitionBy("query_id", "episode").orderBy(F.col("score").desc(), "id")
    numbered = rows.withColumn("rn", F.row_number().over(w))
    out = numbered.groupBy("query_id", "episode").agg(F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("best_chunk"), F.max("score").alias("best"), F.coalesce(F.sum(F.when(F.col("rn").isin(2, 3), F.col("score"))), F.lit(0.0)).alias("next"))
    return out.select("query_id", "episode", "best_chunk", F.round(F.col("best") + 0.1 * F.col("next"), 4).alias("score"))


def _dense(spark, d):
    """A dense score made of shared words: the distinct tokens a document shares with the query."""
    wanted = lexical.query_tokens(_item_queries(spark, d))
    tf = lexical.terms(_docs(spark, d))
    return tf.join(wanted, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))


def rrf_fusion(spark, d):
    fused = lexical.fuse_rrf(_dense(spark, d), _scores(spark, d).withColumn("score", F.round("score", 6)))
    return fused.select("query_id", "id", F.round("score", 8).alias("score"))


def hybrid_search(spark, d):
    out = lexical.hybrid(_dense(spark, d), _scores(spark, d).withColumn("score", F.round("score", 6)), 2.0)
    return lexical.top_k(out.withColumn("score", F.round("score", 8)), 10).select("query_id", "id", "score", "rank")


def excerpt_phrase_window(spark, d):
    return _docs(spark, d).where(F.length("text") > 0).select("id", T.excerpt(F.col("text"), "the lock is held").alias("excerpt"))


def truncate_and_budget(spark, d):
    """Cards of the best documents of each query under a budget of 1,500 tokens: cut where it ends, dropped beyond."""
    top = lexical.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), 10)
    cards = top.join(_docs(spark, d), "id").select("query_id", "id", "rank", (F.lit(50) + T.token_estimate(T.truncated(F.col("text"), 2000))).alias("cost"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(w), F.lit(0))
    left = F.lit(1500) - spent
    return cards.withColumn("left", left).where("left > 0").select("query_id", "id", "rank", F.least("cost", "left").cast("bigint").alias("cost"), (F.col("cost") > F.col("left")).alias("truncated"))


def chunk_overlap(spark, d):
    """Windows of 235 words that repeat 25 of their predecessor."""
    words = F.filter(F.split("text", r"[ \n\r\t]+"), lambda w: w != "")
    rows = _docs(spark, d).where(F.col("text").isNotNull()).select("id", words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 26), F.lit(210))
    parts = rows.select("id", "w", F.posexplode(starts).alias("chunk_no", "start"))
    body = F.array_join(F.slice("w", F.col("start") + 1, F.lit(235)), " ")
    return parts.select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("start").cast("bigint").alias("start"), T.content_id(body, F.col("start")).alias("chunk_id"), F.least(F.lit(235), F.size("w") - F.col("start")).cast("bigint").alias("n_words"))


def chunk_id_digest(spark, d):
    return _docs(spark, d).where(F.col("text").isNotNull()).select("id", T.content_id(F.col("text")).alias("chunk_id"))


def canonical_digest(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source")
    return rows.select("doc_id", T.canonical_digest("source", "doc_id", "lang").alias("digest"))


def strip_markup(spark, d):
    marked = F.concat(F.lit("<command-name>run\n</command-name> "), F.col("text"), F.lit("<command-message>x</command-message>\n"))
    return _docs(spark, d).where(F.col("text").isNotNull()).select("id", F.md5(T.strip_command_markup(marked)).alias("digest"))


def normalize_title(spark, d):
    return _docs(spark, d).where(F.col("text").isNotNull()).select("id", T.truncated(T.normalized_title(F.col("text")), 100).alias("title"))


def project_tails(spark, d):
    return table(spark, d, "oc_session").where(F.col("directory").isNotNull()).select("id", T.path_tail(F.col("directory")).alias("tail"), T.at_or_beneath(F.col("directory"), F.lit("/fictional/lantern-works")).alias("inside")).distinct()


def where_filter(spark, d):
    """Structured filters and a raw clause as one predicate; both reach the scan."""
    from skein.api import search_filter

    cond = search_filter({"source": "claude", "project_contains": "works", "since": "2025-02-01", "until": "2025-12-31"}, "n_chars > 500")
    return table(spark, d, "documents").where(cond).select("doc_id", "source", "project")


def near_duplicate_lines(spark, d):
    """Documents by how many of their long lines other documents hold too."""
    lines = _docs(spark, d).where(F.col("text").isNotNull()).select("id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") >= 40)
    hashed = lines.select("id", F.md5("line").alias("h"))
    shared = hashed.groupBy("h").agg(F.countDistinct("id").alias("n")).where("n > 1")
    return hashed.join(shared, "h").groupBy("id").agg(F.count(F.lit(1)).alias("shared_lines"))


_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+'), lambda x: length(x) >= 2)"
_BM25 = f"""
WITH stats AS (
  SELECT count(*) AS n, coalesce(sum(len(t)), 0) / greatest(1, count(*)) AS avgdl FROM (SELECT {_TOK.format('text')} AS t FROM documents)),
q AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS token FROM eval_items WHERE item_id % 50 = 0),
listed AS MATERIALIZED (SELECT doc_id AS id, {_TOK.format('text')} AS t FROM documents),
raw AS MATERIALIZED (SELECT id, len(t) AS length, unnest(t) AS token FROM listed),
tf AS MATERIALIZED (SELECT id, token, any_value(length) AS length, count(*) AS tf FROM raw WHERE token IN (SELECT token FROM q) GROUP BY id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scored AS (
  SELECT q.query_id, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / avgdl))), 6) AS score
  FROM tf JOIN q USING (token) JOIN df USING (token), stats GROUP BY q.query_id, tf.id)"""
_DENSE = """,
dense AS (SELECT q.query_id, tf.id, count(*)::DOUBLE AS score FROM tf JOIN q USING (token) GROUP BY q.query_id, tf.id),
rd AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM dense),
rl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored WHERE score > 0),
fused AS (
  SELECT query_id, id, round(sum(part), 8) AS score FROM (
    SELECT query_id, id, {w} / (60 + r) AS part FROM rd UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + r) FROM rl) GROUP BY query_id, id)"""
_CH = """
WITH v AS (SELECT vec_id, vec_id // 4 AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
each AS (
  SELECT q.id AS query_id, c.id, q.vec_id, max(list_dot_product(q.e, c.e)) AS best FROM u q, u c WHERE q.id % 50 = 0 GROUP BY q.id, c.id, q.vec_id),
raw AS (SELECT query_id, id, sum(best) AS exact_score, round(sum(best), 5) AS score FROM each GROUP BY query_id, id)"""
SQL = {
    "tokenize_terms": f"SELECT doc_id AS id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t[1:5], ' ') AS first_tokens FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
    "corpus_stats": f"SELECT count(*) AS n_docs, coalesce(sum(len(t)), 0)::BIGINT AS total_tokens, round(coalesce(sum(len(t)), 0) / greatest(1, count(*)), 6) AS avgdl FROM (SELECT {_TOK.format('text')} AS t FROM documents)",
    "document_frequency": f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK.format('text')})) AS token FROM documents) GROUP BY token",
    "rarity_milli": f"""WITH df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOK.format('text')})) AS token FROM documents) GROUP BY token),
r AS (SELECT token, df, floor(1000 * log2(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1e-9)::BIGINT AS rarity_milli FROM df)
SELECT token, df, rarity_milli, CASE WHEN rarity_milli >= 8000 THEN 'conservative' WHEN rarity_milli >= 6000 THEN 'central' WHEN rarity_milli >= 4000 THEN 'optimistic' END AS gate FROM r""",
    "bm25_topk": _BM25 + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10",
    "best_chunk_bm25_per_group": _BM25 + " SELECT query_id, project, max(score) AS score FROM scored JOIN documents ON doc_id = id WHERE project IS NOT NULL GROUP BY query_id, project HAVING max(score) > 0",
    "rrf_fusion": _BM25 + _DENSE.format(w="1.0::DOUBLE") + " SELECT query_id, id, score FROM fused",
    "hybrid_search": _BM25 + _DENSE.format(w="2.0::DOUBLE") + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10",
    "truncate_and_budget": _BM25
    + """, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
cards AS (SELECT query_id, id, rank, 50 + greatest(1, least(length(text), 2000) // 4) AS cost FROM top JOIN documents ON doc_id = id WHERE rank <= 10),
b AS (SELECT *, 1500 - coalesce(sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM cards)
SELECT query_id, id, rank, least(cost, room)::BIGINT AS cost, cost > room AS truncated FROM b WHERE room > 0""",
    "cosine_topk": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.e, c.e), 5) AS score FROM u q, u c WHERE q.vec_id % 50 = 0)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "unit_mean_vector": """WITH p AS (SELECT vec_id // 4 AS id, generate_subscripts(embedding, 1) - 1 AS at_, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT id, at_, avg(x) AS m FROM p GROUP BY id, at_)
SELECT id, at_::BIGINT AS at, round(m / sqrt(sum(m * m) OVER (PARTITION BY id)), 5) AS x FROM m""",
    "maxsim_multivector": _CH + " SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM raw) WHERE rank <= 10",
    "two_stage_search": _CH
    + """, pm AS (SELECT id, generate_subscripts(e, 1) AS at_, unnest(e) AS x FROM v),
pa AS (SELECT id, list(m ORDER BY at_) AS p FROM (SELECT id, at_, avg(x) AS m FROM pm GROUP BY id, at_) GROUP BY id),
pu AS (SELECT id, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p FROM pa),
near AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.p, b.p), 9) AS s FROM pu a, pu b WHERE a.id % 50 = 0),
pool AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM near) WHERE r <= 320)
SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM raw JOIN pool USING (query_id, id)) WHERE rank <= 10""",
    "episode_rollup": _CH
    + """, n AS (SELECT query_id, id // 8 AS episode, id, greatest(0, score) AS score FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, episode ORDER BY score DESC, id) AS rn FROM n)
SELECT query_id, episode, max(CASE WHEN rn = 1 THEN id END) AS best_chunk, round(max(score) + 0.1 * coalesce(sum(CASE WHEN rn IN (2, 3) THEN score END), 0), 4) AS score FROM r GROUP BY query_id, episode""",
    "token_pooling": "SELECT vec_id // 4 AS id, CASE WHEN count(*) < 3 THEN count(*) ELSE 1 + greatest((count(*) - 1) // 2, 1) END AS n_rows FROM embeddings GROUP BY vec_id // 4",
    "token_vector_census": "SELECT count(DISTINCT vec_id // 4) AS n_chunks, count(*) AS n_vectors FROM embeddings",
    "chunk_overlap": """WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[ \\n\\r\\t]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT id, w, unnest(range(0, greatest(0, len(w) - 26) + 1, 210)) AS start FROM w WHERE len(w) > 0)
SELECT id, start // 210 AS chunk_no, start, substr(sha256(start || ':' || array_to_string(w[start + 1:start + 235], ' ')), 1, 16) AS chunk_id, least(235, len(w) - start) AS n_words FROM p""",
    "chunk_id_digest": "SELECT doc_id AS id, substr(sha256('0:' || text), 1, 16) AS chunk_id FROM documents WHERE text IS NOT NULL",
    "canonical_digest": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS digest FROM documents""",
    "strip_markup": r"SELECT doc_id AS id, md5(regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "where_filter": "SELECT doc_id, source, project FROM documents WHERE source = 'claude' AND contains(project, 'works') AND created_at >= TIMESTAMP '2025-02-01' AND created_at < TIMESTAMP '2026-01-01' AND n_chars > 500",
    "project_tails": "SELECT DISTINCT id, regexp_extract(rtrim(directory, '/'), '([^/]*/)?[^/]*$') AS tail, directory = '/fictional/lantern-works' OR starts_with(directory, '/fictional/lantern-works/') AS inside FROM oc_session WHERE directory IS NOT NULL",
    "near_duplicate_lines": """WITH l AS (SELECT DISTINCT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
h AS (SELECT id, md5(line) AS h FROM l WHERE length(line) >= 40), s AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT id) > 1)
SELECT id, count(*) AS shared_lines FROM h WHERE h IN (SELECT h FROM s) GROUP BY id""",
}
QUERIES = {
    f.__name__: f
    for f in (tokenize_terms, corpus_stats, document_frequency, rarity_milli, bm25_topk, best_chunk_bm25_per_group, cosine_topk, unit_mean_vector, maxsim_multivector, two_stage_search, token_pooling, token_vector_census, episode_rollup, rrf_fusion, hybrid_search, excerpt_phrase_window, truncate_and_budget, chunk_overlap, chunk_id_digest, canonical_digest, strip_markup, normalize_title, project_tails, where_filter, near_duplicate_lines)
}
