"""Queries over transcript records, table mutations, evaluation, graphs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import evaluation, tables, vector
from skein.operators.components import components
from skein.operators.hierarchy import hierarchy, one_parent
from skein.plans import p2_hierarchy, retrieval
from skein.plans.p3_nested import _FILES, nested_records
from skein.operators.nested import flatten
from skein.operators.ordered import exact_percentiles
from skein.session import allow_duplicate_keys, materialize, table
from skein.sources import transcripts as S


def _claude(spark: SparkSession, d: str) -> DataFrame:
    allow_duplicate_keys(spark)
    return S.claude_records(table(spark, d, "claude_records"))


def line_states(spark, d):
    allow_duplicate_keys(spark)
    lines = table(spark, d, "claude_records").select("file_name", F.col("record").alias("value"))
    return S.line_counts(S.scan_lines(lines))


def claude_signal(spark, d):
    return S.signal(_claude(spark, d)).groupBy("session_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def episode_segment(spark, d):
    return S.episodes(_claude(spark, d)).select("session_id", "rec_id", F.col("episode").cast("bigint").alias("episode"), "signal")


def episode_facts(spark, d):
    return S.episode_facts(S.episodes(_claude(spark, d)).withColumn("episode", F.col("episode").cast("bigint")))


def codex_context(spark, d):
    allow_duplicate_keys(spark)
    return S.codex_context(table(spark, d, "codex_records"))


def pi_headers(spark, d):
    allow_duplicate_keys(spark)
    return S.pi_headers(table(spark, d, "pi_records"))


def opencode_discovery(spark, d):
    return S.opencode_discovery(table(spark, d, "oc_session"), table(spark, d, "oc_message"))


def files_touched(spark, d):
    """How many distinct paths each session's records name, and the first in order."""
    files = flatten(nested_records(spark, d), "files").where("runtime = 'claude'")
    sessions = _claude(spark, d).select("rec_id", "session_id")
    return files.join(sessions, "rec_id").groupBy("session_id").agg(F.countDistinct("file_path").alias("n_files"), F.min("file_path").alias("first_file"))


def runtime_census(spark, d):
    parts = [table(spark, d, f"{r}_records").select(F.lit(r).alias("runtime"), "file_name") for r in ("claude", "codex", "pi")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("runtime").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("file_name").alias("n_files"))


def index_status(spark, d):
    docs = table(spark, d, "documents")
    return docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("project").isNull()).alias("no_project"), F.countDistinct("project").alias("n_projects"), F.sum(F.length("text")).alias("chars"), F.max("created_at").alias("latest"))


def corpus_profile(spark, d):
    rows = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.length("text").alias("size"))
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("size").cast("bigint").alias("longest"))
    return out.join(exact_percentiles(rows, "source", "size", shares), "source", "left").select("source", "n", *[F.round(n, 3).alias(n) for n in shares], "longest")


def topological_levels(spark, d):
    """How deep each record lies below the first of its thread, by peeling: a parent comes before its children."""
    rows = _claude(spark, d).where(F.col("uuid").isNotNull())
    links = rows.select(F.col("session_id").alias("tree"), F.col("uuid").alias("node"), F.col("parent_uuid").alias("parent"), F.lit(None).cast("timestamp_ntz").alias("at"))
    return hierarchy(one_parent(links), paths=False).groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("depth"), F.count_if(F.col("cycle_id").isNotNull()).alias("n_circular"))


def session_components(spark, d):
    """Sessions that belong together through links in either direction."""
    links = p2_hierarchy.session_links(spark, d).where(F.col("parent").isNotNull())
    name = lambda c: F.concat_ws("/", "tree", c)
    pairs = links.select(name("node").alias("a"), name("parent").alias("b")).distinct()
    tie = F.concat_ws(">", "a", "b")
    return components(pairs.select(F.col("a").alias("item"), tie.alias("tie")).unionByName(pairs.select(F.col("b").alias("item"), tie.alias("tie"))))


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")


def upsert_merge(spark, d):
    base = _customers(spark, d).where("c_custkey % 3 <> 0")
    fresh = _customers(spark, d).where("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return tables.upsert(base, fresh, ["c_custkey"], {"c_nationkey": -1})


def predicate_rewrite(spark, d):
    c = _customers(spark, d)
    return tables.update_where(tables.delete_where(c, F.col("c_nationkey") == 7), F.col("c_custkey") % 10 == 0, {"c_name": F.lit("changed")})


def tombstone_reconcile(spark, d):
    registry = _customers(spark, d).select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "absent").otherwise("available").alias("status"), F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-01-01").cast("timestamp_ntz")).alias("absent_since"))
    found = _customers(spark, d).where("c_custkey % 7 <> 0")
    return tables.reconcile_absent(registry, found, "c_custkey", F.lit("2024-06-01").cast("timestamp_ntz"))


def registry_union(spark, d):
    c = _customers(spark, d)
    return tables.registry_union(c.where("c_custkey % 2 = 0").withColumn("c_name", F.lower("c_name")), c.where("c_custkey % 3 = 0"), "c_custkey")


def prune(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    doomed = _customers(spark, d).where("c_custkey % 11 = 0")
    out = tables.prune({"orders": o, "customer": _customers(spark, d)}, doomed, "c_custkey")
    return out["orders"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("name"), "n").unionByName(out["customer"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer").alias("name"), "n"))


def latest_revision(spark, d):
    """The points at which a customer's order status changes, as revisions, with the current one marked."""
    points = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", "o_orderstatus")
    revised = tables.revise(points, "o_custkey", "at", "o_orderstatus")
    return tables.with_current(revised, "o_custkey", "revision").select("o_custkey", "revision", "o_orderkey", "o_orderstatus", "is_current")


def content_diff(spark, d):
    c = _customers(spark, d)
    old = c.where("c_custkey % 4 <> 0").select("c_custkey", F.md5("c_name").alias("digest"), (F.col("c_custkey") % 3 + 1).alias("revision"))
    new = c.where("c_custkey % 5 <> 0").select("c_custkey", F.md5(F.when(F.col("c_custkey") % 6 == 0, F.upper("c_name")).otherwise(F.concat("c_name", F.lit("")))).alias("digest"))
    return tables.content_diff(old, new, "c_custkey")


def cdc_receiver_apply(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    changes = e.select((F.col("event_id") % 1500).alias("record"), (F.col("event_id") % 6).alias("revision"), (F.col("k") % 3).alias("value"), (F.col("event_type") == "error").alias("is_delete"))
    return tables.apply_changes(changes, "record")


def _run(spark, d):
    return vector.maxsim_top(*retrieval._single_rows(spark, d), 100, digits=5).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


def _qrels(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.where(F.col("vec_id") % retrieval.EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    return v.join(q, "label").select("query_id", F.col("vec_id").alias("id"), F.when((F.col("vec_id") + F.col("query_id")) % 2 == 0, 2).otherwise(1).alias("grade"))


def _metrics(spark, d):
    queries = table(spark, d, "embeddings").where(F.col("vec_id") % retrieval.EVERY == 0).select(F.col("vec_id").alias("query_id"))
    return evaluation.per_query(materialize(_run(spark, d), "run"), _qrels(spark, d), queries)


def retrieval_metrics(spark, d):
    return _metrics(spark, d).select("query_id", *[F.round(m, 6).alias(m) for m in evaluation.metric_names()])


def slice_summary(spark, d):
    slices = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label:"), F.col("label").cast("string")).alias("slice"))
    return evaluation.by_slice(_metrics(spark, d), slices).select("slice", "n_queries", *[F.round(m, 6).alias(m) for m in evaluation.metric_names()])


def metric_gates(spark, d):
    slices = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("slice"))
    s = evaluation.by_slice(_metrics(spark, d), slices)
    lower = s.select("slice", "n_queries", *[(F.col(m) - (0.02 if m.startswith("ndcg") else 0.0)).alias(m) for m in evaluation.metric_names()])
    return evaluation.gates(s, lower).select("slice", "metric", "passed")


def extended_metric_run(spark, d):
    run = materialize(_run(spark, d), "run")
    final = run.where("rank <= 10 AND id % 2 = 0").select("query_id", "id", "rank")
    return evaluation.extended_run(final, run.select("query_id", "id", "rank"), 50)


def query_split_census(spark, d):
    """Queries of each class and split, trimmed and in lower case, repeated rows once."""
    plain = lambda c: F.nullif(F.lower(F.btrim(c)), F.lit(""))
    return table(spark, d, "eval_queries").groupBy("query_class", plain("split").alias("split")).agg(F.countDistinct("id").alias("n"))


_C = """
WITH base AS (
  SELECT rec_id, coalesce(line_no, 0) AS line_no, record ->> '$.sessionId' AS session_id, record ->> '$.uuid' AS uuid, lower(trim(record ->> '$.message.role', E' \\t\\r\\n')) AS role,
    lower(coalesce(record ->> '$.isMeta', '')) = 'true' AS is_meta, json_extract(record, '$.message.content') AS content, record ->> '$.cwd' AS cwd, json_type(record, '$.cwd') AS cwd_t, record ->> '$.gitBranch' AS branch, json_type(record, '$.gitBranch') AS branch_t
  FROM claude_records WHERE json_valid(record) AND json_type(record) = 'OBJECT' AND json_type(record, '$.sessionId') = 'VARCHAR'),
one AS (SELECT * FROM base QUALIFY uuid IS NULL OR row_number() OVER (PARTITION BY session_id, uuid ORDER BY rec_id) = 1),
txt AS (
  SELECT *, CASE json_type(content) WHEN 'VARCHAR' THEN content ->> '$' WHEN 'ARRAY' THEN coalesce(array_to_string(list_transform(range(json_array_length(content)::BIGINT),
    lambda i: CASE WHEN json_type(content, '$[' || i || '].text') = 'VARCHAR' THEN json_extract_string(content, '$[' || i || '].text') END), chr(10)), '') END AS t FROM one),
r AS (
  SELECT *, CASE WHEN trim(coalesce(t, ''), E' \\t\\r\\n') <> '' AND NOT is_meta THEN CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' ELSE 'noise' END ELSE 'noise' END AS signal FROM txt),
c AS (SELECT *, coalesce(sum(CASE WHEN signal <> 'noise' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS texts FROM r),
p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN texts END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line_no, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
ep AS (SELECT *, sum(CASE WHEN role = 'user' AND texts > coalesce(before, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_no, rec_id)::BIGINT AS episode FROM p)
"""
_R = """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda y: y::DOUBLE), list_transform(embedding, lambda y: y::DOUBLE)))) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_dot_product(q.e, c.e), 5) AS score FROM u q, u c WHERE q.vec_id % 50 = 0),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 100),
qr AS (SELECT q.vec_id AS query_id, v.vec_id AS id, CASE WHEN (v.vec_id + q.vec_id) % 2 = 0 THEN 2 ELSE 1 END AS grade FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 50 = 0),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM qr),
best AS (SELECT query_id, count(*) AS n, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 5) AS i5, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS i10 FROM ideal GROUP BY query_id),
hit AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 5) AS d5, sum((pow(2, grade) - 1) / log2(r + 1)) FILTER (WHERE r <= 10) AS d10, min(r) AS f,
  count(*) FILTER (WHERE r <= 5) AS h5, count(*) FILTER (WHERE r <= 10) AS h10, count(*) FILTER (WHERE r <= 50) AS h50, count(*) AS h100 FROM run JOIN qr USING (query_id, id) GROUP BY query_id),
m AS (SELECT b.query_id, coalesce(d5, 0) / i5 AS ndcg_5, coalesce(d10, 0) / i10 AS ndcg_10, CASE WHEN f <= 10 THEN 1.0::DOUBLE / f ELSE 0 END AS rr_10, CASE WHEN f <= 50 THEN 1.0::DOUBLE / f ELSE 0 END AS rr_50,
  coalesce(h5, 0) / 5.0::DOUBLE AS p_5, coalesce(h10, 0) / 10.0::DOUBLE AS p_10, coalesce(h10, 0)::DOUBLE / n AS r_10, coalesce(h50, 0)::DOUBLE / n AS r_50, coalesce(h100, 0)::DOUBLE / n AS r_100 FROM best b LEFT JOIN hit USING (query_id))
"""
_M = evaluation.metric_names()
SQL = {
    "line_states": "SELECT file_name, CASE WHEN trim(coalesce(record, ''), E' \\t\\r\\n') = '' THEN 'blank' WHEN strlen(record) > 500000 THEN 'oversized' WHEN NOT json_valid(record) THEN 'malformed' WHEN json_type(CASE WHEN json_valid(record) THEN record END) <> 'OBJECT' THEN 'not_object' ELSE 'record' END AS state, count(*) AS n FROM claude_records GROUP BY ALL",
    "claude_signal": _C + "SELECT session_id, signal, count(*) AS n, coalesce(sum(length(t)), 0)::BIGINT AS chars FROM r GROUP BY session_id, signal",
    "episode_segment": _C + "SELECT session_id, rec_id, episode, signal FROM ep",
    "episode_facts": _C
    + """SELECT session_id, episode, count(*) AS n_records, arg_min(cwd, (line_no, rec_id)) FILTER (WHERE cwd_t = 'VARCHAR') AS cwd, arg_min(branch, (line_no, rec_id)) FILTER (WHERE branch_t = 'VARCHAR') AS branch,
  coalesce(sum(length(t)) FILTER (WHERE signal = 'prompt'), 0)::BIGINT AS prompt_chars, coalesce(sum(length(t)) FILTER (WHERE signal = 'response'), 0)::BIGINT AS response_chars,
  coalesce(sum(CASE WHEN json_type(content) = 'ARRAY' THEN len(list_filter(range(json_array_length(content)::BIGINT), lambda i: json_extract_string(content, '$[' || i || '].type') = 'tool_use' AND json_type(content, '$[' || i || '].name') = 'VARCHAR')) END), 0)::BIGINT AS n_tools
FROM ep GROUP BY session_id, episode""",
    "codex_context": """WITH v AS (SELECT rec_id, file_name, coalesce(line_no, 0) AS line_no, coalesce(CASE WHEN json_type(payload, '$.type') = 'VARCHAR' THEN payload ->> '$.type' END, rec_type) AS kind,
  CASE WHEN json_type(payload, '$.cwd') = 'VARCHAR' THEN payload ->> '$.cwd' END AS c, CASE WHEN json_type(payload, '$.model') = 'VARCHAR' THEN payload ->> '$.model' END AS m FROM codex_records WHERE json_valid(payload))
SELECT file_name, rec_id, kind, cwd, model FROM (SELECT *, last_value(c IGNORE NULLS) OVER w AS cwd, last_value(m IGNORE NULLS) OVER w AS model FROM v WINDOW w AS (PARTITION BY file_name ORDER BY line_no, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind IN ('message', 'function_call', 'custom_tool_call')""",
    "pi_headers": """WITH v AS (
  SELECT file_name, (coalesce(line_no, 0), rec_id) AS pos, record ->> '$.type' AS kind, CASE WHEN json_type(record, '$.id') = 'VARCHAR' THEN record ->> '$.id' END AS id,
    CASE WHEN json_type(record, '$.rlmDepth') IN ('BIGINT', 'UBIGINT') THEN (record ->> '$.rlmDepth')::BIGINT END AS depth, CASE WHEN json_type(record, '$.modelId') = 'VARCHAR' THEN record ->> '$.modelId' END AS m
  FROM pi_records WHERE json_valid(record)),
h AS (SELECT file_name, arg_min({'id': id, 'depth': depth}, pos) FILTER (WHERE kind = 'session' AND id IS NOT NULL) AS h, arg_max(m, pos) FILTER (WHERE m IS NOT NULL) AS model FROM v GROUP BY file_name)
SELECT file_name, h.id AS session_id, coalesce(h.depth, 0) > 0 AS is_child, model FROM h WHERE h IS NOT NULL""",
    "opencode_discovery": """WITH m AS (SELECT session_id, count(*) AS n, max(t) AS latest FROM (SELECT id, session_id, max(time_created) AS t FROM oc_message WHERE session_id IS NOT NULL GROUP BY id, session_id) GROUP BY session_id)
SELECT s.id AS session_id, coalesce(n, 0) AS n_messages, latest AS latest_ms, sha256(coalesce(n, 0) || '|' || coalesce(latest::VARCHAR, '-')) AS fingerprint FROM (SELECT DISTINCT id FROM oc_session WHERE id IS NOT NULL) s LEFT JOIN m ON m.session_id = s.id""",
    "runtime_census": " UNION ALL ".join(f"SELECT '{r}' AS runtime, count(*) AS n_records, count(DISTINCT file_name) AS n_files FROM {r}_records" for r in ("claude", "codex", "pi")),
    "index_status": "SELECT count(*) AS n, count(*) FILTER (WHERE project IS NULL) AS no_project, count(DISTINCT project) AS n_projects, sum(length(text))::BIGINT AS chars, max(created_at) AS latest FROM documents",
    "corpus_profile": "SELECT coalesce(source, 'none') AS source, count(*) AS n, round(quantile_cont(length(text), 0.1), 3) AS p10, round(quantile_cont(length(text), 0.5), 3) AS p50, round(quantile_cont(length(text), 0.9), 3) AS p90, max(length(text)) AS longest FROM documents GROUP BY 1",
    "session_components": p2_hierarchy._LINKS.split("rooted AS")[0]
    + """near AS (SELECT DISTINCT runtime || '/' || c AS a, runtime || '/' || p AS b FROM bare WHERE c IS NOT NULL AND p IS NOT NULL),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT a, a FROM near UNION SELECT b, b FROM near),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, n.b FROM reach r JOIN both_ways n ON r.b = n.a)
SELECT a AS item, min(b) AS component FROM reach GROUP BY a""",
    "upsert_merge": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, upper(c_name), -1 FROM customer WHERE c_custkey % 2 = 0",
    "predicate_rewrite": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_nationkey <> 7",
    "tombstone_reconcile": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'absent' ELSE 'available' END AS status, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-06-01' END END AS absent_since FROM customer",
    "registry_union": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'fresh' ELSE 'registry' END AS origin FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "prune": "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 11 <> 0",
    "latest_revision": """WITH l AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders),
r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, o_orderkey, o_orderstatus FROM l WHERE was IS NULL OR was <> o_orderstatus)
SELECT *, revision = max(revision) OVER (PARTITION BY o_custkey) AS is_current FROM r""",
    "content_diff": """WITH o AS (SELECT c_custkey, md5(c_name) AS d, c_custkey % 3 + 1 AS r FROM customer WHERE c_custkey % 4 <> 0), n AS (SELECT c_custkey, md5(CASE WHEN c_custkey % 6 = 0 THEN upper(c_name) ELSE c_name END) AS d FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.d IS NULL THEN 'added' WHEN n.d IS NULL THEN 'deleted' WHEN o.d <> n.d THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN o.d IS NULL THEN 1 WHEN n.d IS NULL OR o.d <> n.d THEN r + 1 ELSE r END AS revision FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "cdc_receiver_apply": """WITH c AS (SELECT event_id % 1500 AS record, event_id % 6 AS revision, (props ->> '$.k')::BIGINT % 3 AS v, event_type = 'error' AS gone FROM events),
g AS (SELECT record, revision, min(v) AS v, bool_or(gone) AS gone, min(v) <> max(v) OR bool_or(gone) <> bool_and(gone) AS clash FROM c GROUP BY record, revision),
s AS (SELECT record, max(revision) FILTER (WHERE NOT clash) AS revision, arg_max(v, revision) FILTER (WHERE NOT clash) AS v, arg_max(gone, revision) FILTER (WHERE NOT clash) AS gone, count(*) FILTER (WHERE clash) AS q FROM g GROUP BY record)
SELECT record, revision, CASE WHEN NOT gone THEN v END AS value, gone AS is_delete, q AS n_quarantined FROM s""",
    "retrieval_metrics": _R + "SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in _M) + " FROM m",
    "slice_summary": _R + ", z AS (SELECT 'overall' AS slice, * FROM m UNION ALL SELECT 'label:' || e.label, m.* FROM m JOIN embeddings e ON e.vec_id = m.query_id) SELECT slice, count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _M) + " FROM z GROUP BY slice",
    "extended_metric_run": _R
    + """, b AS (SELECT query_id, id, min(CASE WHEN r <= 10 AND id % 2 = 0 THEN 0 ELSE 1 END) AS p, min(r) AS r FROM run GROUP BY query_id, id),
n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY p, r, id) AS position FROM b) SELECT query_id, id, position, (50 - position + 1)::DOUBLE AS score FROM n WHERE position <= 50""",
    "metric_gates": _R
    + ", g AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{m}')" for m in _M)
    + ") t(metric)) SELECT 'all' AS slice, metric, CASE WHEN starts_with(metric, 'ndcg') THEN false ELSE true END AS passed FROM g UNION ALL SELECT 'overall', metric, CASE WHEN starts_with(metric, 'ndcg') THEN false ELSE true END FROM g WHERE EXISTS (SELECT 1 FROM m)",
    "files_touched": f"SELECT session_id, count(DISTINCT file_path) AS n_files, min(file_path) AS first_file FROM ({_FILES}) f JOIN (SELECT rec_id, session_id FROM ({_C} SELECT rec_id, session_id FROM one)) r USING (rec_id) WHERE runtime = 'claude' GROUP BY session_id",
    "topological_levels": """WITH RECURSIVE r AS (
  SELECT rec_id, record ->> '$.sessionId' AS t, CASE WHEN json_type(record, '$.uuid') = 'VARCHAR' THEN record ->> '$.uuid' END AS n, record ->> '$.parentUuid' AS p
  FROM claude_records WHERE json_valid(record) AND json_type(record) = 'OBJECT' AND json_type(record, '$.sessionId') = 'VARCHAR'),
one AS (SELECT t, n, p FROM r WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, n ORDER BY rec_id) = 1),
links AS (SELECT t, n, p FROM one WHERE p IS NOT NULL),
nodes AS (SELECT t, n FROM one UNION SELECT t, p FROM links),
rooted AS (
  SELECT t, n, 0::BIGINT AS depth FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.t = x.t AND l.n = x.n)
  UNION ALL SELECT l.t, l.n, r.depth + 1 FROM rooted r JOIN links l ON l.t = r.t AND l.p = r.n)
SELECT x.t AS tree, count(*) AS n_nodes, max(r.depth) AS depth, count(*) FILTER (WHERE r.depth IS NULL) AS n_circular FROM nodes x LEFT JOIN rooted r ON r.t = x.t AND r.n = x.n GROUP BY x.t""",
    "query_split_census": "SELECT query_class, nullif(lower(trim(split)), '') AS split, count(DISTINCT id) AS n FROM eval_queries GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (line_states, claude_signal, episode_segment, episode_facts, codex_context, pi_headers, opencode_discovery, files_touched, runtime_census, index_status, corpus_profile, topological_levels, session_components, upsert_merge, predicate_rewrite, tombstone_reconcile, registry_union, prune, latest_revision, content_diff, cdc_receiver_apply, retrieval_metrics, slice_summary, metric_gates, extended_metric_run, query_split_census)
}
