"""Queries over evidence: decoded turns and calls, mentions, scopes, canonical copies, receipts, a coarse index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import candidates, code
from skein.functions import text as T
from skein.operators import coarse_index
from skein.operators.nested import flatten
from skein.operators.ordered import last_before, next_after
from skein.plans import ledger, p2_hierarchy, retrieval
from skein.plans.p3_nested import nested_records
from skein.session import allow_duplicate_keys, json_kind, materialize, parse_line, table
from skein.sources.transcripts import string_at


def evidence_census(spark, d):
    """Turns, calls, results and other blocks of claude and codex by kind."""
    return flatten(nested_records(spark, d), "blocks").where("parent_path IS NULL").groupBy("runtime", "block_type").agg(F.count(F.lit(1)).alias("n"))


def call_census(spark, d):
    return flatten(nested_records(spark, d), "calls").groupBy("runtime").agg(F.count(F.lit(1)).alias("n_calls"), F.count("call_id").alias("n_identified"))


def shell_census(spark, d):
    """Programs that the commands of tool calls run."""
    calls = flatten(nested_records(spark, d), "calls")
    command = F.get_json_object(F.col("arguments"), "$.command")
    found = calls.where(command.isNotNull()).select("runtime", F.explode(code.shell_programs()(command)).alias("program"))
    return found.groupBy("runtime", "program").agg(F.count(F.lit(1)).alias("n"))


def pseudonyms(spark, d):
    return table(spark, d, "oc_session").where(F.col("id").isNotNull()).select("id").distinct().select("id", code.keyed_id("skein")(F.col("id")).alias("pseudonym"))


def pi_context(spark, d):
    """Messages of pi with the model last changed to in their file, and the role."""
    allow_duplicate_keys(spark)
    v = table(spark, d, "pi_records").select("rec_id", "file_name", F.coalesce("line_no", F.lit(0)).alias("line_no"), parse_line(F.col("record")).alias("v")).where(json_kind(F.col("v")) == "object")
    kind = string_at(F.col("v"), "$.type")
    rows = v.select("rec_id", "file_name", "line_no", kind.alias("kind"), F.when(kind == "model_change", string_at(F.col("v"), "$.modelId")).alias("_m"), string_at(F.col("v"), "$.message.role").alias("role"))
    told = last_before(rows, "file_name", ["line_no", "rec_id"], {"model": F.col("_m")}, F.call_function("div", F.col("line_no"), F.lit(512)))
    return told.where("kind = 'message'").select("file_name", "rec_id", "role", "model")


def copy_canonicalization(spark, d):
    """Records written more than once: the first arrived stands for all."""
    allow_duplicate_keys(spark)
    v = table(spark, d, "claude_records").select("rec_id", "file_name", parse_line(F.col("record")).alias("v"))
    rows = v.select("rec_id", "file_name", string_at(F.col("v"), "$.sessionId").alias("session_id"), string_at(F.col("v"), "$.uuid").alias("uuid")).where("uuid IS NOT NULL")
    return rows.groupBy("session_id", "uuid").agg(F.min("rec_id").alias("rec_id"), F.count(F.lit(1)).alias("n_copies"), F.countDistinct("file_name").alias("n_files")).where("n_copies > 1")


def candidate_scan(spark, d):
    """Identifiers, paths, flags and error codes that documents name, by all classes, masks and exclusions, counted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return candidates.scanned(docs).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("first_doc"))


def candidate_keys(spark, d):
    """Documents under each key by which names are compared."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return candidates.scanned(docs, keys=True).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("df"))


def candidate_extract(spark, d):
    """Names of four simple classes, counted; `candidate_scan` has all classes."""
    body = F.coalesce("text", F.lit(""))
    kinds = {"path": r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+", "flag": r"--[a-z][a-z0-9-]+", "snake": r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+", "code": r"code=[0-9]+"}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all(body, F.lit(p), F.lit(0))).alias("items")) for k, p in kinds.items()])
    rows = table(spark, d, "documents").select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.items").alias("item"))
    return rows.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first_doc"))


def rarest_identifiers(spark, d):
    """The fifty rarest names, of equally rare the longest: anchors for queries."""
    return candidate_extract(spark, d).where("kind = 'snake'").orderBy("df", F.length("item").desc(), "item").limit(50).select("item", "df")


def token_first_mentions(spark, d):
    """The earliest document of each token, however many have it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "created_at", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return docs.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct(F.col("created_at").isNull(), "created_at", "id"))["id"].alias("first_doc"))


def first_mentions(spark, d):
    """Of `token_first_mentions` the tokens that two to five documents have."""
    return token_first_mentions(spark, d).where("df BETWEEN 2 AND 5")


def contextual_search_text(spark, d):
    """Project tail, first line and content of each document, at most 290 words."""
    words = lambda c, n: F.slice(F.filter(F.split(c, r"[ \n\r\t]+"), lambda w: w != ""), 1, n)
    title = F.split("text", "\n")[0]
    parts = F.concat(words(F.coalesce(T.path_tail(F.col("project")), F.lit("")), 16), words(title, 40), words(F.col("text"), 290))
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5(F.array_join(F.slice(parts, 1, 290), " ")).alias("digest"), F.least(F.lit(290), F.size(parts)).cast("bigint").alias("n_words"))


def confusable_negatives(spark, d):
    """For every fiftieth query the two of its class that share most words and no target; by words in common, then id."""
    rows = table(spark, d, "eval_queries").where(F.col("id").isNotNull()).groupBy("id").agg(F.min("query").alias("query"), F.min("query_class").alias("query_class"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("target_episode_ids", F.array().cast("array<string>")))))).alias("targets"))
    rows = materialize(rows, "queries")
    words = rows.select("id", "query_class", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    mine = words.where(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint") % retrieval.EVERY == 0).withColumnRenamed("id", "query_id")
    shared = mine.join(words, ["query_class", "token"]).where("query_id <> id").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n_shared"))
    targets = rows.select("id", "targets")
    apart = shared.join(targets, "id").join(targets.select(F.col("id").alias("query_id"), F.col("targets").alias("_t")), "query_id").where(~F.coalesce(F.arrays_overlap(F.array_compact("targets"), F.array_compact("_t")), F.lit(False)))
    w = Window.partitionBy("query_id").orderBy(F.col("n_shared").desc(), "id")
    return apart.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("query_id", "id", "n_shared", "rank")


def qrel_targets_missing(spark, d):
    """Targets of eval_queries whose session isn't among the claude, codex and pi files."""
    plain = lambda c: F.nullif(F.lower(F.btrim(c, F.lit(" \t\r\n"))), F.lit(""))
    named = table(spark, d, "eval_queries").select(F.explode("target_episode_ids").alias("e")).select(plain("e").alias("target")).where("target IS NOT NULL").distinct()
    files = None
    for r in ("claude", "codex", "pi"):
        f = table(spark, d, f"{r}_records").select(F.regexp_replace("file_name", r"\.jsonl$", "").alias("session")).distinct()
        files = f if files is None else files.unionByName(f)
    return named.withColumn("session", F.regexp_extract("target", r"^(.*):\d+$", 1)).join(files.distinct(), "session", "left_anti").select("target")


def workspace_scope(spark, d):
    """The owner of each session's folder: of the assigned prefixes above it the longest wins."""
    owners = spark.createDataFrame([("/fictional", "all"), ("/fictional/lantern-works", "lantern"), ("/fictional/lantern-works/index-relay", "relay"), ("/fictional/copper-finch", "finch")], "prefix string, owner string")
    rows = table(spark, d, "oc_session").where("id IS NOT NULL AND directory IS NOT NULL").select("id", "directory").distinct()
    parts = F.split("directory", "/")
    above = rows.select("id", "directory", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).withColumn("prefix", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("n")), "/"))
    return above.join(F.broadcast(owners), "prefix").groupBy("id", "directory").agg(F.max_by("owner", F.length("prefix")).alias("owner"))


def relay_levels(spark, d):
    """Ancestors of each session up to four levels above, by four joins."""
    links = p2_hierarchy.one_parent(p2_hierarchy.session_links(spark, d)).where("parent IS NOT NULL")
    links = materialize(links.select("tree", "node", "parent"), "links")
    at = links.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("level"))
    out = at
    for k in range(2, 5):
        at = at.join(links.select("tree", F.col("node").alias("up"), F.col("parent").alias("_p")), ["tree", "up"]).select("tree", "node", F.col("_p").alias("up"), F.lit(k).cast("bigint").alias("level"))
        out = out.unionByName(at)
    return out.groupBy("tree", "level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("up").alias("n_ancestors"))


def contradiction_reasons(spark, d):
    """Why a request in an execution's window may still not be its own."""
    pairs = ledger.band_join_reconcile(spark, d)
    e = ledger._events(spark, d).select("event_id", "k", "value")
    both = pairs.join(e.select(F.col("event_id").alias("execution_id"), F.col("k").alias("ek"), F.col("value").alias("ev")), "execution_id").join(e.select(F.col("event_id").alias("request_id"), F.col("k").alias("rk"), F.col("value").alias("rv")), "request_id")
    reasons = F.array_compact(F.array(F.when(F.col("ek") % 2 != F.col("rk") % 2, "parity"), F.when(F.col("rv") > F.col("ev"), "size"), F.when(F.col("ek") < F.col("rk"), "order")))
    return both.select("execution_id", "request_id", F.array_join(reasons, ",").alias("reasons"))


def backfill_series(spark, d):
    """Events of a half-open stretch by day and kind."""
    e = table(spark, d, "events").dropDuplicates(["event_id"]).where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-15'")
    return e.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def strongest_reuse(spark, d):
    """Of each user's kinds of event the strongest, and whether there was an error at all."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(rank, F.col("event_type"))).alias("strongest"), F.bool_or(F.col("event_type") == "error").alias("any_error"))


def representative_receipt(spark, d):
    """Each customer's largest order, of equal ones the smallest id."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    best = F.min(F.struct((-F.col("cents")).alias("neg"), "o_orderkey"))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", F.col("b.o_orderkey").alias("o_orderkey"), (-F.col("b.neg")).alias("cents"))


def evidence_admission(spark, d):
    """Of the digests an execution's phase was seen with the first in time is admitted; the others are repeats or conflicts."""
    j = ledger._journal(spark, d)
    first = j.groupBy("execution_id", "phase").agg(F.min(F.struct("ms", "digest"))["digest"].alias("admitted"))
    told = j.join(first, ["execution_id", "phase"])
    return told.groupBy("execution_id", "phase").agg(F.count_if(F.col("digest") == F.col("admitted")).alias("n_same"), F.count_if(F.col("digest") != F.col("admitted")).alias("n_conflicts"))


def source_gap_reasons(spark, d):
    """What follows each event of its user: nothing, a turn, too long a gap, or the next event."""
    rows = next_after(ledger._events(spark, d), "user_id", ["ts", "event_id"], {"next_ms": F.col("ms"), "next_type": F.col("event_type")})
    gap = F.col("next_ms") - F.col("ms")
    reason = F.when(gap.isNull(), "end").when(F.col("next_type") == "signup", "turn").when(gap > ledger.GAP_CAP_MS, "capped").otherwise("known")
    return rows.groupBy(reason.alias("reason"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.least(gap, F.lit(ledger.GAP_CAP_MS))), F.lit(0)).alias("gap_ms"))


def histogram_buckets(spark, d):
    """Counts of each latency bucket from the cumulative ones."""
    c = ledger.latency_histogram(spark, d).withColumn("_b", F.coalesce(F.col("le").try_cast("double"), F.lit(float("inf"))))
    w = Window.partitionBy("event_type").orderBy("_b")
    return c.select("event_type", "le", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("n"))


def deterministic_order(spark, d):
    """The fifty longest documents, later ones first, those without time last, then by id."""
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), "created_at").orderBy(F.col("n").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "doc_id").limit(50)


def coverage_watermark(spark, d):
    """How far each source is covered: its latest instant, no later than the collection stamp."""
    stamp = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.least(F.max("ts"), stamp).alias("covered"), F.count_if(F.col("ts") > stamp).alias("n_beyond"))


def ivf_recall(spark, d):
    """Every fiftieth vector searched by product codes in the nearest lists, against the exact ten: recall of each query."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index, codes = coarse_index.build(rows)
    queries = rows.where(F.col("id") % retrieval.EVERY == 0).withColumnRenamed("id", "query_id")
    near = coarse_index.search(rows, codes, index, queries, 10).select("query_id", "id")
    exact = retrieval.cosine_topk(spark, d).select("query_id", "id")
    hit = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))


_J = ledger._JOURNAL
_E = ledger._E
_CAND = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{p}'))) AS item FROM documents" for k, p in (("path", r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[A-Za-z0-9]+"), ("flag", r"--[a-z][a-z0-9-]+"), ("snake", r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+"), ("code", r"code=[0-9]+")))
_BLOCKS = """WITH c AS (
  SELECT 'claude' AS runtime, json_extract(record, '$.message.content') AS c FROM claude_records WHERE json_valid(record) AND json_type(record, '$.message') = 'OBJECT'
  UNION ALL SELECT 'codex', json_extract(payload, '$.content') FROM codex_records WHERE json_valid(payload)),
b AS (SELECT runtime, json_extract(c, '$[' || i || ']') AS b FROM (SELECT *, unnest(range(json_array_length(c)::BIGINT)) AS i FROM c WHERE json_type(c) = 'ARRAY'))"""
SQL = {
    "evidence_census": _BLOCKS
    + """ SELECT runtime, block_type, count(*) AS n FROM (
  SELECT runtime, 'text' AS block_type FROM c WHERE json_type(c) = 'VARCHAR'
  UNION ALL SELECT runtime, CASE WHEN json_type(b, '$.type') = 'VARCHAR' THEN b ->> '$.type' END FROM b) GROUP BY runtime, block_type""",
    "call_census": _BLOCKS
    + """, k AS (
  SELECT runtime, json_type(b, '$.id') AS t FROM b WHERE runtime = 'claude' AND json_type(b, '$.type') = 'VARCHAR' AND (b ->> '$.type') = 'tool_use'
  UNION ALL SELECT 'codex', json_type(payload, '$.call_id') FROM codex_records WHERE json_valid(payload) AND (payload ->> '$.type') IN ('function_call', 'custom_tool_call'))
SELECT runtime, count(*) AS n_calls, count(*) FILTER (WHERE t <> 'NULL') AS n_identified FROM k GROUP BY runtime""",
    "candidate_extract": f"SELECT kind, item, count(*) AS df, min(doc_id) AS first_doc FROM ({_CAND}) GROUP BY kind, item",
    "rarest_identifiers": f"SELECT item, count(*) AS df FROM ({_CAND}) WHERE kind = 'snake' GROUP BY item ORDER BY df, length(item) DESC, item LIMIT 50",
    "token_first_mentions": f"WITH t AS MATERIALIZED (SELECT doc_id, created_at, {retrieval._TOK.format('text')} AS t FROM documents), r AS (SELECT DISTINCT doc_id, created_at, unnest(t) AS token FROM t) SELECT token, count(*) AS df, arg_min(doc_id, (created_at IS NULL, created_at, doc_id)) AS first_doc FROM r GROUP BY token",
    "first_mentions": f"WITH t AS MATERIALIZED (SELECT doc_id, created_at, {retrieval._TOK.format('text')} AS t FROM documents), r AS (SELECT DISTINCT doc_id, created_at, unnest(t) AS token FROM t) SELECT token, count(*) AS df, arg_min(doc_id, (created_at, doc_id)) AS first_doc FROM r GROUP BY token HAVING count(*) BETWEEN 2 AND 5",
    "contextual_search_text": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(regexp_extract(rtrim(project, '/'), '([^/]*/)?[^/]*$'), ''), '[ \n\r\t]+'), lambda x: x <> '')[1:16] || list_filter(string_split_regex(string_split(text, chr(10))[1], '[ \n\r\t]+'), lambda x: x <> '')[1:40] || list_filter(string_split_regex(text, '[ \n\r\t]+'), lambda x: x <> '')[1:290] AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(p[1:290], ' ')) AS digest, least(290, len(p)) AS n_words FROM w""",
    "copy_canonicalization": "WITH v AS (SELECT rec_id, file_name, CASE WHEN json_type(record, '$.sessionId') = 'VARCHAR' THEN record ->> '$.sessionId' END AS session_id, record ->> '$.uuid' AS uuid FROM claude_records WHERE json_valid(record) AND json_type(record, '$.uuid') = 'VARCHAR') SELECT session_id, uuid, min(rec_id) AS rec_id, count(*) AS n_copies, count(DISTINCT file_name) AS n_files FROM v GROUP BY session_id, uuid HAVING count(*) > 1",
    "pi_context": """WITH v AS (SELECT rec_id, file_name, coalesce(line_no, 0) AS line_no, record ->> '$.type' AS kind, CASE WHEN record ->> '$.type' = 'model_change' AND json_type(record, '$.modelId') = 'VARCHAR' THEN record ->> '$.modelId' END AS m, CASE WHEN json_type(record, '$.message.role') = 'VARCHAR' THEN record ->> '$.message.role' END AS role FROM pi_records WHERE json_valid(record))
SELECT file_name, rec_id, role, model FROM (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY line_no, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS model FROM v) WHERE kind = 'message'""",
    "qrel_targets_missing": r"""WITH t AS (SELECT DISTINCT nullif(lower(trim(e, E' \t\r\n')), '') AS target FROM (SELECT unnest(target_episode_ids) AS e FROM eval_queries)),
f AS (SELECT file_name FROM claude_records UNION SELECT file_name FROM codex_records UNION SELECT file_name FROM pi_records)
SELECT target FROM t WHERE target IS NOT NULL AND regexp_extract(target, '^(.*):\d+$', 1) NOT IN (SELECT regexp_replace(file_name, '\.jsonl$', '') FROM f WHERE file_name IS NOT NULL)""",
    "workspace_scope": """WITH o(prefix, owner) AS (VALUES ('/fictional', 'all'), ('/fictional/lantern-works', 'lantern'), ('/fictional/lantern-works/index-relay', 'relay'), ('/fictional/copper-finch', 'finch'))
SELECT id, directory, arg_max(owner, length(prefix)) AS owner FROM (SELECT DISTINCT id, directory FROM oc_session WHERE id IS NOT NULL) s JOIN o ON directory = prefix OR starts_with(directory, prefix || '/') GROUP BY id, directory""",
    "relay_levels": p2_hierarchy._LINKS.split("nodes AS")[0].rstrip().rstrip(",")
    + """, up AS (SELECT runtime, c, p, 1::BIGINT AS level FROM links UNION ALL SELECT u.runtime, u.c, l.p, u.level + 1 FROM up u JOIN links l ON l.runtime = u.runtime AND l.c = u.p WHERE u.level < 4)
SELECT runtime AS tree, level, count(*) AS n, count(DISTINCT p) AS n_ancestors FROM up GROUP BY runtime, level""",
    "contradiction_reasons": ledger._PAIRS + """, z AS (SELECT p.*, a.k AS ek, a.value AS ev, b.k AS rk, b.value AS rv FROM pairs p JOIN e a ON a.event_id = p.execution_id JOIN e b ON b.event_id = p.request_id)
SELECT execution_id, request_id, array_to_string(list_filter([CASE WHEN ek % 2 <> rk % 2 THEN 'parity' END, CASE WHEN rv > ev THEN 'size' END, CASE WHEN ek < rk THEN 'order' END], lambda x: x IS NOT NULL), ',') AS reasons FROM z""",
    "pseudonyms": """WITH i AS (SELECT DISTINCT id FROM oc_session WHERE id IS NOT NULL),
k AS (SELECT rpad(hex('skein'::BLOB), 128, '0') AS k),
p AS (SELECT string_agg(upper(printf('%02x', xor(('0x' || k[2 * n + 1:2 * n + 2])::INT, 54))), '' ORDER BY n) AS inner_, string_agg(upper(printf('%02x', xor(('0x' || k[2 * n + 1:2 * n + 2])::INT, 92))), '' ORDER BY n) AS outer_ FROM k, range(64) r(n))
SELECT id, substr(sha256(from_hex(outer_ || sha256(from_hex(inner_ || hex(encode(id)))))), 1, 24) AS pseudonym FROM i, p""",
    "confusable_negatives": f"""WITH q AS (SELECT id, min(query) AS query, min(query_class) AS qc FROM eval_queries WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT DISTINCT id, unnest(target_episode_ids) AS e FROM eval_queries WHERE id IS NOT NULL),
w AS (SELECT DISTINCT id, qc, unnest({retrieval._TOK.format('query')}) AS token FROM q),
sh AS (
  SELECT m.id AS query_id, w.id, count(*) AS n_shared FROM w m JOIN w ON m.qc = w.qc AND m.token = w.token
  WHERE TRY_CAST(regexp_extract(m.id, '(\\d+)$', 1) AS BIGINT) % 50 = 0 AND m.id <> w.id GROUP BY m.id, w.id),
ap AS (SELECT * FROM sh WHERE NOT EXISTS (SELECT 1 FROM t a JOIN t b ON a.e = b.e WHERE a.id = sh.query_id AND b.id = sh.id))
SELECT query_id, id, n_shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_shared DESC, id) AS rank FROM ap) WHERE rank <= 2""",
    "backfill_series": "SELECT ts::DATE::VARCHAR AS day, event_type, count(DISTINCT event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL",
    "strongest_reuse": "SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END, event_type)) AS strongest, bool_or(event_type = 'error') AS any_error FROM events GROUP BY user_id",
    "representative_receipt": "SELECT o_custkey, arg_min(o_orderkey, (-round(o_totalprice * 100)::BIGINT, o_orderkey)) AS o_orderkey, max(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY o_custkey",
    "evidence_admission": _J + ", f AS (SELECT execution_id, phase, arg_min(digest, (ms, digest)) AS admitted FROM j GROUP BY execution_id, phase) SELECT execution_id, phase, count(*) FILTER (WHERE digest = admitted) AS n_same, count(*) FILTER (WHERE digest <> admitted) AS n_conflicts FROM j JOIN f USING (execution_id, phase) GROUP BY execution_id, phase",
    "source_gap_reasons": _E + """, g AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ms AS gap, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM e)
SELECT CASE WHEN gap IS NULL THEN 'end' WHEN nt = 'signup' THEN 'turn' WHEN gap > 300000 THEN 'capped' ELSE 'known' END AS reason, event_type, count(*) AS n, coalesce(sum(least(gap, 300000)), 0)::BIGINT AS gap_ms FROM g GROUP BY 1, 2""",
    "histogram_buckets": _E
    + ", u AS (SELECT event_type, floor(value * 1000) AS us FROM e), b(le, hi) AS (VALUES "
    + ", ".join(f"('{b}', {b}::DOUBLE)" for b in ledger.BOUNDS_US)
    + ", ('+Inf', 'inf'::DOUBLE)), c AS (SELECT event_type, le, hi, count(*) FILTER (WHERE us <= hi) AS n FROM u, b GROUP BY ALL) SELECT event_type, le, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY hi), 0) AS n FROM c",
    "deterministic_order": "SELECT doc_id, length(text) AS n, created_at FROM documents ORDER BY n DESC NULLS LAST, created_at DESC NULLS LAST, doc_id LIMIT 50",
    "coverage_watermark": "SELECT event_type, least(max(ts), TIMESTAMP '2024-01-20') AS covered, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS n_beyond FROM events GROUP BY event_type",
}
QUERIES = {
    f.__name__: f
    for f in (evidence_census, call_census, shell_census, pseudonyms, pi_context, copy_canonicalization, candidate_scan, candidate_keys, candidate_extract, rarest_identifiers, token_first_mentions, first_mentions, contextual_search_text, confusable_negatives, qrel_targets_missing, workspace_scope, relay_levels, contradiction_reasons, backfill_series, strongest_reuse, representative_receipt, evidence_admission, source_gap_reasons, histogram_buckets, deterministic_order, coverage_watermark, ivf_recall)
}
