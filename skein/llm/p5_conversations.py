"""Problem 5: oc_message and claude_records as conversations of user and assistant turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.conversations import ordered_turns, replay, verdicts
from skein.session import allow_duplicate_keys, json_kind, materialize, parse_line, table

BLANKS = " \t\r\n"


def _string(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(got, "$", "string"))


def _text(content: Column) -> Column:
    """The text of a `content`: itself, or its blocks' texts joined by line feeds; null when it is blank."""
    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: _string(b, "$.text"))
    text = F.when(json_kind(content) == "array", F.array_join(F.array_compact(blocks), "\n")).otherwise(_string(content, "$"))
    return F.when(F.btrim(text, F.lit(BLANKS)) != "", text)


def _turn_role(role: Column, text: Column, meta: Column | None = None) -> Column:
    plain = F.lower(F.btrim(role, F.lit(BLANKS)))
    counts = plain.isin("user", "assistant") & text.isNotNull()
    if meta is not None:
        counts = counts & (F.coalesce(F.lower(F.btrim(meta, F.lit(BLANKS))), F.lit("")) != "true")
    return F.when(counts, plain)


def claude_messages(records: DataFrame) -> DataFrame:
    """Records that are no JSON come without a session. A filter here would go below the parser and parse each line several times over."""
    v = records.select("rec_id", "ingested_at", parse_line(F.col("record")).alias("v"))
    stamp = F.try_variant_get("v", "$.timestamp", "variant")
    text = F.try_variant_get(stamp, "$", "string")
    ts = F.when(json_kind(stamp) == "number", F.floor(F.try_variant_get(stamp, "$", "double")).cast("bigint")).otherwise(F.coalesce(F.unix_millis(text.try_cast("timestamp")), text.try_cast("bigint")))
    body = _text(F.try_variant_get("v", "$.message.content", "variant"))
    role = _turn_role(_string(F.col("v"), "$.message.role"), body, F.try_variant_get("v", "$.isMeta", "string"))
    return v.select(F.lit("claude").alias("runtime"), _string(F.col("v"), "$.sessionId").alias("session_id"), _string(F.col("v"), "$.uuid").alias("uid"), F.try_variant_get("v", "$.parentUuid", "string").alias("parent"), role.alias("role"), ts.alias("ts"), F.col("rec_id").alias("seq"), F.col("ingested_at").cast("timestamp").alias("arrived"), body.alias("text"))


def opencode_messages(messages: DataFrame) -> DataFrame:
    v = messages.select("id", "session_id", "time_created", parse_line(F.col("data")).alias("v"))
    ts = F.coalesce("time_created", F.try_variant_get("v", "$.time.created", "bigint"))
    body = _text(F.try_variant_get("v", "$.content", "variant"))
    role = _turn_role(_string(F.col("v"), "$.role"), body)
    rows = v.select(F.lit("opencode").alias("runtime"), "session_id", F.col("id").alias("uid"), F.lit(None).cast("string").alias("parent"), role.alias("role"), ts.alias("ts"), body.alias("text"))
    # No column holds the order of arrival: rows are taken to come at their time, of equal ones the smaller id first.
    return rows.withColumn("seq", F.coalesce(F.regexp_extract("uid", r"(\d{1,15})\D*$", 1).try_cast("bigint"), F.lit(0))).withColumn("arrived", F.lit(None).cast("timestamp"))


def session_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' messages, sent through the stream in order of arrival."""
    allow_duplicate_keys(spark)
    messages = claude_messages(table(spark, sf_dir, "claude_records")).unionByName(opencode_messages(table(spark, sf_dir, "oc_message"))).drop("text")
    known = table(spark, sf_dir, "oc_session").select(F.lit("opencode").alias("runtime"), F.col("id").alias("session_id"))
    return verdicts(replay(messages), known)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to drop."""
    return session_verdicts(spark, sf_dir).where("NOT kept").select("runtime", "session_id")


def p5_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_verdicts(spark, sf_dir)


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the kept conversations, in order of time."""
    told = materialize(session_verdicts(spark, sf_dir), "verdicts")
    turns = claude_messages(table(spark, sf_dir, "claude_records")).unionByName(opencode_messages(table(spark, sf_dir, "oc_message")))
    return ordered_turns(turns.where("role IS NOT NULL AND session_id IS NOT NULL"), told)


QUERIES = {"p5_found": p5_found, "p5_verdicts": p5_verdicts, "p5_conversations": p5_conversations}
_TURNS = r"""
WITH c AS (
  SELECT rec_id, record ->> '$.sessionId' AS sid, record ->> '$.uuid' AS uid, record ->> '$.parentUuid' AS parent,
    lower(trim(record ->> '$.message.role', E' \t\r\n')) AS role, lower(trim(coalesce(record ->> '$.isMeta', ''), E' \t\r\n')) AS meta,
    record ->> '$.timestamp' AS stamp, json_extract(record, '$.message.content') AS content
  FROM claude_records WHERE json_valid(record)),
o AS (
  SELECT id, session_id AS sid, CASE WHEN json_valid(data) THEN data END AS data, time_created FROM oc_message),
m AS (
  SELECT 'claude' AS runtime, sid, coalesce(uid, 'r' || rec_id) AS uid, role, meta, content,
    coalesce(TRY_CAST(stamp AS BIGINT), epoch_ms(TRY_CAST(stamp AS TIMESTAMPTZ))) AS ts, rec_id AS seq FROM c
  UNION ALL
  SELECT 'opencode', sid, id, lower(trim(data ->> '$.role', E' \t\r\n')), '', json_extract(data, '$.content'),
    coalesce(time_created, TRY_CAST(data ->> '$.time.created' AS BIGINT)), 0 FROM o),
t AS (
  SELECT *, CASE json_type(content) WHEN 'VARCHAR' THEN content ->> '$'
    WHEN 'ARRAY' THEN array_to_string(list_transform(range(json_array_length(content)::BIGINT),
      lambda i: CASE WHEN json_type(content, '$[' || i || '].text') = 'VARCHAR' THEN json_extract_string(content, '$[' || i || '].text') END), chr(10)) END AS txt
  FROM m WHERE sid IS NOT NULL),
turns AS (
  SELECT runtime, sid, uid, arg_min(role, seq) AS role, min(ts) AS ts, min(seq) AS seq, arg_min(txt, seq) AS txt FROM t
  WHERE role IN ('user', 'assistant') AND meta <> 'true' AND trim(coalesce(txt, ''), E' \t\r\n') <> '' GROUP BY runtime, sid, uid),
seq AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next FROM turns WINDOW w AS (PARTITION BY runtime, sid ORDER BY ts, seq, uid)),
"""
_VERDICTS = (
    _TURNS
    + r"""told AS (
  SELECT runtime, sid, count(*) AS n_turns, bool_or(prev IS NULL AND role <> 'user') AS headless,
    bool_or(role = 'user' AND coalesce(next, '') <> 'assistant') AS unanswered FROM seq GROUP BY runtime, sid),
lost AS (
  SELECT sid, count(DISTINCT parent) AS n FROM c a
  WHERE a.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c b WHERE b.sid = a.sid AND b.uid = a.parent) GROUP BY sid),
every AS (
  SELECT 'claude' AS runtime, sid FROM c WHERE sid IS NOT NULL UNION SELECT 'opencode', id FROM oc_session WHERE id IS NOT NULL
  UNION SELECT 'opencode', session_id FROM oc_message WHERE session_id IS NOT NULL),
v AS (
  SELECT e.runtime, e.sid AS session_id, coalesce(t.n_turns, 0) AS n_turns, CASE WHEN e.runtime = 'claude' THEN coalesce(l.n, 0) ELSE 0 END AS n_lost, 0 AS n_stray, headless, unanswered
  FROM every e LEFT JOIN told t ON t.runtime = e.runtime AND t.sid = e.sid LEFT JOIN lost l ON l.sid = e.sid),
w AS (
  SELECT runtime, session_id, n_turns, n_lost, n_stray,
    CASE WHEN n_turns = 0 THEN 'empty' WHEN n_lost > 0 THEN 'broken' WHEN headless THEN 'headless' WHEN unanswered THEN 'unanswered' END AS reason FROM v)
"""
)
SQL = {
    "p5_found": _VERDICTS + " SELECT runtime, session_id FROM w WHERE reason IS NOT NULL",
    "p5_verdicts": _VERDICTS + " SELECT runtime, session_id, n_turns, n_lost, n_stray, reason IS NULL AS kept, reason FROM w",
    "p5_conversations": _VERDICTS
    + r""" SELECT s.runtime, s.sid AS session_id, row_number() OVER (PARTITION BY s.runtime, s.sid ORDER BY s.ts, s.seq, s.uid) - 1 AS turn_no, s.role, s.ts, s.txt AS text
FROM seq s JOIN w ON w.runtime = s.runtime AND w.session_id = s.sid WHERE w.reason IS NULL""",
}
