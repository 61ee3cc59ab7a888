"""Transcript tables read into canonical records, episodes and session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordered import last_before, running_sum
from skein.session import json_kind, materialize, parse_line

BLANKS = " \t\r\n"
MAX_RECORD_BYTES = 500_000


def string_at(v: Column, path: str) -> Column:
    """The string at a path; null for anything else there."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(got, "$", "string"))


def scan_lines(lines: DataFrame, max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """lines(file_name, value) with `state`: blank, oversized, malformed, not_object or record, and the parsed `v` of records."""
    v = parse_line(F.col("value"))
    kind = json_kind(F.col("v"))
    state = (
        F.when(F.coalesce(F.btrim("value", F.lit(BLANKS)), F.lit("")) == "", "blank")
        .when(F.octet_length("value") > max_bytes, "oversized")
        .when(F.col("v").isNull(), "malformed")
        .when(kind != "object", "not_object")
        .otherwise("record")
    )
    return lines.withColumn("v", F.when(F.octet_length("value") <= max_bytes, v)).withColumn("state", state)


def line_counts(scanned: DataFrame) -> DataFrame:
    """Lines of each state by file."""
    return scanned.groupBy("file_name", "state").agg(F.count(F.lit(1)).alias("n"))


def block_text(content: Column, joiner: str = "\n") -> Column:
    """The text of a content: itself, or the strings `text` of its blocks joined."""
    blocks = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda b: string_at(b, "$.text"))
    return F.when(json_kind(content) == "array", F.array_join(F.array_compact(blocks), joiner)).otherwise(string_at(content, "$"))


def claude_records(table: DataFrame) -> DataFrame:
    """(session_id, rec_id, line_no, kind, role, is_meta, text, has_text, uuid, parent_uuid, cwd, branch, tools) in a row a record.

    Repeated uuids come once, the first arrived; records without a uuid stay. Roles are trimmed and in lower case.
    """
    v = table.select("rec_id", "file_name", "line_no", parse_line(F.col("record")).alias("v")).where(json_kind(F.col("v")) == "object")
    content = F.try_variant_get("v", "$.message.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    tools = F.transform(F.filter(blocks, lambda b: string_at(b, "$.type") == "tool_use"), lambda b: string_at(b, "$.name"))
    text = block_text(content)
    rows = v.select(
        string_at(F.col("v"), "$.sessionId").alias("session_id"),
        "rec_id",
        F.coalesce("line_no", F.lit(0)).alias("line_no"),
        string_at(F.col("v"), "$.type").alias("kind"),
        F.lower(F.btrim(string_at(F.col("v"), "$.message.role"), F.lit(BLANKS))).alias("role"),
        (F.coalesce(F.lower(F.try_variant_get("v", "$.isMeta", "string")), F.lit("")) == "true").alias("is_meta"),
        text.alias("text"),
        (F.coalesce(F.btrim(text, F.lit(BLANKS)), F.lit("")) != "").alias("has_text"),
        string_at(F.col("v"), "$.uuid").alias("uuid"),
        F.try_variant_get("v", "$.parentUuid", "string").alias("parent_uuid"),
        string_at(F.col("v"), "$.cwd").alias("cwd"),
        string_at(F.col("v"), "$.gitBranch").alias("branch"),
        F.when(json_kind(content) == "array", F.array_compact(tools)).alias("tools"),
    ).where(F.col("session_id").isNotNull())
    own = F.coalesce("uuid", F.concat(F.lit("\u0001"), F.col("rec_id").cast("string")))
    first = Window.partitionBy("session_id", "_own").orderBy("rec_id")
    return rows.withColumn("_own", own).withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_own", "_copy")


def signal(records: DataFrame) -> DataFrame:
    """`records` with `signal`: prompt, response, noise (what carries no text of the two roles or is meta)."""
    counts = F.col("has_text") & ~F.col("is_meta")
    return records.withColumn("signal", F.when(counts & (F.col("role") == "user"), "prompt").when(counts & (F.col("role") == "assistant"), "response").otherwise("noise"))


def episodes(records: DataFrame, lines_a_bucket: int = 512) -> DataFrame:
    """`records` with `episode`, numbered from 0 in each session.

    A user record opens an episode if the open one has text by then; one without text folds into what follows. As a
    user record without boundary had no text before it, it is enough to look back to the user record before.
    """
    rows = materialize(signal(records), "records")  # three passes follow, over what was parsed once
    order, bucket = ["line_no", "rec_id"], F.call_function("div", F.col("line_no"), F.lit(lines_a_bucket))
    carries = F.when(F.col("signal") != "noise", 1).otherwise(0)
    told = running_sum(rows, "session_id", order, carries, "_upto", bucket).withColumn("_texts", F.col("_upto") - carries)
    user = F.col("role") == "user"
    told = last_before(told, "session_id", order, {"_then": F.when(user, F.col("_texts"))}, bucket)
    opens = F.when(user & (F.col("_texts") > F.coalesce("_then", F.lit(0))), 1).otherwise(0)
    return running_sum(told, "session_id", order, opens, "episode", bucket).drop("_upto", "_texts", "_then")


def episode_facts(numbered: DataFrame) -> DataFrame:
    """One row an episode: sizes, first cwd and branch, tools in order, lengths of its prompt and response."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("line_no", "rec_id"))).alias(c)
    size = lambda s: F.coalesce(F.sum(F.when(F.col("signal") == s, F.length("text"))), F.lit(0)).alias(f"{s}_chars")
    return numbered.groupBy("session_id", "episode").agg(
        F.count(F.lit(1)).alias("n_records"), first("cwd"), first("branch"), size("prompt"), size("response"), F.coalesce(F.sum(F.size("tools")), F.lit(0)).cast("bigint").alias("n_tools")
    )


def codex_context(table: DataFrame, lines_a_bucket: int = 512) -> DataFrame:
    """Messages and calls of codex with the cwd and model last said in their file: (file_name, rec_id, kind, cwd, model)."""
    v = table.select("rec_id", "file_name", F.coalesce("line_no", F.lit(0)).alias("line_no"), "rec_type", parse_line(F.col("payload")).alias("v")).where(json_kind(F.col("v")) == "object")
    rows = v.select("rec_id", "file_name", "line_no", F.coalesce(string_at(F.col("v"), "$.type"), "rec_type").alias("kind"), string_at(F.col("v"), "$.cwd").alias("_cwd"), string_at(F.col("v"), "$.model").alias("_model"))
    bucket = F.call_function("div", F.col("line_no"), F.lit(lines_a_bucket))
    told = last_before(rows, "file_name", ["line_no", "rec_id"], {"cwd": F.col("_cwd"), "model": F.col("_model")}, bucket)
    return told.where(F.col("kind").isin("message", "function_call", "custom_tool_call")).select("file_name", "rec_id", "kind", "cwd", "model")


def pi_headers(table: DataFrame) -> DataFrame:
    """(file_name, session_id, is_child, model) of each pi file: from its first session record, the model from its last change."""
    v = table.select("rec_id", "file_name", F.coalesce("line_no", F.lit(0)).alias("line_no"), parse_line(F.col("record")).alias("v")).where(json_kind(F.col("v")) == "object")
    depth = F.try_variant_get("v", "$.rlmDepth", "variant")
    rows = v.select("file_name", F.struct("line_no", "rec_id").alias("at"), string_at(F.col("v"), "$.type").alias("kind"), string_at(F.col("v"), "$.id").alias("id"), F.when(F.schema_of_variant(depth) == "BIGINT", F.try_variant_get(depth, "$", "bigint")).alias("depth"), string_at(F.col("v"), "$.modelId").alias("model"))
    head = F.min(F.when((F.col("kind") == "session") & F.col("id").isNotNull(), F.struct("at", "id", "depth")))
    out = rows.groupBy("file_name").agg(head.alias("h"), F.max(F.when(F.col("model").isNotNull(), F.struct("at", "model")))["model"].alias("model"))
    return out.where(F.col("h").isNotNull()).select("file_name", F.col("h.id").alias("session_id"), (F.coalesce(F.col("h.depth"), F.lit(0)) > 0).alias("is_child"), "model")


def opencode_discovery(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, n_messages, latest_ms, fingerprint) of each session: two aggregates joined, a digest that tells changes."""
    counted = messages.where(F.col("session_id").isNotNull()).dropDuplicates(["id", "session_id"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("time_created").alias("latest_ms"))
    ids = sessions.where(F.col("id").isNotNull()).select(F.col("id").alias("session_id")).distinct()
    out = ids.join(counted, "session_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)))
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.col("n_messages").cast("string"), F.coalesce(F.col("latest_ms").cast("string"), F.lit("-"))), 256))


def source_class(path: Column, root: str) -> Column:
    """main, subagent or excluded, by where a file lies under the root: memory folders at depth 1 and tool results and workflows at depth 2 are left out."""
    base = root.rstrip("/") + "/"
    parts = F.split(F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path), "/")
    excluded = ((F.size(parts) > 2) & (F.get(parts, F.lit(1)) == "memory")) | ((F.size(parts) > 3) & F.get(parts, F.lit(2)).isin("tool-results", "workflows"))
    return F.when(excluded, "excluded").when(F.size(parts) > 2, "subagent").otherwise("main")
