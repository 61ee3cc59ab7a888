import json

from skein.operators.nested import SCHEMAS, flatten
from tests.util import rows


def records(spark, *items):
    return spark.createDataFrame([(r, i, t) for i, (r, t) in enumerate(items)], "runtime string, rec_id bigint, record string")


def call(arguments, kind="function_call"):
    return "codex", json.dumps({"type": kind, "name": "edit", "call_id": "c1", "arguments": arguments})


def claude(content, **extra):
    return "claude", json.dumps({"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": content}} | extra)


def test_files(spark):
    df = records(
        spark,
        call({"file_path": "a.py", "edits": [{"file_path": "b.py"}, {"file_path": ""}, {"file_path": 5}]}),
        call(json.dumps({"batch": [{"arguments": json.dumps({"file_path": "c.py"})}, {"note": json.dumps({"file_path": "no"})}]})),
        call({"file_path": "skipped"}, "custom_tool_call"),
        call('{"file_path": "cut'),
        call('["x"]'),
        call(None),
        claude([{"type": "text", "text": "x"}, {"type": "tool_use", "input": {"o": {"file_path": "d.py"}}}, {"type": "tool_result", "content": [{"type": "tool_use", "input": {"file_path": "inner"}}]}]),
        ("claude", None),
        ("claude", ""),
        ("claude", "not json"),
        ("claude", "[1]"),
    )
    assert rows(flatten(df, "files")) == [
        ("claude", 6, 1, "$.o.file_path", "d.py"),
        ("codex", 0, 0, "$.edits[0].file_path", "b.py"),
        ("codex", 0, 0, "$.file_path", "a.py"),
        ("codex", 1, 0, "$.batch[0].arguments.file_path", "c.py"),
    ]


def test_linked_tables(spark):
    df = records(spark, claude([{"type": "tool_result", "content": [{"type": "text", "text": "in"}]}, {"type": "tool_use", "id": "t", "name": "read", "input": {"a": 1, "b": 2}}], uuid="u"), claude("plain"))
    assert rows(flatten(df, "blocks"), "rec_id", "block_no", "block_path", "parent_path", "block_type", "text") == [
        (0, 0, "$[0]", None, "tool_result", None),
        (0, 0, "$[0][0]", "$[0]", "text", "in"),
        (0, 1, "$[1]", None, "tool_use", None),
        (1, 0, "$", None, "text", "plain"),
    ]
    assert rows(flatten(df, "calls"), "rec_id", "block_no", "call_id", "tool_name", "n_arguments") == [(0, 1, "t", "read", 2)]
    assert rows(flatten(df, "records"), "rec_id", "role", "uuid", "n_blocks") == [(0, "assistant", "u", 2), (1, "assistant", None, 0)]


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "runtime string, rec_id bigint, record string, block_no string, text int")
    for t in SCHEMAS:
        assert flatten(empty, t).count() == 0
    long = records(spark, claude([{"type": "text", "text": "x" * 3_000_000}]))
    assert len(flatten(long, "blocks").first()["text"]) == 3_000_000


def test_repeated_rows_stay(spark):
    df = records(spark, call({"file_path": "a"}), call({"file_path": "a"}))
    assert flatten(df, "files").count() == 2
