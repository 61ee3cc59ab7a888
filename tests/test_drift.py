import json

from skein.operators.drift import TargetSchema, drift_report, ingest, parse_records, promote
from tests.util import rows

SCHEMA = TargetSchema(
    [
        {"runtime": "claude", "rec_kind": "user", "field_path": p, "json_type": t, "is_required": r}
        for p, t, r in (("type", "string", True), ("version", "string", True), ("n", "number", False), ("message", "object", False), ("message.role", "string", True))
    ]
    + [{"runtime": None, "rec_kind": "x", "field_path": "y", "json_type": "string", "is_required": None}]
)


def parsed(spark, *texts, file="f"):
    rows_ = [("claude", i, file, t, None, True) for i, t in enumerate(texts)]
    return parse_records(spark.createDataFrame(rows_, "runtime string, rec_id bigint, file_name string, text string, fallback_kind string, has_message boolean"))


def test_report(spark):
    p = parsed(
        spark,
        json.dumps({"type": "user", "version": 2, "extra": 1, "message": {"role": "u", "model": "m"}}),
        json.dumps({"type": "user", "version": None, "n": 5}),
        json.dumps({"type": "odd", "a": 1}),
        '{"type": "user", "cut',
        '{"type": "user"} {"type": "b"}',
        "[1]",
        None,
        "",
    )
    assert rows(drift_report(p, SCHEMA)) == sorted(
        [("claude", "f", "user", "version", "retyped"), ("claude", "f", "user", "extra", "added"), ("claude", "f", "user", "message.model", "added"), ("claude", "f", "odd", "type", "new_kind")], key=repr
    )
    gone = parsed(spark, json.dumps({"type": "user", "version": "1"}))
    assert rows(drift_report(gone, SCHEMA)) == [("claude", "f", "user", "message.role", "removed")]


def test_ingest_and_promote(spark):
    p = parsed(spark, json.dumps({"type": "user", "version": 2, "extra": "7", "n": 1.5}), json.dumps({"type": "user", "extra": {"a": 1}}))
    t = ingest(p, SCHEMA)
    assert rows(t, "rec_id", "version", "n") == [(0, None, 1.5), (1, None, None)]
    assert json.loads(t.where("rec_id = 0").first()["_rescued"]) == {"version": "2", "extra": '"7"'}
    done = promote(t, {"extra": "bigint", "version": "string"})
    assert rows(done, "rec_id", "extra", "version") == [(0, 7, "2"), (1, None, None)]
    assert [r["_rescued"] for r in done.orderBy("rec_id").collect()] == [None, '{"extra":"{\\"a\\":1}"}']


def test_empty_and_repeats(spark):
    assert drift_report(parsed(spark).limit(0), SCHEMA).count() == 0
    line = json.dumps({"type": "user", "version": "1", "message": {"role": "u"}})
    assert drift_report(parsed(spark, line, line), SCHEMA).count() == 0
    assert ingest(parsed(spark, line, line), SCHEMA).count() == 2
    twice = parsed(spark, '{"type":"user","version":"1","version":2,"message":{"role":"u"}}')
    assert rows(drift_report(twice, SCHEMA), "field_path", "change_kind") == [("version", "retyped")]
