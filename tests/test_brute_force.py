"""Queries that SQL can't say, over whole tables against plain Python."""

import datetime as D
import json
import re
import zoneinfo
from decimal import Decimal

from skein.plans import registry

LETTERS = {"UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "AEDT": 660, "AEST": 600}


def loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def walk(value, path, out):
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{path}.{k}"
            if k == "file_path" and isinstance(v, str) and v:
                out.append(here)
            inner = loads(v) if k == "arguments" and isinstance(v, str) else None
            walk(inner if isinstance(inner, dict) else v, here, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", out)
    return out


def test_p3_found(spark, data, duck):
    want = []
    for i, text in duck.sql("SELECT rec_id, record FROM claude_records").fetchall():
        message = (loads(text) or {}).get("message")
        content = message.get("content") if isinstance(message, dict) else None
        for k, b in enumerate(content if isinstance(content, list) else []):
            if isinstance(b, dict) and b.get("type") == "tool_use":
                want += [("claude", i, k, p) for p in walk(b.get("input"), "$", [])]
    for i, text in duck.sql("SELECT rec_id, payload FROM codex_records").fetchall():
        o = loads(text) or {}
        if o.get("type") == "function_call":
            a = o.get("arguments")
            if isinstance(a, str):
                a = loads(a)
                a = a if isinstance(a, dict) else None
            want += [("codex", i, 0, p) for p in walk(a, "$", [])]
    got = [tuple(r) for r in registry.queries()["p3_found"](spark, data).collect()]
    assert sorted(got) == sorted(want) and want


def moment(s, zone):
    if re.fullmatch(r"\d+(\.\d+)?", s):
        x = Decimal(s)
        return next((int(x * 1000 // k) for k in (1, 1000, 10**6, 10**9) if 1577836800 * k <= x < 2051222400 * k), None)
    fraction = offset = None
    try:
        if m := re.fullmatch(r"(\d{4})-?(\d\d)-?(\d\d)[T ](\d\d):?(\d\d):?(\d\d)([.,]\d+)?\s*([A-Z]+|[+-]\d\d(?::?\d\d)?)?(\[.*\])?", s):
            wall, fraction, offset = D.datetime(*map(int, m.groups()[:6])), m[7], m[8]
        elif m := re.fullmatch(r"(\w{3}, \d\d \w{3} \d{4} \d\d:\d\d:\d\d) (\S+)", s):
            wall, offset = D.datetime.strptime(m[1], "%a, %d %b %Y %H:%M:%S"), m[2]
        else:
            wall = D.datetime.strptime(s, "%d-%b-%Y %I:%M:%S %p")
    except ValueError:
        return None
    if offset is None:
        shift = wall.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).utcoffset()
    elif offset == "Z" or offset in LETTERS:
        shift = D.timedelta(minutes=LETTERS.get(offset, 0))
    else:
        minutes = int(offset[1:3]) * 60 + int(offset[-2:] if len(offset) > 3 else 0)
        shift = D.timedelta(minutes=-minutes if offset[0] == "-" else minutes)
    seconds = int((wall - shift - D.datetime(1970, 1, 1)).total_seconds())
    return seconds * 1000 + (int((fraction[1:] + "000")[:3]) if fraction else 0)


def test_p7_found(spark, data, duck):
    zones = dict(duck.sql("SELECT host, tz_name FROM host_zones").fetchall())
    rows = [("codex", str(a), s, h) for a, s, h in duck.sql("SELECT rec_id, rec_timestamp, host FROM codex_records").fetchall()]
    rows += [("opencode", a, s, h) for a, s, h in duck.sql("SELECT id, time_created, host FROM oc_session").fetchall()]
    for a, text, h in duck.sql("SELECT rec_id, record, host FROM pi_records").fetchall():
        s = (loads(text) or {}).get("timestamp")
        rows.append(("pi", str(a), s if s is None or isinstance(s, str) else repr(s), h))
    want = {(r, k, moment(s.strip(), zones.get(h, "UTC"))) for r, k, s, h in rows if s is not None and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", s)}
    got = {tuple(r) for r in registry.queries()["p7_found"](spark, data).collect()}
    assert got == {w for w in want if w[2] is not None} and got


def texts_of(duck):
    rows = [("claude", i, t) for i, t in duck.sql("SELECT rec_id, record FROM claude_records").fetchall()]
    rows += [("codex", i, t) for i, t in duck.sql("SELECT rec_id, payload FROM codex_records").fetchall()]
    for runtime, i, text in rows:
        try:
            o = json.loads(text, parse_int=str, parse_float=str)
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            yield runtime, i, o


def scalar(v):
    return None if isinstance(v, (dict, list)) else {True: "true", False: "false"}[v] if isinstance(v, bool) else v


def held_by(runtime, o):
    holder = o if runtime == "codex" else o.get("message")
    return holder if isinstance(holder, dict) else {}


def listed(v):
    return v if isinstance(v, list) else []


def test_p3_records(spark, data, duck):
    want = []
    for runtime, i, o in texts_of(duck):
        m = held_by(runtime, o)
        top = {k: scalar(o.get(k)) for k in ("type", "subtype", "sessionId", "id", "uuid", "parentUuid", "cwd", "timestamp", "version", "model")}
        session, model = (top["id"], top["model"]) if runtime == "codex" else (top["sessionId"], scalar(m.get("model")))
        want.append((runtime, i, top["type"], top["subtype"], scalar(m.get("role")), session, top["uuid"], top["parentUuid"], top["cwd"], model, top["timestamp"], top["version"], len(listed(m.get("content")))))
    got = [tuple(r) for r in registry.queries()["p3_records"](spark, data).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_p3_blocks(spark, data, duck):
    want = []

    def add(runtime, i, no, path, parent, b):
        o = b if isinstance(b, dict) else {}
        text, inner, kind = o.get("text"), o.get("content"), o.get("type")
        shown = text if isinstance(text, str) else b if isinstance(b, str) else inner if isinstance(inner, str) else None
        want.append((runtime, i, no, path, parent, kind if isinstance(kind, str) else None, shown))
        for k, x in enumerate(listed(inner)):
            add(runtime, i, no, f"{path}[{k}]", path, x)

    for runtime, i, o in texts_of(duck):
        content = held_by(runtime, o).get("content")
        if isinstance(content, str):
            want.append((runtime, i, 0, "$", None, "text", content))
        for no, b in enumerate(listed(content)):
            add(runtime, i, no, f"$[{no}]", None, b)
    got = [tuple(r) for r in registry.queries()["p3_blocks"](spark, data).collect()]
    # Numbers as blocks or types look like texts here; there are none.
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def calls_of(duck):
    for runtime, i, o in texts_of(duck):
        if runtime == "codex" and o.get("type") in ("function_call", "custom_tool_call"):
            yield runtime, i, 0, o.get("call_id"), o.get("name"), o.get("arguments" if o["type"] == "function_call" else "input")
        if runtime == "claude":
            for no, b in enumerate(listed(held_by(runtime, o).get("content"))):
                if isinstance(b, dict) and b.get("type") == "tool_use":
                    yield runtime, i, no, b.get("id"), b.get("name"), b.get("input")


def test_p3_calls(spark, data, duck):
    def row(runtime, i, no, call, name, arguments, count):
        return runtime, i, no, call, name, count, json.dumps(arguments, sort_keys=True)

    def again(text):
        return json.loads(text, parse_int=str, parse_float=str)

    want = [row(r, i, no, scalar(c), scalar(n), a, len(a) if isinstance(a, dict) else None) for r, i, no, c, n, a in calls_of(duck)]
    got = []
    for r in registry.queries()["p3_calls"](spark, data).collect():
        a = r["arguments"]
        got.append(row(*r[:5], again(a) if a and a[0] in "{[" and r["n_arguments"] is not None else a, r["n_arguments"]))
    assert sorted(got, key=repr) == sorted(want, key=repr) and want


def test_shell_census(spark, data, duck):
    from collections import Counter

    from skein.functions.code import programs

    want = Counter()
    for runtime, _, _, _, _, a in calls_of(duck):
        o = loads(a) if isinstance(a, str) else a
        command = o.get("command") if isinstance(o, dict) else None
        want.update((runtime, p) for p in programs(command if isinstance(command, str) else None))
    got = {(r["runtime"], r["program"]): r["n"] for r in registry.queries()["shell_census"](spark, data).collect()}
    assert got == dict(want) and got


def json_type(v):
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "number"


def drifting(duck):
    """(runtime, rec_id, file, kind, fields) of every record that is a JSON object."""
    rows = [("claude", i, f, t, None) for i, f, t in duck.sql("SELECT rec_id, file_name, record FROM claude_records").fetchall()]
    rows += [("codex", i, f, t, k) for i, f, t, k in duck.sql("SELECT rec_id, file_name, payload, rec_type FROM codex_records").fetchall()]
    rows += [("pi", i, f, t, None) for i, f, t in duck.sql("SELECT rec_id, file_name, record FROM pi_records").fetchall()]
    for runtime, i, f, t, fallback in rows:
        o = loads(t)
        if isinstance(o, dict):
            fields = {k: v for k, v in o.items() if v is not None}
            if runtime != "codex" and isinstance(o.get("message"), dict):
                fields |= {f"message.{k}": v for k, v in o["message"].items() if v is not None}
            yield runtime, i, f, o["type"] if o.get("type") is not None else fallback, fields


def test_p6_table(spark, data, duck):
    from skein.operators.drift import column_name

    allowed = set(duck.sql("SELECT runtime, rec_kind, field_path, json_type FROM schema_fields").fetchall())
    paths = sorted({a[2] for a in allowed})
    want = {}
    for runtime, i, f, kind, fields in drifting(duck):
        fit = {p for p, v in fields.items() if (runtime, kind, p, json_type(v)) in allowed}
        want[runtime, i] = f, kind, fit, set(fields) - fit
    for name, approved in (("p6_table", set()), ("p6_promoted", {"timestamp", "branch"})):
        rows = registry.queries()[name](spark, data).collect()
        assert len(rows) == len(want) and {(r["runtime"], r["rec_id"]) for r in rows} == set(want)
        for r in rows:
            f, kind, fit, rest = want[r["runtime"], r["rec_id"]]
            assert (r["file_name"], r["rec_kind"]) == (f, kind)
            assert set(json.loads(r["_rescued"] or "{}")) == rest - approved
            assert {p for p in paths if r[column_name(p)] is not None} == (fit | rest & approved) & set(paths)
            assert all(r[column_name(p)] is not None for p in rest & approved)


def test_p7_moments(spark, data):
    every = registry.queries()["p7_moments"](spark, data).collect()
    found = {tuple(r) for r in registry.queries()["p7_found"](spark, data).collect()}
    plain = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ")
    assert {(r["runtime"], r["row_key"], r["epoch_ms"]) for r in every if r["epoch_ms"] is not None and not plain.fullmatch(r["raw"])} == found
    for r in every:
        assert (r["moment"] is None) == (r["epoch_ms"] is None)
        if r["epoch_ms"] is not None:
            assert r["moment"] == D.datetime(1970, 1, 1) + D.timedelta(milliseconds=r["epoch_ms"])
            if plain.fullmatch(r["raw"]):
                assert r["moment"] == D.datetime.strptime(r["raw"], "%Y-%m-%dT%H:%M:%SZ")


def test_excerpts(spark, data, duck):
    from tests.test_excerpt import QUERY, slow_excerpt

    want = {i: slow_excerpt(t, QUERY, 400, 40) for i, t in duck.sql("SELECT doc_id, text FROM documents WHERE length(text) > 0").fetchall()}
    assert {r["id"]: r["excerpt"] for r in registry.queries()["excerpt_phrase_window"](spark, data).collect()} == want


def test_titles(spark, data, duck):
    def title(text):
        out = re.sub(r"<([a-zA-Z][\w-]*)\b[^>]*>.*?</\1>", " ", text[:2000], flags=re.S | re.A)
        out = re.sub(r"</?[a-zA-Z][\w-]*\b[^>]*>", " ", out, flags=re.A)
        out = re.sub(r"\x1b\[[0-9;]*[A-Za-z]", "", out)
        out = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", out)
        out = re.sub(r"\s+", " ", out, flags=re.A).strip(" ")
        return out if len(out) <= 100 else out[:97] + "..."

    want = {i: title(t) for i, t in duck.sql("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()}
    assert {r["id"]: r["title"] for r in registry.queries()["normalize_title"](spark, data).collect()} == want
