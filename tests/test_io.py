import json
import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import api, sinks
from skein.functions import text as T
from skein.operators import vector
from skein.sources import files, transcripts
from skein.streaming.operators import file_stream, once_only, rolling_counts, run_to_end, upsert_stream
from tests.util import rows


def test_line_source(spark, tmp_path):
    files.register(spark)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b'{"a":1}\n\n' + b"x" * 50 + b"\nlast\r\ntorn")
    df = spark.read.format("skein_lines").option("path", f"{tmp_path}/*.jsonl").option("maxLineBytes", 20).load()
    assert [(r["start_byte"], r["end_byte"], r["value"]) for r in df.orderBy("start_byte").collect()] == [(0, 8, '{"a":1}'), (8, 9, ""), (9, 60, None), (60, 66, "last")]
    again = spark.read.format("skein_lines").option("path", f"{tmp_path}/*.jsonl").option("offsets", json.dumps({str(path): 60})).load()
    assert [r["value"] for r in again.collect()] == ["last"]


def test_line_stream_reads_on_and_resets(tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("one\ntwo\nthr")
    s = files._LineStream({"path": f"{tmp_path}/*.jsonl"})
    got, at = s.read(s.initialOffset())
    assert [r[3] for r in got] == ["one", "two"]
    path.write_text("one\ntwo\nthree\n")
    got, end = s.read(at)
    assert [r[3] for r in got] == ["three"] and [r[3] for r in s.readBetweenOffsets(at, end)] == ["three"]
    path.write_text("new\n")
    assert [r[3] for r in s.read(end)[0]] == ["new"]


def test_sqlite_source(spark, tmp_path):
    files.register(spark)
    db = f"{tmp_path}/x.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE message (id TEXT, n INTEGER)")
        c.executemany("INSERT INTO message VALUES (?, ?)", [(f"m{i}", i if i % 3 else None) for i in range(25)])
        c.execute("CREATE TABLE empty (id TEXT)")
    df = spark.read.format("skein_sqlite").schema("id string, n bigint").option("path", db).option("dbtable", "message").option("numPartitions", 4).load()
    assert rows(df) == sorted(((f"m{i}", i if i % 3 else None) for i in range(25)), key=repr)
    assert spark.read.format("skein_sqlite").schema("id string").option("path", db).option("dbtable", "empty").load().count() == 0


def test_snapshots_and_exports(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.publish(base, root) == "gen-1"
    assert sinks.upsert_snapshot(spark.createDataFrame([(2, "c")], "id int, v string"), root, ["id"]) == "gen-2"
    assert rows(sinks.current(spark, root)) == [(1, "a"), (2, "c")]
    out = f"file://{tmp_path}/corpus"
    told = sinks.export_corpus(spark.createDataFrame([(1, "t", "x")], "doc_id bigint, title string, text string"), out)
    assert sinks.verify_manifest(spark, f"{out}/corpus", told) == []
    assert sinks.verify_manifest(spark, f"{out}/corpus", told | {"gone.json": "0"}) == ["gone.json"]
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, body string")
    written = docs.where("k = 'a'").select("k", F.sha2("body", 256).alias("digest"))
    assert rows(sinks.changed_documents(docs, written, "k"), "k") == [("b",)]


def test_size_batches(spark):
    items = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise("b").alias("dest"), "id", (F.col("id") % 7 + 1).alias("bytes"))
    out = sinks.size_batches(items, "dest", "id", "bytes", 10, lanes=3).collect()
    assert len(out) == 300
    loads = {}
    for r in out:
        k = (r["dest"], r["lane"], r["batch_no"])
        loads[k] = loads.get(k, 0) + r["bytes"]
    assert max(loads.values()) <= 10


def test_notes_and_cursors(tmp_path):
    p = f"{tmp_path}/notes-1.jsonl"
    assert [sinks.append_note(p, "t", "b", "s", "2025-01-01T00:00:00Z") for _ in range(3)] == ["s:ep:0", "s:ep:1", "s:ep:2"]
    assert os.path.getsize(p) > 0
    c = sinks.page_cursor("orders", 50, "d", "k")
    assert sinks.redeem_cursor(c, "orders", "d", "k") == 50
    with pytest.raises(ValueError):
        sinks.redeem_cursor(c, "orders", "other", "k")


def test_search_surface(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = api.search(docs, "the lock is held", 3, {"lang": "en"}, "n_chars > 100").collect()
    assert len(out) == 3 and out[0]["score"] >= out[1]["score"] and out[0]["omitted"] == out[0]["total_matches"] - 3
    with pytest.raises(api.InvalidPredicate):
        api.filtered(docs, None, "no_such_column = 1")
    with pytest.raises(api.InvalidPredicate):
        api.filtered(docs, None, "n_chars >")
    with pytest.raises(api.NotReady):
        api.search(docs.limit(0), "x")
    assert api.filtered(docs, None, "strpos(text, 'lock') > 0").count() == docs.where("instr(text, 'lock') > 0").count()
    assert api.clamp_limit(1000) == 50 and api.clamp_limit(0) == 1
    assert api.status(docs).first()["n_documents"] == docs.count() and api.show(docs, 1).count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("<b>Hi</b> \u001b[31mred\u001b[0m  x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.normalized_title(F.col("t"))).collect()] == ["red x", None, ""]
    n = spark.createDataFrame([(-7,), (7,)], "n bigint")
    assert rows(n.select(T.floor_div(F.col("n"), 4).alias("f"), T.ceil_div(F.col("n"), 4).alias("c"))) == [(-2, -1), (1, 2)]
    p = spark.createDataFrame([("/a/b/c/",), ("c",)], "p string")
    assert [r[0] for r in p.select(T.path_tail(F.col("p"))).collect()] == ["b/c", "c"]
    s = spark.createDataFrame([("/r/p/s.jsonl",), ("/r/p/memory/x.jsonl",), ("/r/p/s/tool-results/x.txt",), ("/r/p/s/agent-1.jsonl",)], "p string")
    assert [r[0] for r in s.select(transcripts.source_class(F.col("p"), "/r")).collect()] == ["main", "excluded", "excluded", "subagent"]
    e = spark.createDataFrame([("word " * 200 + "needle" + " word" * 200,)], "t string").select(T.excerpt(F.col("t"), "needle")).first()[0]
    assert "needle" in e and e.startswith("...") and e.endswith("...") and len(e) <= 406


def test_vectors(spark):
    r = np.random.default_rng(1)
    chunks = spark.createDataFrame([(i, r.normal(size=(3, 4)).tolist()) for i in range(20)] + [(99, []), (100, [[0.0] * 4])], "id bigint, matrix array<array<double>>")
    q = chunks.where("id < 2").select(F.col("id").alias("query_id"), "matrix")
    held = {x["id"]: vector._unit_rows(np.array(x["matrix"])) for x in chunks.collect() if x["matrix"]}
    slow = {(k, i): (held[k] @ m.T).max(axis=1).sum() for k in (0, 1) for i, m in held.items()}
    for block_bytes in (None, 100):  # all queries at once, and each in a block of its own
        fast = {(x["query_id"], x["id"]): x["score"] for x in vector.maxsim(chunks, q, block_bytes).collect()}
        assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in slow)
        top = vector.maxsim_top(chunks.repartition(3), q, 4, block_bytes=block_bytes).collect()
        for k in (0, 1):
            want = sorted((-round(v, 9), i) for (a, i), v in slow.items() if a == k)[:4]
            assert [(r["id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == k] == [(i, n + 1) for n, (_, i) in enumerate(want)]
    pairs = spark.createDataFrame([(0, 3), (1, 3), (1, 5), (7, 5)], "query_id bigint, id bigint").join(chunks, "id")
    got = {(x["query_id"], x["id"]): x["score"] for x in vector.maxsim_pairs(pairs, q, 100).collect()}
    assert got.keys() == {(0, 3), (1, 3), (1, 5)} and all(v == pytest.approx(slow[k]) for k, v in got.items())
    same = chunks.where("id = 3").select(F.explode(F.sequence(F.lit(50), F.lit(30), F.lit(-1))).alias("id"), "matrix").withColumn("id", F.col("id").cast("bigint"))
    assert [r["id"] for r in vector.maxsim_top(same, q.where("query_id = 0"), 3).orderBy("rank").collect()] == [30, 31, 32]
    assert vector.maxsim_top(chunks.limit(0), q, 3).count() == vector.maxsim(chunks, q.limit(0)).count() == 0
    m = np.concatenate([np.ones((1, 4)), np.repeat(np.eye(4)[:2], 3, axis=0)])
    assert vector.pooled(m, 3).tolist() == [[1.0] * 4, [1.0, 0, 0, 0], [0, 1.0, 0, 0]]


def test_streams(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(f"file://{tmp_path}/in")
    s = file_stream(spark, f"file://{tmp_path}/in", 1)
    merged = upsert_stream(s, lambda old, new: (new if old is None else old.unionByName(new)).select(*new.columns))
    assert merged.count() == e.count()
    assert run_to_end(once_only(s, "ts", ["event_id"])).count() <= e.count()
    counts = rolling_counts(file_stream(spark, f"file://{tmp_path}/in"), "ts", "event_type")
    assert run_to_end(counts).count() >= 0


def test_coarse_index_recall(spark):
    from skein.plans.evidence import ivf_recall

    recall = [r["recall"] for r in ivf_recall(spark, "/root/testdata/sf0.1").collect()]
    assert len(recall) == 40 and sum(recall) / len(recall) >= 0.9


def test_shell_programs():
    from skein.functions.code import programs

    assert programs("cat a.py | head -5 && sudo make -j4; X=1 ls > out") == ["cat", "head", "make", "ls"]
    assert programs("echo $(git status) 'a | b'") == ["echo", "git"]
    assert programs("/usr/bin/env python x.py") == ["python"] and programs(None) == [] and programs("echo 'open") == ["echo"]


def test_python_functions(spark):
    from skein.functions.code import keyed_id, printable, shell_programs

    df = spark.createDataFrame([("a\u0007b",), (None,), ("ls",)], "t string")
    assert [r[0] for r in df.select(printable()(F.col("t"))).collect()] == ["a\\x07b", None, "ls"]
    ids = [r[0] for r in df.select(keyed_id("k")(F.col("t"))).collect()]
    assert ids[1] is None and len(ids[0]) == 24 and ids[0] != ids[2]
    assert [list(r[0]) for r in df.select(shell_programs()(F.col("t"))).collect()][2] == ["ls"]
