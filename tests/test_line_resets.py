import json
import os

import pytest

from skein.sources import files


def change(path, how):
    if how == "rotated":
        other = path.with_suffix(".new")
        other.write_text("one\ntwo\nthree\n")
        os.replace(other, path)
        return ["one", "two", "three"]
    path.write_text("uno\ndue\ntre and more\n")
    return ["uno", "due", "tre and more"]


@pytest.mark.parametrize("how", ["rotated", "mutated"])
def test_stream_starts_again(tmp_path, how):
    path = tmp_path / "s.jsonl"
    path.write_text("one\ntwo\n")
    s = files._LineStream({"path": f"{tmp_path}/*.jsonl"})
    at = json.loads(json.dumps(s.read(s.initialOffset())[1]))
    want = change(path, how)
    assert files.detect_reset(str(path), at[str(path)]) == how
    got, end = s.read(at)
    assert [r[3] for r in got] == want and [r[3] for r in s.readBetweenOffsets(at, end)] == want
    with path.open("a") as f:
        f.write("last\n")
    got, after = s.read(end)
    assert [r[3] for r in got] == ["last"] and [r[3] for r in s.readBetweenOffsets(end, after)] == ["last"]
    assert [r[3] for r in s.read({str(path): 4})[0]] == [*want[1:], "last"]


@pytest.mark.parametrize("how", ["rotated", "mutated"])
def test_batch_starts_again(spark, tmp_path, how):
    files.register(spark)
    path = tmp_path / "b.jsonl"
    path.write_text("one\ntwo\n")
    read = lambda at: [r["value"] for r in spark.read.format("skein_lines").option("path", f"{tmp_path}/*.jsonl").option("offsets", json.dumps({str(path): at})).load().orderBy("start_byte").collect()]
    told = files.checkpoint(str(path), 4)
    assert read(told) == ["two"] and read(1000) == ["one", "two"]
    want = change(path, how)
    assert read(told) == want
