"""Sinks: versioned snapshots behind a pointer, documents rewritten only when they change, batches under a size, exports."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.tables import upsert


def publish(df: DataFrame, root: str) -> str:
    """Write a new immutable generation under `root` and move the pointer to it last; a reader sees the old or the new one.

    The number of a generation is taken by creating its mark, which only one of two writers can; the pointer is moved by a
    rename over the old one.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    numbers: list[int] = []
    if fs.exists(path(root)):
        numbers = [int(n[4:]) for n in (s.getPath().getName() for s in fs.listStatus(path(root))) if n.startswith("gen-") and n[4:].isdigit()]
    number = max(numbers, default=0) + 1
    while True:
        try:
            fs.create(path(f"{root}/.taken-{number}"), False).close()
            break
        except Py4JJavaError:
            if not fs.exists(path(f"{root}/.taken-{number}")):
                raise
            number += 1
    name = f"gen-{number}"
    df.write.parquet(f"{root}/{name}")
    out = fs.create(path(f"{root}/.current-{name}"), True)
    out.write(bytearray(name.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    files.rename(path(f"{root}/.current-{name}"), path(f"{root}/current"), options)
    return name


def current(spark, root: str) -> DataFrame:
    name = spark.read.text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/{name}")


def upsert_snapshot(fresh: DataFrame, root: str, keys: list[str]) -> str:
    """The current generation with `fresh` merged in, as the next one."""
    return publish(upsert(current(fresh.sparkSession, root), fresh, keys), root)


def changed_documents(docs: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """docs(key, body) whose digest differs from that in written(key, digest): all there is to write."""
    told = docs.withColumn("digest", F.sha2("body", 256))
    return told.join(written.select(key, "digest"), [key, "digest"], "left_anti")


def size_batches(items: DataFrame, key: str, order: str, size: str, limit: int, lanes: int = 16) -> DataFrame:
    """`items` with lane and batch_no: greedy batches in order of at most `limit` (an item over it alone), for each key and lane.

    A batch depends on the one before, so a key is cut into lanes by a hash of the order column, and a lane's rows stream
    through one task that holds three numbers.
    """
    rows = items.withColumn("lane", F.pmod(F.xxhash64(order), F.lit(lanes)).cast("int"))
    rows = rows.repartition(key, "lane").sortWithinPartitions(key, "lane", order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number, used = None, 0, 0
        for pdf in frames:
            numbers = []
            for k, lane, n in zip(pdf[key], pdf["lane"], pdf[size]):
                if (k, lane) != at:
                    at, number, used = (k, lane), 0, 0
                elif used + n > limit:
                    number, used = number + 1, 0
                used += n
                numbers.append(number)
            yield pdf.assign(batch_no=numbers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, batch_no bigint")


def append_note(path: str, title: str, body: str, session_id: str, at: str) -> str:
    """Append a note as a pair of user and assistant lines; its reference counts the pairs before."""
    before = 0
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = sum(1 for line in f if '"type": "user"' in line)
    pair = [{"type": "user", "sessionId": session_id, "timestamp": at, "message": {"role": "user", "content": title}}, {"type": "assistant", "sessionId": session_id, "timestamp": at, "message": {"role": "assistant", "content": body}}]
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(p, ensure_ascii=False) + "\n" for p in pair)
    return f"{session_id}:ep:{before}"


def export_corpus(docs: DataFrame, root: str) -> dict[str, str]:
    """docs(doc_id, title, text) as JSON lines, and the digest of each file written."""
    docs.select(F.col("doc_id").cast("string").alias("_id"), "title", "text").write.mode("overwrite").json(f"{root}/corpus")
    return manifest(docs.sparkSession, f"{root}/corpus")


def manifest(spark, folder: str) -> dict[str, str]:
    """{file name: sha256} of a folder's JSON files, digests made where the files are read."""
    rows = spark.read.format("binaryFile").load(f"{folder}/*.json").select("path", F.sha2("content", 256).alias("digest"))
    return {os.path.basename(r["path"]): r["digest"] for r in rows.toLocalIterator()}


def verify_manifest(spark, folder: str, expected: dict[str, str]) -> list[str]:
    """Names that are missing, new or changed."""
    found = manifest(spark, folder)
    return sorted({n for n in expected.keys() | found.keys() if expected.get(n) != found.get(n)})


def page_cursor(kind: str, offset: int, binding: str, secret: str) -> str:
    """A cursor that only fits its own selection."""
    body = f"{kind}|{offset}|{binding}"
    return f"{offset}.{hashlib.sha256(f'{secret}|{body}'.encode()).hexdigest()[:16]}"


def redeem_cursor(cursor: str, kind: str, binding: str, secret: str) -> int:
    offset = int(cursor.split(".")[0])
    if page_cursor(kind, offset, binding, secret) != cursor:
        raise ValueError("this cursor belongs to another selection")
    return offset
