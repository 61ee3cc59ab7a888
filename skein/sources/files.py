"""Python data sources: line files read from byte offsets, and SQLite tables read in ranges of rowid.

Both stand for stores that Spark has no reader for: a line source that knows where it stopped and leaves a torn last
line unread, and a database file without a driver on the classpath.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MAX_LINE_BYTES = 8 << 20
#: Bytes of the head and the tail of what was read whose digests tell a file that was rewritten in place.
WINDOW = 4096


def _digest(f, start: int, end: int) -> str:
    f.seek(start)
    return hashlib.sha256(f.read(end - start)).hexdigest() if end > start else ""


def _state(f, offset: int, resets: int = 0) -> dict:
    info = os.fstat(f.fileno())
    return {"offset": offset, "dev": info.st_dev, "inode": info.st_ino, "head": _digest(f, 0, min(offset, WINDOW)), "tail": _digest(f, max(0, offset - WINDOW), offset), "resets": resets}


def checkpoint(path: str, offset: int) -> dict:
    """The state of a file read up to `offset`, to be given as its offset later."""
    with open(path, "rb") as f:
        return _state(f, offset)


def _told(state: dict | int) -> dict:
    return state if isinstance(state, dict) else {"offset": int(state)}


def _reset(f, state: dict) -> str | None:
    """truncated, rotated (another file) or mutated (rewritten in place) since `state`; a bare offset tells only the first."""
    offset = state["offset"]
    if offset <= 0:
        return None
    if os.fstat(f.fileno()).st_size < offset:
        return "truncated"
    if "inode" not in state:
        return None
    now = _state(f, offset)
    if any(now[k] != state[k] for k in ("dev", "inode")):
        return "rotated"
    return "mutated" if any(now[k] != state[k] for k in ("head", "tail")) else None


def detect_reset(path: str, state: dict | int) -> str | None:
    with open(path, "rb") as f:
        return _reset(f, _told(state))


def scan_from(path: str, start: int, max_line: int = MAX_LINE_BYTES, budget: int | None = None):
    """(start, end, text) of the complete lines from a byte offset; text is None for a line longer than `max_line`, which is
    passed over without being held. Stops after `budget` bytes, at the end of a line."""
    with open(path, "rb") as f:
        yield from _scan(f, start, max_line, budget)


def _scan(f, start: int, max_line: int = MAX_LINE_BYTES, budget: int | None = None):
    f.seek(start)
    at = start
    while budget is None or at - start < budget:
        head = f.readline(max_line + 1)
        if not head:
            return
        size, oversized = len(head), False
        while not head.endswith(b"\n"):
            head = f.readline(1 << 20)
            if not head:
                return  # torn: no line feed yet
            size += len(head)
            oversized = True
        if not oversized:
            text = head.rstrip(b"\r\n").decode("utf-8", "replace")
        yield at, at + size, None if oversized else text
        at += size


class _Part(InputPartition):
    def __init__(self, **values):
        super().__init__(None)
        self.values = values


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        offsets = json.loads(self.options.get("offsets", "{}"))
        return [_Part(path=p, state=offsets.get(p, 0)) for p in sorted(glob.glob(self.options["path"], recursive=True))] or [_Part(path=None, state=0)]

    def read(self, partition):
        path = partition.values["path"]
        if path:
            state = _told(partition.values["state"])
            with open(path, "rb") as f:
                for a, b, text in _scan(f, 0 if _reset(f, state) else state["offset"], int(self.options.get("maxlinebytes", MAX_LINE_BYTES))):
                    yield path, a, b, text


class _LineStream(SimpleDataSourceStreamReader):
    """Offsets are {path: state}: bytes read, device, inode, digests of head and tail, resets so far. A file that became
    shorter, is another one or was rewritten in place is read from its start again. Bare numbers are taken as offsets."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self):
        return {}

    def read(self, start):
        done, rows = dict(start), []
        budget = int(self.options.get("maxbytespertrigger", 32 << 20))
        for path in sorted(glob.glob(self.options["path"], recursive=True)):
            state = _told(done.get(path, 0))
            with open(path, "rb") as f:
                again = _reset(f, state) is not None
                at = 0 if again else state["offset"]
                for a, b, text in _scan(f, at, budget=budget):
                    rows.append((path, a, b, text))
                    at, budget = b, budget - (b - a)
                done[path] = _state(f, at, state.get("resets", 0) + again)
            if budget <= 0:
                break
        return iter(rows), done

    def readBetweenOffsets(self, start, end):
        rows = []
        for path, state in end.items():
            first, last = _told(start.get(path, 0)), _told(state)
            stop = last["offset"]
            at = 0 if stop < first["offset"] or last.get("resets", 0) != first.get("resets", 0) else first["offset"]
            if stop > at:
                with open(path, "rb") as f:
                    # What was read is gone after a further reset; the next read starts over.
                    if not _reset(f, last):
                        rows += [(path, a, b, t) for a, b, t in _scan(f, at, budget=stop - at) if b <= stop]
        return iter(rows)


class LineSource(DataSource):
    """spark.read.format("skein_lines").option("path", glob).option("offsets", json of {path: byte or checkpoint(path, byte)})."""

    @classmethod
    def name(cls):
        return "skein_lines"

    def schema(self):
        return "path string, start_byte bigint, end_byte bigint, value string"

    def reader(self, schema):
        return _LineReader(self.options)

    def simpleStreamReader(self, schema):
        return _LineStream(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.options, self.columns = options, columns

    def _connect(self):
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self):
        name, parts = self.options["dbtable"].replace('"', ""), int(self.options.get("numpartitions", 8))
        with self._connect() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
        if low is None:
            return [_Part(low=0, high=0)]
        step = max(1, -(-(high - low + 1) // parts))
        return [_Part(low=a, high=min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        name = self.options["dbtable"].replace('"', "")
        columns = ", ".join('"' + c.replace('"', "") + '"' for c in self.columns)
        with self._connect() as c:
            yield from c.execute(f'SELECT {columns} FROM "{name}" WHERE rowid >= ? AND rowid < ?', (partition.values["low"], partition.values["high"]))


class SqliteSource(DataSource):
    """spark.read.format("skein_sqlite").schema(...).option("path", file).option("dbtable", table)."""

    @classmethod
    def name(cls):
        return "skein_sqlite"

    def reader(self, schema):
        return _SqliteReader(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineSource)
    spark.dataSource.register(SqliteSource)


def load_qrels(lines):
    """lines(value) of judgements in three or four columns as (query_id, id, grade); a header is passed over."""
    from pyspark.sql import functions as F

    parts = F.split(F.btrim("value", F.lit(" \t\r\n")), r"[\t ]+")
    n = F.size(parts)
    grade = F.element_at(parts, -1).try_cast("int")
    rows = lines.select(F.get(parts, F.lit(0)).alias("query_id"), F.get(parts, n - 2).alias("id"), grade.alias("grade"), n.alias("_n"))
    return rows.where(F.col("_n").isin(3, 4) & F.col("grade").isNotNull()).drop("_n")
