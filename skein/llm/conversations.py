"""Conversations rebuilt from message rows with keyed streaming state.

The state is keyed by (runtime, session, time slice), so that one session of a third of all rows is many keys. A slice
buffers its turns and record ids; it closes when the event-time watermark has passed its last message by `timeout_ms`
and then emits what it says: number of turns, first and last role, an unanswered turn, references to records it doesn't
hold. The slices' rows add up to a verdict for each session.

Late arrivals: Spark drops rows older than the watermark in front of a state with event-time timers. Only rows with an
event time can be older, so facts come without one, and the times travel in rows of their own that do nothing but move
the watermark (one for each Arrow batch). A late fact thus always reaches its slice, which emits again with a higher
revision when it had closed before. The state stays as long as the stream, or `retain_ms` after closing; then
a mark with the revision is all that is left, and rows that come still later are emitted as `stray`, to be seen in
the verdict as `n_stray`: they are told, never lost silently.

Slices still open when a finite input ends are read from the state store and summarised by the same rule.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from skein.session import fresh_path, materialize

SLICE_MS = 6 * 3600 * 1000
TIMEOUT_MS, DELAY = 24 * 3600 * 1000, "1 hour"
#: The time of turns without any: they come last, in slices of this many by their order of arrival.
NO_TIME, SEQ_SLICE = 1 << 52, 4096
#: A message isn't written after its arrival: a stamp this much later is a wrong clock.
AHEAD_MS = 24 * 3600 * 1000
#: Micro-batches in which `replay` sends a table that is there already.
BATCHES = 3
#: A unit is one session's slice, its name the JSON list of runtime, session and slice; a fact the JSON list of uid, parent, role, ts,
#: seq and clock. Spark hands every value to Python by itself, which costs more than reading a few lists.
FACTS = "unit string, fact string, clock_ms bigint"
STATE = "held string, open boolean"
EMITTED = "kind string, runtime string, session_id string, part bigint, revision bigint, n bigint, first_role string, last_role string, broken boolean, lost array<string>, own array<string>"
_TICK = "tick"
# Fixed value: the key by which Spark marks a column of event time.
_DELAY_MARK = "spark.watermarkDelayMs"
_FIELDS = [c.split()[0] for c in EMITTED.split(", ")]
_KEY = ["runtime", "session_id", "part"]
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _part(ts: Column, seq: Column, slice_ms: int) -> Column:
    late = F.lit(NO_TIME // slice_ms) + F.floor(F.coalesce(seq, F.lit(0)) / SEQ_SLICE)
    return F.coalesce(F.floor(ts / slice_ms), late).cast("bigint")


def facts_of(messages: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """Facts of messages(runtime, session_id, uid, parent, role, ts, seq, arrived); `role` is null for what is no turn.

    A message without uid is a message of its own. Rows without a session are left out. The clock of a message is its time,
    or its arrival where it has none or one more than AHEAD_MS after it, so that a wrong stamp can't close everything.
    """
    held = messages.where(F.col("session_id").isNotNull())
    own = F.coalesce("uid", F.concat(F.lit("\u0001"), F.col("seq").cast("string")))
    arrived = F.unix_millis(F.coalesce("arrived", F.current_timestamp()))
    clock = F.when(F.col("ts").between(0, arrived + AHEAD_MS), F.col("ts")).otherwise(F.unix_millis("arrived"))
    unit = F.to_json(F.array("runtime", "session_id", _part(F.col("ts"), F.col("seq"), slice_ms).cast("string")))
    texts = [own, "parent", "role", F.coalesce("ts", F.lit(NO_TIME)).cast("string"), F.coalesce("seq", F.lit(0)).cast("string"), clock.cast("string")]
    return held.select(unit.alias("unit"), F.to_json(F.array(*texts)).alias("fact"), clock.alias("clock_ms"))


def _with_ticks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts without event time, and after each batch a row of no unit that carries the latest."""
    schema = pa.schema([("unit", pa.string()), ("fact", pa.string()), ("clock", pa.timestamp("us", "UTC"))])
    for batch in batches:
        if not batch.num_rows:
            continue
        yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("fact"), pa.nulls(batch.num_rows, schema.field("clock").type)], schema=schema)
        last = pc.max(batch.column("clock_ms")).as_py()
        if last is not None:
            tick = f"{_TICK}{TaskContext.get().partitionId()}"
            yield pa.RecordBatch.from_pydict({"unit": [tick], "fact": [None], "clock": [last * 1000]}, schema=schema)


def summary(ids, roles, times, seqs, parents) -> tuple:
    """(n, first role, last role, broken, lost, own) of one slice: its turns by (time, arrival), whether a user's turn is followed
    by another's, parents that are none of its records, its records."""
    turns = sorted((t, s, i, r) for i, r, t, s in zip(ids, roles, times, seqs) if r is not None)
    order = [r for *_, r in turns]
    broken = any(a == b == "user" for a, b in zip(order, order[1:]))
    held = set(ids)
    return len(order), order[0] if order else None, order[-1] if order else None, broken, [p for p in parents if p not in held], [i for i in ids if not i.startswith("\u0001")]


def merge(held: dict, facts: list[str]) -> bool:
    """Put facts into what a slice holds; whether they changed it. Copies of a record are one: the first to arrive that is a
    turn tells role and time."""
    turns, parents, changed = held["turns"], held["parents"], False
    for fact in facts:
        uid, parent, role, ts, seq, clock = json.loads(fact)
        new = [role, int(ts), int(seq)]
        old = turns.get(uid)
        if old is None or (role is not None and (old[0] is None or new[2] < old[2])):
            changed |= old != new
            turns[uid] = new
        if parent is not None and parent not in parents:
            parents[parent] = 1
            changed = True
        held["last"] = max(held["last"], int(clock or 0))
    return changed


def _said(kind: str, unit: str, held: dict) -> str:
    """The JSON of one emitted row."""
    runtime, session_id, part = json.loads(unit)
    if kind == "stray":
        row = (held["strays"], None, None, None, [], [])
    else:
        turns = held["turns"]
        row = summary(list(turns), *(list(x) for x in zip(*turns.values())), list(held["parents"]))
    return json.dumps(dict(zip(_FIELDS, (kind, runtime, session_id, int(part), held["revision"], *row))))


_NEW = {"turns": {}, "parents": {}, "last": 0, "revision": 0, "strays": 0, "gone": False, "timer": None}


class _Slices(StatefulProcessor):
    """One slice a key: its state is a value of its own, its timer the event time at which it closes or is given up."""

    def __init__(self, timeout_ms: int, retain_ms: int | None):
        self.timeout_ms, self.retain_ms = timeout_ms, retain_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("slice", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (unit,) = key
        if unit.startswith(_TICK):  # rows that only move the watermark
            return iter(())
        held, open_ = self._held()
        changed, strays = False, 0
        if held["gone"]:
            strays = sum(1 for _ in rows)
        else:
            changed = merge(held, [row.fact for row in rows])
        return self._keep(unit, held, open_ or changed, strays, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, open_ = self._held()
        held["timer"] = None  # Spark drops the one that fired
        return self._keep(key[0], held, open_, 0, timerValues.getCurrentWatermarkInMs())

    def _held(self) -> tuple[dict, bool]:
        self.value = self.state.get()
        text, open_ = self.value or (None, False)
        return json.loads(text) if text else copy.deepcopy(_NEW), open_

    def _keep(self, unit: str, held: dict, open_: bool, strays: int, now: int) -> Iterator[Row]:
        due = held["last"] + self.timeout_ms
        said = None
        if strays:
            held["strays"] += strays
            held["revision"] += 1
            said = _said("stray", unit, held)
        elif open_ and due <= now:
            held["revision"] += 1
            open_ = False
            said = _said("slice", unit, held)
        if not held["gone"] and not open_ and self.retain_ms is not None and due + self.retain_ms <= now:
            held.update(turns={}, parents={}, gone=True)
        later = due if open_ else None if held["gone"] or self.retain_ms is None else due + self.retain_ms
        timer = None if later is None else max(later, now + 1)
        if timer != held["timer"]:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
            held["timer"] = timer
        value = (json.dumps(held), open_)
        if value != self.value:
            self.state.update(value)
        return iter(() if said is None else (Row(said=said),))


def stream_units(messages: DataFrame, delay: str = DELAY, slice_ms: int = SLICE_MS, timeout_ms: int = TIMEOUT_MS, retain_ms: int | None = None) -> DataFrame:
    """The streaming operator: what the slices of a stream of messages say, emitted when the watermark closes them."""
    return _units_of_facts(facts_of(messages, slice_ms), delay, timeout_ms, retain_ms)


def _units_of_facts(facts: DataFrame, delay: str, timeout_ms: int, retain_ms: int | None) -> DataFrame:
    ticked = facts.mapInArrow(_with_ticks, "unit string, fact string, clock timestamp").withWatermark("clock", delay)
    # The watermark is taken; a time with a zone would cost more to hand over than all the rest, so its number goes on, still
    # marked as the column of event time.
    mark = ticked.schema["clock"].metadata or {_DELAY_MARK: int(pd.Timedelta(delay).total_seconds() * 1000)}
    ticked = ticked.select("unit", "fact", F.col("clock").cast("bigint").alias("clock", metadata=mark))
    said = ticked.groupBy("unit").transformWithState(_Slices(timeout_ms, retain_ms), "said string", "Append", "EventTime")
    return said.select(F.from_json("said", EMITTED).alias("s")).select("s.*")


def open_units(spark, checkpoint: str) -> DataFrame:
    """What the slices that are open in the state store of a stopped stream would say."""
    held = spark.read.format("statestore").option("stateVarName", "slice").load(checkpoint).select("key.unit", "value.*").where("open").select("unit", "held")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for unit, text in zip(pdf["unit"], pdf["held"]):
                told = json.loads(text)
                told["revision"] += 1
                out.append(_said("slice", unit, told))
            yield pd.DataFrame({"said": out}, dtype=object)

    return held.mapInPandas(run, "said string").select(F.from_json("said", EMITTED).alias("s")).select("s.*")


class Feed:
    """A running stream of facts that is given its input piece by piece, each a micro-batch at least."""

    def __init__(self, spark, slice_ms: int = SLICE_MS, delay: str = DELAY, timeout_ms: int = TIMEOUT_MS, retain_ms: int | None = None):
        self.spark, self.slice_ms = spark, slice_ms
        self.base = fresh_path(spark, "stream")
        spark.createDataFrame([], FACTS).write.parquet(f"{self.base}/facts")
        before = {k: spark.conf.get(k, None) for k in _ROCKS}
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        try:
            facts = spark.readStream.schema(FACTS).parquet(f"{self.base}/facts")
            units = _units_of_facts(facts, delay, timeout_ms, retain_ms)
            self.query = units.writeStream.format("parquet").option("path", f"{self.base}/units").option("checkpointLocation", f"{self.base}/state").outputMode("append").start()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def send(self, messages: DataFrame) -> None:
        self.send_facts(facts_of(messages, self.slice_ms))

    def send_facts(self, facts: DataFrame) -> None:
        facts.write.mode("append").parquet(f"{self.base}/facts")
        self.query.processAllAvailable()

    def emitted(self) -> DataFrame:
        return self.spark.read.schema(EMITTED).parquet(f"{self.base}/units")

    def end(self) -> DataFrame:
        """All that was emitted and what is still open."""
        self.query.processAllAvailable()
        self.query.stop()
        return self.emitted().unionByName(materialize(open_units(self.spark, f"{self.base}/state"), "open"))


def replay(messages: DataFrame, batches: int = BATCHES, slice_ms: int = SLICE_MS, **settings) -> DataFrame:
    """The emitted rows of a table of messages, sent through the stream in order of arrival in `batches` pieces.

    What arrives in a later piece than its slice closed in is late, and revises it.
    """
    spark = messages.sparkSession
    when = F.coalesce(F.unix_millis("arrived"), F.col("ts"), F.lit(0))
    # Filtered when it is read: before, the filter would parse the lines again to find their session.
    table = materialize(messages.withColumn("_when", when), "messages").where(F.col("session_id").isNotNull())
    cuts = table.agg(F.percentile_approx("_when", [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    bounds = [None, *(cuts or []), None]
    feed = Feed(spark, slice_ms, **settings)
    for low, high in zip(bounds, bounds[1:]):
        part = table
        if low is not None:
            part = part.where(F.col("_when") > low)
        if high is not None:
            part = part.where(F.col("_when") <= high)
        feed.send(part)
    return feed.end()


def verdicts(units: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(runtime, session_id, n_turns, n_lost, n_stray, kept, reason) of emitted rows: the highest revision of each slice counts.

    A session is kept if it has turns, the first is the user's, each user's turn is followed at once by an
    assistant's, and every reference is to one of its records. Slices of a session follow each other in time. Sessions of
    `known`(runtime, session_id) without any record are empty. `n_stray` counts rows that came when the state was gone;
    they are in no other column.
    """
    flat = units.where("kind = 'slice'").groupBy(*_KEY).agg(F.max_by(F.struct("n", "first_role", "last_role", "broken", "lost", "own"), "revision").alias("u")).select(*_KEY, "u.*")
    flat = materialize(flat, "slices")
    by_time = Window.partitionBy("runtime", "session_id").orderBy("part")
    turns = flat.where("n > 0").withColumn("_before", F.lag("last_role").over(by_time))
    turns = turns.withColumn("broken", F.col("broken") | ((F.col("_before") == "user") & (F.col("first_role") == "user")))
    # References that no record of the slice answers are looked up among the session's other slices.
    asked = flat.select("runtime", "session_id", F.explode("lost").alias("id")).distinct()
    own = flat.join(asked.select("runtime", "session_id").distinct(), ["runtime", "session_id"], "left_semi").select("runtime", "session_id", F.explode("own").alias("id"))
    lost = asked.join(own, ["runtime", "session_id", "id"], "left_anti").select("runtime", "session_id", F.lit(1).alias("n_lost"))
    row = flat.select("runtime", "session_id").unionByName(lost, allowMissingColumns=True)
    strays = units.where("kind = 'stray'").groupBy(*_KEY).agg(F.max("n").alias("n_stray")).select("runtime", "session_id", "n_stray")
    row = row.unionByName(strays, allowMissingColumns=True)
    row = row.unionByName(turns.select("runtime", "session_id", F.col("n").alias("n_turns"), F.struct("part", "first_role").alias("first"), F.struct("part", "last_role").alias("last"), "broken"), allowMissingColumns=True)
    if known is not None:
        row = row.unionByName(known.where(F.col("session_id").isNotNull()).select("runtime", "session_id"), allowMissingColumns=True)
    zero = F.lit(0)
    sums = [F.coalesce(F.sum(c), zero).cast("bigint").alias(c) for c in ("n_turns", "n_lost", "n_stray")]
    told = row.groupBy("runtime", "session_id").agg(*sums, F.min("first")["first_role"].alias("first_role"), F.max("last")["last_role"].alias("last_role"), F.max("broken").alias("broken"))
    reason = (
        F.when(F.col("n_turns") == 0, "empty")
        .when(F.col("n_lost") > 0, "broken")
        .when(F.col("first_role") != "user", "headless")
        .when(F.col("broken") | (F.col("last_role") == "user"), "unanswered")
    )
    return told.select("runtime", "session_id", "n_turns", "n_lost", "n_stray", reason.isNull().alias("kept"), reason.alias("reason"))


def ordered_turns(turns: DataFrame, told: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """(runtime, session_id, turn_no, role, ts, text) of the kept sessions' turns(runtime, session_id, uid, role, ts, seq, text).

    Turns are numbered inside slices and the numbers of the slices before are added, so that no task orders a whole
    session of a third of all rows.
    """
    kept = told.where("kept").select("runtime", "session_id")
    own = F.coalesce("uid", F.concat(F.lit("\u0001"), F.col("seq").cast("string")))
    first = Window.partitionBy("runtime", "session_id", "_own").orderBy("seq")
    rows = turns.join(kept, ["runtime", "session_id"], "left_semi").withColumn("_own", own).withColumn("_copy", F.row_number().over(first)).where("_copy = 1")
    rows = materialize(rows.withColumn("_part", _part(F.col("ts"), F.col("seq"), slice_ms)).withColumn("ts", F.coalesce("ts", F.lit(NO_TIME))).drop("_own", "_copy"), "turns")
    sizes = rows.groupBy("runtime", "session_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("runtime", "session_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("runtime", "session_id", "_part").orderBy("ts", "seq")) - 1
    out = rows.withColumn("_in", inside).join(starts, ["runtime", "session_id", "_part"])
    return out.select("runtime", "session_id", (F.col("_before") + F.col("_in")).cast("bigint").alias("turn_no"), "role", F.when(F.col("ts") < NO_TIME, F.col("ts")).alias("ts"), "text")
