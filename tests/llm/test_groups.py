import datetime as D
import itertools
import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skein.llm import p5_conversations as P5
from skein.llm.conversations import Feed, _Slices, ordered_turns, replay, verdicts
from skein.llm.grouped_split import SHARES, grouped_split, pick, plan_split, ranked_within
from skein.llm.packing import Plan, pack, pieces, token_counts

# ---- splits


@pytest.mark.parametrize("seed", range(40))
def test_pick_is_closest(seed):
    r = random.Random(seed)
    sizes = {r.randint(1, 9): r.randint(1, 4) for _ in range(r.randint(1, 4))}
    flat = [s for s, c in sizes.items() for _ in range(c)]
    target = r.randint(0, sum(flat))
    sums = {0}
    for x in flat:
        sums |= {y + x for y in sums}
    got = pick(sizes, target)
    assert all(got[s] <= sizes[s] for s in got)
    assert sum(s * c for s, c in got.items()) == min(sums, key=lambda y: (abs(y - target), y))


def test_split_keeps_groups(spark):
    r = random.Random(3)
    pairs = [(f"q{i}", f"e{r.randrange(400)}" if i % 3 else "hot" if i < 100 else None) for i in range(600)] + [("q1", "e1"), ("q1", "e1"), (None, "hot")]
    out = grouped_split(spark.createDataFrame(pairs, "item string, tie string")).collect()
    assert len(out) == 600 and {r["split"] for r in out} <= set(SHARES)
    by = {}
    for x in out:
        by.setdefault(x["component"], set()).add(x["split"])
    assert all(len(s) == 1 for s in by.values())
    share = {k: sum(x["split"] == k for x in out) / 600 for k in SHARES}
    assert all(abs(share[k] - SHARES[k]) < 0.02 for k in SHARES), share
    assert grouped_split(spark.createDataFrame([], "item string, tie string")).count() == 0


def test_split_of_many_groups_in_bounded_memory():
    """Twelve million items in groups of heavy-tailed sizes, one of a third of all: the totals are met with small bitsets."""
    r, sizes, total = random.Random(1), {}, 0
    while total < 12_000_000:
        s = min(4_000_000, int(r.paretovariate(0.9)))
        sizes[s] = sizes.get(s, 0) + 1
        total += s
    tracemalloc.start()
    plan = plan_split(sizes, SHARES)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert all(sum(c for _, c in plan[s]) == sizes[s] for s in sizes)
    got = {k: sum(s * c for s, p in plan.items() for n, c in p if n == k) for k in SHARES}
    assert all(abs(got[k] - SHARES[k] * total) <= 2 for k in SHARES), got


@pytest.mark.parametrize("seed", range(30))
def test_splits_are_close_together(seed):
    r = random.Random(seed)
    flat = [r.randint(1, 12) for _ in range(r.randint(1, 7))]
    sizes = {s: flat.count(s) for s in flat}
    total = sum(flat)
    targets = {k: round(v * total) for k, v in SHARES.items()}

    def off(made):
        return sum(abs(made[k] - targets[k]) for k in ("validation", "test"))

    best = min(off({k: sum(s for s, at in zip(flat, where) if at == k) for k in SHARES}) for where in itertools.product(SHARES, repeat=len(flat)))
    plan = plan_split(sizes, SHARES)
    assert off({k: sum(s * c for s, p in plan.items() for n, c in p if n == k) for k in SHARES}) == best


def test_large_groups_are_placed_before_the_bitsets():
    sizes = {1000: 50, 7: 400, 1: 300}
    plan = plan_split(sizes, SHARES, max_bits=2000)
    got = {k: sum(s * c for s, p in plan.items() for n, c in p if n == k) for k in SHARES}
    total = sum(s * c for s, c in sizes.items())
    assert all(abs(got[k] - SHARES[k] * total) <= 1 for k in SHARES), got


def test_rank_in_hot_key(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 450, F.lit(None)).otherwise("b").alias("k"), F.concat(F.lit("x"), "id").alias("name"), F.lit(1).alias("_key"))
    out = ranked_within(df, "k", "name", rows_a_bucket=70).collect()
    for k, n in (("hot", 400), (None, 50), ("b", 50)):
        assert sorted(r["rank_no"] for r in out if r["k"] == k) == list(range(n))


# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    capacity = 256
    lengths = [min(capacity, max(0, int(r.lognormvariate(4, 1)))) if seed else r.choice([90, 100, 60]) for _ in range(4000)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = Plan(histogram, capacity)
    seen, load = {n: 0 for n in histogram}, np.zeros(plan.n_sequences + 1, np.int64)
    for n, a, b, sequence, each in plan.ranges:
        assert a == seen[n] and b > a
        seen[n] = b
        for k in range(b - a):
            load[sequence + k // max(each, 1)] += n
    assert seen == histogram and load.max() <= capacity
    least = -(-sum(lengths) // capacity)
    assert plan.n_sequences <= 1.06 * least + 2


def test_pack_rows(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([0, 1, 50, 100, 101, 250, 100, 33, 67, 0])] + [(3, 100)], "doc_id bigint, n_tokens bigint")
    out = pack(counts, 100).collect()
    load = {}
    for x in out:
        load[x["sequence_id"]] = load.get(x["sequence_id"], 0) + x["n_tokens"]
    assert max(load.values()) <= 100 and len(out) == 11 + 1 + 2
    assert sorted(x["n_tokens"] for x in out if x["doc_id"] == 5) == [50, 100, 100]
    assert sorted(x["start_token"] for x in out if x["doc_id"] == 5) == [0, 100, 200]
    assert pack(counts.limit(0), 100).count() == 0
    empty = pack(spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, 90).otherwise(0).cast("bigint").alias("n_tokens")), 100).where("n_tokens = 0").groupBy("sequence_id").count().collect()
    assert len(empty) == 20 and all(r["count"] == 49 for r in empty)
    assert pieces(counts, 1000).count() == 11


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "x" * 200_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got[1] in (2, 3) and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1


# ---- conversations

T0 = D.datetime(2025, 1, 1)


def record(i, session, role, minute, text="hi", uid=None, parent=None, meta=None, kind=None):
    o = {"type": kind or role.strip().lower(), "sessionId": session, "uuid": uid or f"{session}-{i}", "parentUuid": parent, "timestamp": (T0 + D.timedelta(minutes=minute)).isoformat() + "Z", "message": {"role": role, "content": text}}
    if meta is not None:
        o["isMeta"] = meta
    return (i, T0 + D.timedelta(minutes=i), json.dumps(o))


CLAUDE = [
    record(1, "good", "user", 0),
    record(2, "good", " ASSISTANT", 1, [{"type": "text", "text": "a"}], parent="good-1"),
    record(40, "good", "assistant", 900),
    record(3, "good", "user", 800),  # out of order, another slice
    record(2, "good", "assistant", 1, "a", uid="good-2"),  # written twice
    record(5, "good", "user", 950, meta="true"),
    record(6, "headless", "assistant", 0),
    record(7, "unanswered", "user", 0),
    record(8, "unanswered", "assistant", 1),
    record(9, "unanswered", "user", 2),
    record(10, "twice", "user", 0),
    record(11, "twice", "user", 800),
    record(12, "twice", "assistant", 900),
    record(13, "lost", "user", 0, parent="nowhere"),
    record(14, "lost", "assistant", 1),
    record(15, "blank", "user", 0, " \n"),
    record(16, "title", "system", 0, kind="custom-title"),
    (17, T0, '{"type": "user", "sessionId": "cut'),
    (18, T0, None),
]


def claude(spark):
    return spark.createDataFrame(CLAUDE, "rec_id bigint, ingested_at timestamp_ntz, record string")


WANT = {"good": None, "headless": "headless", "unanswered": "unanswered", "twice": "unanswered", "lost": "broken", "blank": "empty", "title": "empty"}


@pytest.mark.parametrize("batches", [1, 4])
def test_conversations(spark, batches):
    # With four pieces and short timeouts everything out of order arrives late, with closing in between.
    units = replay(P5.claude_messages(claude(spark)).drop("text"), batches=batches, delay="1 second", timeout_ms=1)
    got = {r["session_id"]: r["reason"] for r in verdicts(units).collect()}
    assert got == WANT


def messages(spark, *records):
    return P5.claude_messages(spark.createDataFrame(list(records), "rec_id bigint, ingested_at timestamp_ntz, record string")).drop("text")


def told(units, session):
    r = verdicts(units).where(F.col("session_id") == session).first()
    return r["n_turns"], r["n_stray"], r["reason"]


def test_late_row_revises_a_closed_slice(spark):
    feed = Feed(spark, delay="1 second", timeout_ms=60_000)
    feed.send(messages(spark, record(1, "s", "user", 0), record(2, "s", "user", 10)))
    assert feed.emitted().count() == 0
    feed.send(messages(spark, record(900, "other", "user", 900)))
    first = feed.emitted().collect()
    assert [(r["session_id"], r["revision"], r["n"], r["broken"]) for r in first] == [("s", 1, 2, True)]
    # Fifteen hours late, older than the watermark; and a copy, which changes nothing.
    feed.send(messages(spark, record(3, "s", "assistant", 5), record(1, "s", "user", 0)))
    feed.send(messages(spark, record(1, "s", "user", 0)))
    assert sorted((r["revision"], r["n"], r["broken"]) for r in feed.emitted().collect()) == [(1, 2, True), (2, 3, False)]
    feed.send(messages(spark, record(4, "s", "assistant", 11)))
    units = feed.end()
    assert told(units, "s") == (4, 0, None) and told(units, "other") == (1, 0, "unanswered")


def test_row_after_the_state_is_gone(spark):
    feed = Feed(spark, delay="1 second", timeout_ms=60_000, retain_ms=60_000)
    feed.send(messages(spark, record(1, "s", "user", 0), record(2, "s", "assistant", 1)))
    feed.send(messages(spark, record(600, "other", "user", 600)))
    feed.send(messages(spark, record(900, "other", "assistant", 900)))
    feed.send(messages(spark, record(3, "s", "user", 2), record(4, "s", "assistant", 3)))
    units = feed.end()
    assert sorted((r["kind"], r["n"]) for r in units.where("session_id = 's'").collect()) == [("slice", 2), ("stray", 2)]
    assert told(units, "s") == (2, 2, None)


class Asked:
    """A handle of state that writes down what a slice asks of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append(("register", at))

    def deleteTimer(self, at):
        self.calls.append(("delete", at))

    def getCurrentWatermarkInMs(self):
        return self.now

    def said(self, rows=None, now=0):
        """What a slice of a timeout of 100 says to facts, or to its timer, and the calls it makes for that."""
        self.calls, self.now = [], now
        slices = _Slices(100, None)
        slices.init(self)
        key = (json.dumps(["r", "s", "0"]),)
        out = slices.handleExpiredTimer(key, self, None) if rows is None else slices.handleInputRows(key, (Row(fact=json.dumps(r)) for r in rows), self)
        return [json.loads(r.said)["revision"] for r in out], self.calls


def test_calls_of_a_slice():
    # Each is a request to Spark's state server, so their number is the cost of a slice.
    slice_ = Asked()
    one, two = ["a", None, "user", "5", "1", "5"], ["b", None, "assistant", "9", "2", "9"]
    assert slice_.said([one]) == ([], ["get", ("register", 105), "update"])
    assert slice_.said([one]) == ([], ["get"])
    assert slice_.said([two, one]) == ([], ["get", ("delete", 105), ("register", 109), "update"])
    assert slice_.said(now=109) == ([1], ["get", "update"])
    assert slice_.said([two], now=200) == ([], ["get"])
    assert slice_.said([["c", None, "user", "7", "3", "7"]], now=200) == ([2], ["get", "update"])
    ticks = _Slices(100, None)
    ticks.init(slice_)
    slice_.calls = []
    assert list(ticks.handleInputRows(("tick0",), iter(()), slice_)) == slice_.calls == []


def test_wrong_clock_closes_nothing(spark):
    i, arrived, text = record(2, "wrong", "user", 0)
    future = text.replace("2025-01-01T00:00:00", "2099-01-01T00:00:00")
    feed = Feed(spark, delay="1 second", timeout_ms=600_000)
    feed.send(messages(spark, record(1, "s", "user", 0), (i, arrived, future)))
    feed.send(messages(spark, record(3, "s", "assistant", 1)))
    assert feed.emitted().count() == 0
    assert told(feed.end(), "s") == (2, 0, None)


def test_turns_without_time_and_empty_tables(spark):
    rows = [("r", "s", f"u{i}", None, "user" if i % 2 == 0 else "assistant", None, i, T0) for i in range(20_000)] + [("r", None, "x", None, "user", 1, 1, T0)]
    df = spark.createDataFrame(rows, "runtime string, session_id string, uid string, parent string, role string, ts bigint, seq bigint, arrived timestamp")
    units = replay(df, batches=2)
    assert told(units, "s") == (20_000, 0, None) and units.where("session_id = 's'").select("part").distinct().count() == 5
    assert verdicts(replay(df.limit(0)), df.limit(1).select("runtime", "session_id")).select("reason").first()[0] == "empty"


def test_turns_in_order(spark):
    kept = verdicts(replay(P5.claude_messages(claude(spark)).drop("text"), batches=1))
    turns = P5.claude_messages(claude(spark)).where("role IS NOT NULL")
    out = ordered_turns(turns, kept).orderBy("turn_no").collect()
    assert [(r["session_id"], r["turn_no"], r["role"]) for r in out] == [("good", 0, "user"), ("good", 1, "assistant"), ("good", 2, "user"), ("good", 3, "assistant")]


def test_opencode_rows(spark):
    rows = [("a", "s", '{"role":"User","content":"x","time":{"created":5}}', None), ("b", "s", "not json", 7), ("c", None, "{}", 1), ("d", "s", '{"role":"tool","content":"x"}', 8), (None, "s", None, None)]
    df = spark.createDataFrame(rows, "id string, session_id string, data string, time_created bigint")
    got = {r["uid"]: (r["role"], r["ts"]) for r in P5.opencode_messages(df).collect()}
    assert got == {"a": ("user", 5), "b": (None, 7), "c": (None, 1), "d": (None, 8), None: (None, None)}
    assert P5.opencode_messages(df.limit(0)).count() == 0 and F is not None
