"""Interval, matching and aggregation queries over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import intervals as I
from skein.operators.ordered import exact_percentiles, last_before, next_after, running_sum, time_bucket
from skein.session import table

DAY_MS = 86_400_000
BOUNDS_US = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 30_000_000)
GAP_CAP_MS = 300_000


def _millis(ts):
    return F.call_function("div", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts), F.lit(1000))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumns({"ms": _millis(F.col("ts")), "k": F.get_json_object("props", "$.k").cast("bigint")})


def _spans(spark, d, where: str = "true") -> DataFrame:
    return _events(spark, d).where(where).select("user_id", F.col("ms").alias("lo"), (F.col("ms") + F.floor(F.col("value") * 1000)).alias("hi"))


def interval_union_length(spark, d):
    return I.union_length(_spans(spark, d), ["user_id"], DAY_MS)


def work_vs_elapsed(spark, d):
    """Work adds up what each user covers, elapsed time is what all cover together."""
    rows = _spans(spark, d)
    work = I.union_length(rows, ["user_id"], DAY_MS).agg(F.sum("length").alias("work_ms"))
    elapsed = I.union_length(rows, [], DAY_MS).withColumnRenamed("length", "elapsed_ms")
    return work.crossJoin(F.broadcast(elapsed))  # one row each


def interval_subtract(spark, d):
    base, hole = _spans(spark, d, "event_type = 'view'"), _spans(spark, d, "event_type = 'click'")
    return I.lengths(base, hole, ["user_id"], DAY_MS)


def capped_gap(spark, d):
    """Gaps of up to five minutes as they are, longer ones as five minutes; fewer than two stamps count one invalid."""
    rows = last_before(_events(spark, d), "user_id", ["ts", "event_id"], {"prev": F.col("ms")})
    gap = F.col("ms") - F.col("prev")
    out = rows.groupBy("user_id").agg(F.coalesce(F.sum(F.least(gap, F.lit(GAP_CAP_MS))), F.lit(0)).alias("known_ms"), F.count(gap).alias("n_gaps"), F.when(F.count(F.lit(1)) < 2, 1).otherwise(F.count_if(gap < 0)).cast("bigint").alias("n_invalid"))
    return out.withColumn("total_ms", F.when(F.col("n_invalid") == 0, F.col("known_ms")))


def asof_backward(spark, d):
    """The last click of the user before each purchase."""
    rows = last_before(_events(spark, d), "user_id", ["ts", "event_id"], {"click_id": F.when(F.col("event_type") == "click", F.col("event_id"))})
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def asof_forward(spark, d):
    """The first error after each view and before the user's next signup."""
    is_error = F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))
    is_turn = F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))
    rows = next_after(_events(spark, d), "user_id", ["ts", "event_id"], {"error": is_error, "turn": is_turn})
    inside = F.col("turn").isNull() | (F.col("error") < F.col("turn"))
    return rows.where("event_type = 'view'").select("event_id", F.when(inside, F.col("error.event_id")).alias("error_id"), F.col("turn.event_id").alias("turn_end_id"))


def _reconcile(spark, d):
    """Purchases meet the user's clicks from five seconds before to three hundred after."""
    e = _events(spark, d)
    executions = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("execution_id"), (F.col("ms") - 300_000).alias("lo"), (F.col("ms") + 5_000).alias("hi"))
    requests = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("request_id"), F.col("ms").alias("at"))
    return executions, I.band_join(requests, executions, ["user_id"], 60_000)


def band_join_reconcile(spark, d):
    return _reconcile(spark, d)[1].select("execution_id", "request_id")


def attribution_classes(spark, d):
    """A pair of one execution and one request is theirs; a request several want, or an execution with several, is ambiguous."""
    executions, pairs = _reconcile(spark, d)
    by_request = pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_executions"))
    told = pairs.join(by_request, "request_id").groupBy("execution_id").agg(F.count(F.lit(1)).alias("n_requests"), F.max("n_executions").alias("n_rivals"), F.min("request_id").alias("request_id"))
    out = executions.select("execution_id").join(told, "execution_id", "left")
    state = F.when(F.col("n_requests").isNull(), "unattributed").when((F.col("n_requests") == 1) & (F.col("n_rivals") == 1), "inferred_unique").otherwise("ambiguous")
    return out.select("execution_id", state.alias("state"), F.when(state == "inferred_unique", F.col("request_id")).alias("request_id"))


def request_owners(spark, d):
    """Each request with the executions that want it."""
    pairs = _reconcile(spark, d)[1]
    return pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_executions"), F.min("execution_id").alias("first_execution"), F.max("execution_id").alias("last_execution"))


def call_result_pairing(spark, d):
    """A call (click) and its result (error) share user and k; pairs that aren't one to one are dropped."""
    e = _events(spark, d)
    calls, results = (e.where(F.col("event_type") == t).select("user_id", "k", F.col("event_id").alias(n)) for t, n in (("click", "call_id"), ("error", "result_id")))
    one_call = calls.groupBy("user_id", "k").agg(F.min("call_id").alias("call_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    one_result = results.groupBy("user_id", "k").agg(F.min("result_id").alias("result_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return one_call.join(one_result, ["user_id", "k"])


def _journal(spark, d):
    """A journal with repeated and contradicting rows: every event, again every fifth, every seventh with another value."""
    e = _events(spark, d).select((F.col("event_id") % 3000).alias("execution_id"), F.when(F.col("k") % 3 == 0, "started").when(F.col("k") % 3 == 1, "completed").otherwise("rendered").alias("phase"), "ms", "value")
    again = e.where("ms % 5 = 0")
    other = e.where("ms % 7 = 0").withColumn("value", F.col("value") + 1)
    return e.unionByName(again).unionByName(other).withColumn("digest", F.md5(F.concat_ws("|", F.col("ms").cast("string"), F.round(F.col("value") * 1000).cast("bigint").cast("string"))))


def journal_dedupe(spark, d):
    """Of the rows of one execution and phase the smallest digest holds; several digests are a conflict."""
    return _journal(spark, d).groupBy("execution_id", "phase").agg(F.min("digest").alias("digest"), (F.min("digest") != F.max("digest")).alias("conflict"))


def phase_fold(spark, d):
    """Three phases folded into one fact; a phase with a conflict keeps the smallest digest's row."""
    def of(phase):
        return F.min(F.when(F.col("phase") == phase, F.struct("digest", "ms")))["ms"]

    out = _journal(spark, d).groupBy("execution_id").agg(of("started").alias("started_ms"), of("completed").alias("completed_ms"), of("rendered").alias("rendered_ms"))
    return out.withColumn("elapsed_ms", F.when(F.col("completed_ms") >= F.col("started_ms"), F.col("completed_ms") - F.col("started_ms")))


def live_counters(spark, d):
    """Counts by operation, outcome and parity of the user; an event counts once."""
    e = _events(spark, d).dropDuplicates(["event_id"])
    kind = F.when(F.col("event_type") == "view", "show").when(F.col("event_type").isin("click", "signup"), "search").otherwise("note")
    return e.groupBy(kind.alias("operation"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"), (F.col("user_id") % 2).alias("transport")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


def latency_histogram(spark, d):
    """Cumulative counts under nine bounds and above, bounds included."""
    us = F.floor(F.col("value") * 1000)
    e = _events(spark, d).withColumn("us", us)
    bounds = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"c{b}").alias("n")) for b in BOUNDS_US], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    counts = e.groupBy("event_type").agg(*[F.count_if(F.col("us") <= b).alias(f"c{b}") for b in BOUNDS_US], F.count("us").alias("total"))
    return counts.select("event_type", F.explode(bounds).alias("b")).select("event_type", "b.le", "b.n")


def rolling_windows(spark, d):
    """24 hours, 7 days, 30 days and lifetime up to the latest event, both ends included: a row counts in several."""
    e = _events(spark, d)
    now = e.agg(F.max("ms").alias("now"))
    age = F.col("now") - F.col("ms")
    spans = F.array(*[F.when(age <= days * DAY_MS, name) for name, days in (("24h", 1), ("7d", 7), ("30d", 30))], F.lit("lifetime"))
    rows = e.crossJoin(F.broadcast(now)).select("event_type", "value", F.explode(F.array_compact(spans)).alias("span"))  # one row
    return rows.groupBy("span", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def seal_days(spark, d):
    """Events by UTC day, sealed eight days later as of the latest one."""
    e = _events(spark, d).withColumn("day", F.to_date("ts"))
    now = e.agg(F.max("day").alias("today"))
    rows = e.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("missing"), F.sum("k").alias("k"))
    return rows.crossJoin(F.broadcast(now)).select(F.col("day").cast("string").alias("day"), "n", "known", "missing", "k", F.when(F.date_add("day", 8) <= F.col("today"), "sealed").otherwise("provisional").alias("state"))


def null_aware_sum(spark, d):
    """Sums that say what they miss: the total is null when a value is unknown, never too small."""
    e = _events(spark, d).withColumn("bytes", F.when(F.col("k") % 4 != 0, F.col("k"))).withColumn("why", F.when(F.col("k") == 0, "zero").when(F.col("k") % 4 == 0, "withheld"))
    out = e.groupBy("event_type").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("known"), F.count("bytes").alias("n_known"), F.count_if(F.col("bytes").isNull()).alias("n_missing"), F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))
    return out.withColumn("total", F.when(F.col("n_missing") == 0, F.col("known")))


def summarize_observations(spark, d):
    e = _events(spark, d)
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("view", "click", "purchase", "signup", "error")], F.max("ts").alias("latest"))


def enum_counts(spark, d):
    """Counts of all kinds there are to be, also of those that don't occur."""
    kinds = spark.createDataFrame([(t,) for t in ("view", "click", "purchase", "signup", "error", "refund")], "event_type string")
    n = _events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


def usage_normalization(spark, d):
    """Deltas of cumulative counters that start again after a reset (k = 0); of reports of one moment the larger wins."""
    e = _events(spark, d)
    first = e.groupBy("user_id", "ts").agg(F.max("k").alias("k"), F.max("event_id").alias("event_id"))
    reset = last_before(running_sum(first, "user_id", ["ts", "event_id"], F.when(F.col("k") == 0, 1).otherwise(0), "era"), "user_id", ["ts", "event_id"], {"prev": F.col("k"), "prev_era": F.col("era")})
    delta = F.when(F.col("prev").isNull() | (F.col("prev_era") != F.col("era")) | (F.col("k") < F.col("prev")), F.col("k")).otherwise(F.col("k") - F.col("prev"))
    return reset.groupBy("user_id").agg(F.sum(delta).alias("used"), F.count_if(F.col("k") < F.col("prev")).alias("n_resets"), F.max("era").alias("n_zero"))


def distinct_consecutive(spark, d):
    """Rows at which a user's kind of event changes."""
    rows = last_before(_events(spark, d), "user_id", ["ts", "event_id"], {"prev": F.col("event_type")})
    return rows.where(F.col("prev").isNull() | (F.col("prev") != F.col("event_type"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_changes"), F.max("event_id").alias("last_change"))


def _tariff(spark):
    rows = [("Brand#1%d" % i, "1992-01-01", "1995-01-01", 100 + i) for i in range(1, 6)] + [("Brand#1%d" % i, "1995-01-01", None, 200 + i) for i in range(1, 6)] + [("Brand#2%d" % i, "1994-06-01", None, 300 + i) for i in range(1, 6)]
    return spark.createDataFrame(rows, "brand string, day_from string, day_to string, price bigint").select("brand", F.to_date("day_from").alias("day_from"), F.to_date("day_to").alias("day_to"), "price")


def tariff_range_join(spark, d):
    """Quantities at the price of their day; days and brands without a price make the sum unknown."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey").select("brand", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("bigint").alias("q"))
    daily = lines.groupBy("brand", "day").agg(F.sum("q").alias("q"))
    t = F.broadcast(_tariff(spark))  # fifteen rows
    priced = daily.join(t, (daily["brand"] == t["brand"]) & (F.col("day") >= F.col("day_from")) & (F.col("day_to").isNull() | (F.col("day") < F.col("day_to"))), "left").select(daily["brand"], "q", "price")
    return priced.groupBy("brand").agg(F.sum("q").alias("quantity"), F.when(F.count("price") == F.count(F.lit(1)), F.sum(F.col("q") * F.col("price"))).alias("cost"), F.count_if(F.col("price").isNull()).alias("unpriced_days"))


def tariff_overlap_check(spark, d):
    """Pairs of price periods of one brand that overlap: each period against the next, as sorted periods overlap if neighbours do."""
    t = _tariff(spark).unionByName(spark.createDataFrame([("Brand#11", "1994-12-01", "1995-02-01", 9)], "brand string, day_from string, day_to string, price bigint").select("brand", F.to_date("day_from").alias("day_from"), F.to_date("day_to").alias("day_to"), "price"))
    w = Window.partitionBy("brand").orderBy("day_from", "price")
    reach = F.max(F.coalesce("day_to", F.to_date(F.lit("9999-12-31")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("_reach", reach).where(F.col("_reach") > F.col("day_from")).select("brand", F.col("day_from").cast("string").alias("day_from"), "price")


def _atoms(spark, d):
    rows = table(spark, d, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lo = F.col("l_linenumber").cast("bigint") * 100
    return rows.select(F.col("l_partkey").alias("source"), lo.alias("lo"), (lo + F.col("l_quantity").cast("bigint") * 10).alias("hi"), F.col("l_orderkey").alias("candidate"), tier.alias("tier"), F.to_date("l_shipdate").alias("day"))


def scenario_credit_nested(spark, d):
    """Coverage of sources in three nested scenarios: each adds a tier, none counts a stretch twice."""
    atoms = _atoms(spark, d)
    per = None
    for i, name in enumerate(("conservative", "central", "optimistic")):
        part = I.union_length(atoms.where(F.col("tier") <= i), ["source"], 100_000).agg(F.sum("length").alias("chars"))
        part = part.select(F.lit(name).alias("scenario"), "chars", T.floor_div(F.col("chars"), 4).alias("tokens"))
        per = part if per is None else per.unionByName(part)
    return per


def first_claim_credit(spark, d):
    """Each stretch of a source is credited once, to the candidate of the lowest tier, then earliest day, then id."""
    owned = I.first_claims(_atoms(spark, d), ["source"], 100_000, ["tier", "day", "candidate"])
    return owned.groupBy("candidate").agg(F.sum("length").alias("length"))


def rollup_bounds(spark, d):
    """Sums divided once after adding up, lower bounds rounded down and upper ones up, with a shift below zero."""
    o = table(spark, d, "orders").select("o_orderpriority", (F.round(F.col("o_totalprice") * 100).cast("bigint") - 15_000_000).alias("cents"))
    s = o.groupBy("o_orderpriority").agg(F.sum("cents").alias("raw"))
    return s.select("o_orderpriority", "raw", T.floor_div(F.col("raw"), 7000).alias("low"), T.ceil_div(F.col("raw"), 7000).alias("high"))


def debit_dedupe(spark, d):
    """Equal repeats collapse; contradicting amounts of one id are unknown."""
    e = _events(spark, d).select((F.col("event_id") % 2000).alias("debit_id"), (F.col("k") % 2).alias("amount"))
    out = e.groupBy("debit_id").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    return out.select("debit_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("amount"), (F.col("low") != F.col("high")).alias("conflict"))


def group_by_dimension(spark, d):
    """Orders by priority, status and year, and over all, in one pass."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("bigint").alias("year"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    sets = [("priority", F.col("o_orderpriority")), ("status", F.col("o_orderstatus")), ("year", F.col("year").cast("string")), ("all", F.lit("all"))]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("member")) for n, c in sets]))
    return o.select("cents", parts.alias("g")).groupBy("g.dimension", "g.member").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def cursor_page(spark, d):
    """The third page of fifty orders, by price falling, with a cursor bound to the selection."""
    top = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")).orderBy(F.col("cents").desc(), "o_orderkey").limit(150)
    w = Window.orderBy(F.col("cents").desc(), "o_orderkey")  # over the 150 rows of three pages
    cursor = F.substring(F.sha2(F.concat(F.lit("orders|"), F.col("position").cast("string")), 256), 1, 12)
    return top.withColumn("position", F.row_number().over(w).cast("bigint")).where("position > 100").withColumn("cursor", cursor)


def novelty_anti_join(spark, d):
    """Values of k that no earlier event of the user had."""
    first = _events(spark, d).groupBy("user_id", "k").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    return first.select("event_id", "user_id", "k")


def later_show_semi(spark, d):
    """Clicks whose k a later view of the same user has too."""
    e = _events(spark, d)
    shown = e.where("event_type = 'view'").groupBy("user_id", "k").agg(F.max("event_id").alias("_last"))
    return e.where("event_type = 'click'").join(shown, ["user_id", "k"]).where("_last > event_id").select("event_id", "user_id", "k")


def orphan_anti(spark, d):
    e = _events(spark, d)
    owned = band_join_reconcile(spark, d).select(F.col("request_id").alias("event_id"))
    return e.where("event_type = 'click'").join(owned, "event_id", "left_anti").select("event_id")


def exposure_day(spark, d):
    """The day of the user's nearest event with an even k at or before each event, else of the first after it."""
    good = F.when(F.col("k") % 2 == 0, F.to_date("ts"))
    rows = next_after(last_before(_events(spark, d), "user_id", ["ts", "event_id"], {"before": good}), "user_id", ["ts", "event_id"], {"after": good})
    return rows.select("event_id", F.coalesce(good, "before", "after").cast("string").alias("day"))


def retention_split(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("ms").alias("now"))
    kept = (F.col("now") - F.col("ms") <= 14 * DAY_MS).alias("kept")
    return e.crossJoin(F.broadcast(now)).groupBy(kept).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def percentiles(spark, d):
    shares = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    return exact_percentiles(_events(spark, d), "event_type", "value", shares).select("event_type", *[F.round(n, 6).alias(n) for n in shares])


def openmetrics_lines(spark, d):
    """Text exposition: a type line for each family and a line for each sample."""
    c = live_counters(spark, d)
    label = F.concat(F.lit('lookups_total{operation="'), F.col("operation"), F.lit('",outcome="'), F.col("outcome"), F.lit('",transport="'), F.col("transport").cast("string"), F.lit('"} '), F.col("n").cast("string"))
    return spark.createDataFrame([("# TYPE lookups counter",)], "line string").unionByName(c.select(label.alias("line")))


_E = """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, (props ->> '$.k')::BIGINT AS k FROM events)"""
_UNION = """,
s{n} AS (SELECT {k} lo, max(hi) AS hi FROM {t} WHERE lo < hi GROUP BY ALL),
i{n} AS (SELECT *, CASE WHEN max(hi) OVER ({p} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo THEN 0 ELSE 1 END AS fresh FROM s{n}),
g{n} AS (SELECT *, sum(fresh) OVER ({p} ORDER BY lo, hi) AS island FROM i{n}),
u{n} AS (SELECT {k} min(lo) AS lo, max(hi) AS hi FROM g{n} GROUP BY {k} island)"""
_SPANS = _E + ", sp AS (SELECT user_id, ms AS lo, ms + floor(value * 1000)::BIGINT AS hi, event_type FROM e)"
_PAIRS = _E + """,
x AS (SELECT user_id, event_id AS execution_id, ms - 300000 AS lo, ms + 5000 AS hi FROM e WHERE event_type = 'purchase'),
r AS (SELECT user_id, event_id AS request_id, ms AS at_ FROM e WHERE event_type = 'click'),
pairs AS (SELECT execution_id, request_id FROM x JOIN r ON x.user_id = r.user_id AND at_ BETWEEN lo AND hi)"""
_JOURNAL = _E + """,
b AS (SELECT event_id % 3000 AS execution_id, CASE k % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'rendered' END AS phase, ms, value FROM e),
j AS (SELECT *, md5(ms || '|' || round(value * 1000)::BIGINT) AS digest FROM (SELECT * FROM b UNION ALL SELECT * FROM b WHERE ms % 5 = 0 UNION ALL SELECT execution_id, phase, ms, value + 1 FROM b WHERE ms % 7 = 0))"""
_ATOMS = """WITH a AS (SELECT l_partkey AS source, l_linenumber::BIGINT * 100 AS lo, l_linenumber::BIGINT * 100 + l_quantity::BIGINT * 10 AS hi, l_orderkey AS candidate,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS tier, l_shipdate::DATE AS day FROM lineitem)"""
SQL = {
    "interval_union_length": _SPANS + _UNION.format(n=1, k="user_id,", t="sp", p="PARTITION BY user_id") + " SELECT user_id, sum(hi - lo)::BIGINT AS length FROM u1 GROUP BY user_id",
    "work_vs_elapsed": _SPANS + _UNION.format(n=1, k="user_id,", t="sp", p="PARTITION BY user_id") + _UNION.format(n=2, k="", t="sp", p="") + " SELECT (SELECT sum(hi - lo) FROM u1)::BIGINT AS work_ms, (SELECT sum(hi - lo) FROM u2)::BIGINT AS elapsed_ms",
    "interval_subtract": _SPANS
    + ", a AS (SELECT user_id, lo, hi FROM sp WHERE event_type = 'view'), b AS (SELECT user_id, lo, hi FROM sp WHERE event_type = 'click')"
    + _UNION.format(n=1, k="user_id,", t="a", p="PARTITION BY user_id")
    + _UNION.format(n=2, k="user_id,", t="b", p="PARTITION BY user_id")
    + """, o AS (SELECT u1.user_id, sum(least(u1.hi, u2.hi) - greatest(u1.lo, u2.lo)) AS shared FROM u1 JOIN u2 ON u1.user_id = u2.user_id AND u1.lo < u2.hi AND u2.lo < u1.hi GROUP BY u1.user_id),
la AS (SELECT user_id, sum(hi - lo) AS n FROM u1 GROUP BY user_id), lb AS (SELECT user_id, sum(hi - lo) AS n FROM u2 GROUP BY user_id)
SELECT coalesce(la.user_id, lb.user_id) AS user_id, (coalesce(la.n, 0) - coalesce(shared, 0))::BIGINT AS only_base, coalesce(shared, 0)::BIGINT AS shared, (coalesce(lb.n, 0) - coalesce(shared, 0))::BIGINT AS only_other
FROM la FULL JOIN lb ON la.user_id = lb.user_id LEFT JOIN o ON o.user_id = coalesce(la.user_id, lb.user_id)""",
    "capped_gap": _E
    + """, g AS (SELECT user_id, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM e),
a AS (SELECT user_id, coalesce(sum(least(gap, 300000)), 0)::BIGINT AS known_ms, count(gap) AS n_gaps, CASE WHEN count(*) < 2 THEN 1 ELSE count(*) FILTER (WHERE gap < 0) END AS n_invalid FROM g GROUP BY user_id)
SELECT *, CASE WHEN n_invalid = 0 THEN known_ms END AS total_ms FROM a""",
    "asof_backward": _E + " SELECT event_id, user_id, click_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM e) WHERE event_type = 'purchase'",
    "asof_forward": _E
    + """, f AS (SELECT event_id, event_type,
  first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS er, first_value(CASE WHEN event_type = 'error' THEN ts END IGNORE NULLS) OVER w AS et,
  first_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS sr, first_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER w AS st
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, CASE WHEN sr IS NULL OR et < st OR (et = st AND er < sr) THEN er END AS error_id, sr AS turn_end_id FROM f WHERE event_type = 'view'""",
    "band_join_reconcile": _PAIRS + " SELECT execution_id, request_id FROM pairs",
    "attribution_classes": _PAIRS
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS rivals FROM pairs),
t AS (SELECT execution_id, count(*) AS c, max(rivals) AS rivals, min(request_id) AS rid FROM n GROUP BY execution_id)
SELECT x.execution_id, CASE WHEN c IS NULL THEN 'unattributed' WHEN c = 1 AND rivals = 1 THEN 'inferred_unique' ELSE 'ambiguous' END AS state, CASE WHEN c = 1 AND rivals = 1 THEN rid END AS request_id
FROM x LEFT JOIN t USING (execution_id)""",
    "request_owners": _PAIRS + " SELECT request_id, count(*) AS n_executions, min(execution_id) AS first_execution, max(execution_id) AS last_execution FROM pairs GROUP BY request_id",
    "orphan_anti": _PAIRS + " SELECT request_id AS event_id FROM r WHERE request_id NOT IN (SELECT request_id FROM pairs)",
    "call_result_pairing": _E + " SELECT user_id, k, c.call_id, r.result_id FROM (SELECT user_id, k, min(event_id) AS call_id FROM e WHERE event_type = 'click' GROUP BY user_id, k HAVING count(*) = 1) c JOIN (SELECT user_id, k, min(event_id) AS result_id FROM e WHERE event_type = 'error' GROUP BY user_id, k HAVING count(*) = 1) r USING (user_id, k)",
    "journal_dedupe": _JOURNAL + " SELECT execution_id, phase, min(digest) AS digest, min(digest) <> max(digest) AS conflict FROM j GROUP BY execution_id, phase",
    "phase_fold": _JOURNAL
    + """, f AS (SELECT execution_id, arg_min(ms, digest) FILTER (WHERE phase = 'started') AS started_ms, arg_min(ms, digest) FILTER (WHERE phase = 'completed') AS completed_ms, arg_min(ms, digest) FILTER (WHERE phase = 'rendered') AS rendered_ms FROM j GROUP BY execution_id)
SELECT *, CASE WHEN completed_ms >= started_ms THEN completed_ms - started_ms END AS elapsed_ms FROM f""",
    "live_counters": _E + " SELECT CASE WHEN event_type = 'view' THEN 'show' WHEN event_type IN ('click', 'signup') THEN 'search' ELSE 'note' END AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, user_id % 2 AS transport, count(*) AS n, sum(k)::BIGINT AS k FROM e GROUP BY ALL",
    "latency_histogram": _E + ", u AS (SELECT event_type, floor(value * 1000) AS us FROM e) " + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (WHERE us <= {b}) AS n FROM u GROUP BY event_type" for b in BOUNDS_US) + " UNION ALL SELECT event_type, '+Inf', count(us) FROM u GROUP BY event_type",
    "rolling_windows": _E + ", m AS (SELECT max(ms) AS now_ FROM e) SELECT span, event_type, count(*) AS n, round(sum(value), 3) AS total FROM e, m, (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('lifetime', 100000)) w(span, days) WHERE now_ - ms <= days * 86400000::BIGINT GROUP BY span, event_type",
    "seal_days": _E + " SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(k) AS known, count(*) - count(k) AS missing, sum(k)::BIGINT AS k, CASE WHEN ts::DATE + 8 <= (SELECT max(ts::DATE) FROM e) THEN 'sealed' ELSE 'provisional' END AS state FROM e GROUP BY ts::DATE",
    "null_aware_sum": _E + ", b AS (SELECT event_type, CASE WHEN k % 4 <> 0 THEN k END AS bytes, CASE WHEN k = 0 THEN 'zero' WHEN k % 4 = 0 THEN 'withheld' END AS why FROM e) SELECT event_type, coalesce(sum(bytes), 0)::BIGINT AS known, count(bytes) AS n_known, count(*) - count(bytes) AS n_missing, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons, CASE WHEN count(*) = count(bytes) THEN sum(bytes)::BIGINT END AS total FROM b GROUP BY event_type",
    "summarize_observations": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("view", "click", "purchase", "signup", "error")) + ", max(ts) AS latest FROM events GROUP BY user_id",
    "enum_counts": "SELECT t.event_type, count(e.event_id) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund')) t(event_type) LEFT JOIN events e USING (event_type) GROUP BY t.event_type",
    "usage_normalization": _E
    + """, f AS (SELECT user_id, ts, max(k) AS k, max(event_id) AS event_id FROM e GROUP BY user_id, ts),
r AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM f),
p AS (SELECT *, lag(era) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_era FROM r)
SELECT user_id, sum(CASE WHEN prev IS NULL OR prev_era <> era OR k < prev THEN k ELSE k - prev END)::BIGINT AS used, count(*) FILTER (WHERE k < prev) AS n_resets, max(era)::BIGINT AS n_zero FROM p GROUP BY user_id""",
    "distinct_consecutive": "SELECT user_id, count(*) AS n_changes, max(event_id) AS last_change FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type GROUP BY user_id",
    "tariff_range_join": """WITH t AS (SELECT 'Brand#1' || i AS brand, DATE '1992-01-01' AS f, DATE '1995-01-01' AS u, 100 + i AS price FROM range(1, 6) r(i) UNION ALL SELECT 'Brand#1' || i, DATE '1995-01-01', NULL, 200 + i FROM range(1, 6) r(i) UNION ALL SELECT 'Brand#2' || i, DATE '1994-06-01', NULL, 300 + i FROM range(1, 6) r(i)),
l AS (SELECT p_brand AS brand, l_shipdate::DATE AS day, sum(l_quantity::BIGINT) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT l.brand, sum(q)::BIGINT AS quantity, CASE WHEN count(price) = count(*) THEN sum(q * price)::BIGINT END AS cost, count(*) - count(price) AS unpriced_days FROM l LEFT JOIN t ON l.brand = t.brand AND day >= f AND (u IS NULL OR day < u) GROUP BY l.brand""",
    "tariff_overlap_check": """WITH t AS (SELECT 'Brand#1' || i AS brand, DATE '1992-01-01' AS day_from, DATE '1995-01-01' AS u, 100 + i AS price FROM range(1, 6) r(i) UNION ALL SELECT 'Brand#1' || i, DATE '1995-01-01', NULL, 200 + i FROM range(1, 6) r(i) UNION ALL SELECT 'Brand#2' || i, DATE '1994-06-01', NULL, 300 + i FROM range(1, 6) r(i) UNION ALL SELECT 'Brand#11', DATE '1994-12-01', DATE '1995-02-01', 9)
SELECT a.brand, a.day_from::VARCHAR AS day_from, a.price FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.brand = a.brand AND (b.day_from, b.price) < (a.day_from, a.price) AND coalesce(b.u, DATE '9999-12-31') > a.day_from)""",
    "scenario_credit_nested": _ATOMS
    + "".join(f", a{i} AS (SELECT source, lo, hi FROM a WHERE tier <= {i})" + _UNION.format(n=i, k="source,", t=f"a{i}", p="PARTITION BY source") for i in range(3))
    + " UNION ALL ".join(f" SELECT '{n}' AS scenario, sum(hi - lo)::BIGINT AS chars, (sum(hi - lo) // 4)::BIGINT AS tokens FROM u{i}" for i, n in enumerate(("conservative", "central", "optimistic"))),
    "first_claim_credit": _ATOMS
    + """, c AS (SELECT source, unnest(range(lo, hi, 10)) AS x, tier, day, candidate FROM a),
o AS (SELECT source, x, arg_min(candidate, (tier, day, candidate)) AS candidate FROM c GROUP BY source, x)
SELECT candidate, (count(*) * 10)::BIGINT AS length FROM o GROUP BY candidate""",
    "rollup_bounds": "SELECT o_orderpriority, raw, floor(raw::DECIMAL(18,0) / 7000)::BIGINT AS low, ceil(raw::DECIMAL(18,0) / 7000)::BIGINT AS high FROM (SELECT o_orderpriority, sum(round(o_totalprice * 100)::BIGINT - 15000000)::BIGINT AS raw FROM orders GROUP BY o_orderpriority)",
    "debit_dedupe": _E + " SELECT event_id % 2000 AS debit_id, CASE WHEN min(k % 2) = max(k % 2) THEN min(k % 2) END AS amount, min(k % 2) <> max(k % 2) AS conflict FROM e GROUP BY event_id % 2000",
    "group_by_dimension": " UNION ALL ".join(f"SELECT '{n}' AS dimension, {c} AS member, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY {c}" for n, c in (("priority", "o_orderpriority"), ("status", "o_orderstatus"), ("year", "year(o_orderdate)::VARCHAR"), ("all", "'all'"))),
    "cursor_page": "SELECT o_orderkey, cents, position, substr(sha256('orders|' || position), 1, 12) AS cursor FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, row_number() OVER (ORDER BY round(o_totalprice * 100)::BIGINT DESC, o_orderkey) AS position FROM orders) WHERE position > 100 AND position <= 150",
    "novelty_anti_join": _E + " SELECT arg_min(event_id, (ts, event_id)) AS event_id, user_id, k FROM e GROUP BY user_id, k",
    "later_show_semi": _E + " SELECT event_id, user_id, k FROM e c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e v WHERE v.event_type = 'view' AND v.user_id = c.user_id AND v.k = c.k AND v.event_id > c.event_id)",
    "exposure_day": _E + ", g AS (SELECT *, CASE WHEN k % 2 = 0 THEN ts::DATE END AS good FROM e) SELECT event_id, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(good IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::VARCHAR AS day FROM g",
    "retention_split": _E + " SELECT (SELECT max(ms) FROM e) - ms <= 14 * 86400000 AS kept, count(*) AS n, min(ts) AS first, max(ts) AS last FROM e GROUP BY 1",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "openmetrics_lines": "SELECT '# TYPE lookups counter' AS line UNION ALL SELECT 'lookups_total{operation=\"' || operation || '\",outcome=\"' || outcome || '\",transport=\"' || transport || '\"} ' || n FROM (" + _E + " SELECT CASE WHEN event_type = 'view' THEN 'show' WHEN event_type IN ('click', 'signup') THEN 'search' ELSE 'note' END AS operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, user_id % 2 AS transport, count(*) AS n FROM e GROUP BY ALL)",
}
QUERIES = {
    f.__name__: f
    for f in (interval_union_length, work_vs_elapsed, interval_subtract, capped_gap, asof_backward, asof_forward, band_join_reconcile, attribution_classes, request_owners, call_result_pairing, journal_dedupe, phase_fold, live_counters, latency_histogram, rolling_windows, seal_days, null_aware_sum, summarize_observations, enum_counts, usage_normalization, distinct_consecutive, tariff_range_join, tariff_overlap_check, scenario_credit_nested, first_claim_credit, rollup_bounds, debit_dedupe, group_by_dimension, cursor_page, novelty_anti_join, later_show_semi, orphan_anti, exposure_day, retention_split, percentiles, openmetrics_lines)
}
