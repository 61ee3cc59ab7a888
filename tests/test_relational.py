import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import evaluation, intervals, lexical, tables
from skein.operators.components import components
from skein.operators.ordered import exact_percentiles, last_before, next_after, ranks, running_sum
from tests.util import rows


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ties = {}
    for item, tie in pairs:
        if item is None:
            continue
        find(item)
        if tie is not None:
            other = ties.setdefault(tie, item)
            a, b = sorted((find(item), find(other)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"i{r.randrange(80):02d}", r.choice([None, "hot", *(f"t{k}" for k in range(60))]) if r.random() < 0.9 else None) for _ in range(120)]
    pairs += [(f"c{k:02d}", f"x{k}") for k in range(40)] + [(f"c{k + 1:02d}", f"x{k}") for k in range(40)] + [(None, "hot")]
    df = spark.createDataFrame(pairs, "item string, tie string")
    assert {x["item"]: x["component"] for x in components(df).collect()} == union_find(pairs)
    assert components(df.limit(0)).count() == 0


def test_ordered(spark):
    r = random.Random(4)
    data = [(r.choice("ab"), i, r.choice([None, 1, 2, 3])) for i in range(60)]
    df = spark.createDataFrame(data, "k string, at bigint, v bigint")
    bucket = F.call_function("div", F.col("at"), F.lit(7))
    out = last_before(df, "k", ["at"], {"prev": F.col("v")}, bucket)
    out = next_after(out, "k", ["at"], {"next": F.col("v")}, bucket)
    out = {x["at"]: x for x in running_sum(out, "k", ["at"], F.coalesce("v", F.lit(0)), "total", bucket).collect()}
    for k, at, v in data:
        before = [x for kk, a, x in data if kk == k and a < at and x is not None]
        after = [x for kk, a, x in data if kk == k and a > at and x is not None]
        assert out[at]["prev"] == (before[-1] if before else None)
        assert out[at]["next"] == (after[0] if after else None)
        assert out[at]["total"] == sum(before) + (v or 0)


def test_intervals(spark):
    r = random.Random(5)
    a = [(r.choice("xy"), s, s + r.randrange(-2, 30)) for s in (r.randrange(-50, 100) for _ in range(40))] + [("x", None, 5), ("x", 5, None)]
    b = [(r.choice("xyz"), s, s + r.randrange(0, 20)) for s in (r.randrange(-50, 100) for _ in range(30))]
    A, B = (spark.createDataFrame(t, "k string, lo bigint, hi bigint") for t in (a, b))

    def cover(t, k):
        return {p for kk, lo, hi in t if kk == k and lo is not None and hi is not None for p in range(lo, hi)}

    assert {x["k"]: x["length"] for x in intervals.union_length(A, ["k"], 13).collect()} == {k: len(cover(a, k)) for k in "xy"}
    got = {x["k"]: (x["only_base"], x["shared"], x["only_other"]) for x in intervals.lengths(A, B, ["k"], 13).collect()}
    assert got == {k: (len(cover(a, k) - cover(b, k)), len(cover(a, k) & cover(b, k)), len(cover(b, k) - cover(a, k))) for k in "xyz"}
    claims = A.withColumn("who", F.pmod(F.hash("lo", "hi"), F.lit(5)))
    owner = {}
    for x in claims.collect():
        if x["lo"] is not None and x["hi"] is not None:
            for p in range(x["lo"], x["hi"]):
                owner[x["k"], p] = min(owner.get((x["k"], p), 99), x["who"])
    want = {}
    for (k, _), w in owner.items():
        want[k, w] = want.get((k, w), 0) + 1
    assert {(x["k"], x["who"]): x["length"] for x in intervals.first_claims(claims, ["k"], 13, ["who"]).collect()} == want
    points = B.select("k", F.col("lo").alias("at"))
    pairs = intervals.band_join(points, A, ["k"], 7).count()
    assert pairs == sum(k == kk and lo is not None and hi is not None and lo <= s <= hi for kk, s, _ in b for k, lo, hi in a)
    assert intervals.union_length(A.limit(0), ["k"], 13).count() == 0


def test_table_rewrites(spark):
    c = spark.createDataFrame([(1, 1, "a", False), (1, 1, "a", False), (1, 2, "b", False), (1, 2, "c", False), (2, 1, "x", False), (2, 3, None, True), (3, 1, None, False)], "key int, revision int, value string, is_delete boolean")
    assert rows(tables.apply_changes(c, "key")) == [(1, 1, "a", False, 1), (2, 3, None, True, 0), (3, 1, None, False, 0)]
    base = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, n int")
    assert rows(tables.delete_where(base, F.col("n") > 6)) == [(1, None), (2, 5)]
    assert rows(tables.update_where(base, F.col("n") > 6, {"n": F.lit(0)})) == [(1, None), (2, 5), (3, 0)]
    assert rows(tables.upsert(base, spark.createDataFrame([(2,), (4,)], "id int"), ["id"], {"n": 7})) == [(1, None), (2, 7), (3, 9), (4, 7)]
    now = F.lit("2025-01-31").cast("timestamp_ntz")
    ages = spark.createDataFrame([("2025-01-01",), (None,)], "d string").select(F.col("d").cast("timestamp_ntz").alias("d"))
    assert [r[0] for r in ages.select(tables.older_than(F.col("d"), 10, now)).collect()] == [True, False]
    assert [r[0] for r in ages.select(tables.older_than(F.col("d"), 0, now)).collect()] == [True, True]


def test_metrics_golden(spark):
    qrels = spark.createDataFrame([("perfect", "a", 2), ("perfect", "b", 1), ("tie", "a", 1), ("missed", "z", 1), ("zero", "q", 0)], "query_id string, id string, grade int")
    run = spark.createDataFrame([("perfect", "a", 2.0), ("perfect", "b", 1.0), ("tie", "b", 1.0), ("tie", "a", 1.0), ("missed", "y", 1.0), ("zero", "q", 3.0)], "query_id string, id string, score double")
    queries = spark.createDataFrame([(x,) for x in ("perfect", "tie", "missed", "zero", "absent")], "query_id string")
    m = {r["query_id"]: r for r in evaluation.per_query(run, qrels, queries).collect()}
    assert m["perfect"]["ndcg_5"] == pytest.approx(1) and m["perfect"]["r_10"] == 1 and m["perfect"]["p_5"] == pytest.approx(0.4)
    assert m["tie"]["rr_10"] == 1 and m["missed"]["rr_10"] == 0 and m["missed"]["r_100"] == 0
    assert m["zero"]["ndcg_10"] is None and m["zero"]["p_5"] == 0 and m["absent"]["rr_50"] is None
    s = {r["slice"]: r for r in evaluation.by_slice(evaluation.per_query(run, qrels, queries), queries.select("query_id", F.lit("all").alias("slice"))).collect()}
    assert s["overall"]["ndcg_5"] == pytest.approx(2 / 3) and s["overall"]["p_5"] == pytest.approx((0.4 + 0.2) / 5)


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, None), (3, ""), (4, "alpha")], "id bigint, text string")
    q = spark.createDataFrame([(1, "beta beta Alpha zz"), (2, ""), (3, None)], "query_id bigint, query string")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.bm25(docs, q).collect()}
    assert set(got) == {(1, 1), (1, 4)} and got[1, 1] > got[1, 4]
    assert lexical.bm25(docs.limit(0), q).count() == 0


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_percentiles(spark, accuracy):
    # With little accuracy the sketch's brackets are wide of the mark, the result is the same.
    r = random.Random(7)
    data = [("hot", float(r.choice([r.randrange(40), r.gauss(0, 9)]))) for _ in range(3000)] + [("few", 2.0), ("few", 5.0), ("one", 3.0), (None, 1.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "top": 1.0}
    got = {x["k"]: [x[n] for n in shares] for x in exact_percentiles(df, "k", "v", shares, accuracy).collect()}
    want = {k: np.percentile([v for a, v in data if a == k], [100 * p for p in shares.values()]).tolist() for k in ("hot", "few", "one", None)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert exact_percentiles(df.limit(0), "k", "v", shares).count() == 0


def test_ranks_over_ranges(spark):
    r = random.Random(9)
    data = [(r.choice(["hot", "hot", "a", None]), r.randrange(6), i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, score bigint, id bigint")
    got = {x["id"]: x["rank_no"] for x in ranks(df, "k", [F.col("score").desc(), F.col("id")]).collect()}
    want = {}
    for k in {a for a, _, _ in data}:
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((-s, i) for a, s, i in data if a == k))}
    assert got == want and ranks(df.limit(0), "k", [F.col("id")]).count() == 0
