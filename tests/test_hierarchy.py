import random

import pytest
from pyspark.sql import functions as F

from skein.operators.hierarchy import Peeling, bare_id, descendants, hierarchy, one_parent
from tests.util import rows


def truth(links):
    parent = dict(links)
    out = {}
    for n in set(parent) | {p for p in parent.values() if p}:
        path, at = [n], parent.get(n)
        while at is not None and at not in path:
            path.append(at)
            at = parent.get(at)
        if at is None:
            out[n] = (path[-1], len(path) - 1, "/".join(reversed(path)), None)
        else:
            ring = path[path.index(at) :]
            out[n] = (None, None, None, min(ring))
    return out


def random_links(seed, n=120):
    r = random.Random(seed)
    links = []
    for i in range(n):
        k = r.random()
        links.append((f"n{i:03d}", "hub" if k < 0.35 else f"n{r.randrange(n):03d}" if k < 0.5 else f"n{max(0, i - 1):03d}" if k < 0.9 and i else None))
    return [(a, b) for a, b in links if a != b]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walks(spark, seed):
    links = random_links(seed)
    df = spark.createDataFrame([("t", a, b, None) for a, b in links], "tree string, node string, parent string, at timestamp_ntz")
    out = hierarchy(one_parent(df))
    got = {r["node"]: (r["root"], r["depth"], "/".join(r["path"]) if r["path"] else None, r["cycle_id"]) for r in out.collect()}
    want = truth(links)
    assert got == want
    below = {(a, b) for a in want for b in want if a != b and want[b][2] and f"/{a}/" in f"/{want[b][2]}/"}
    assert {(r["node"], r["descendant"]) for r in descendants(one_parent(df)).collect()} == below
    sizes = {r["node"]: r["n_descendants"] for r in out.collect() if r["depth"] is not None}
    assert sizes == {n: sum(a == n for a, _ in below) for n in sizes}


def test_only_circles(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("s", "s")]
    df = spark.createDataFrame([("t", a, b, None) for a, b in ring], "tree string, node string, parent string, at timestamp_ntz")
    assert {(r["node"], r["cycle_id"]) for r in hierarchy(one_parent(df)).collect()} == {(f"r{i}", "r0") for i in range(7)} | {("s", "s")}


def test_contradictions_nulls_and_empty(spark):
    schema = "tree string, node string, parent string, at timestamp_ntz"
    import datetime as D

    t = [D.datetime(2025, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("t", "a", "old", t[0]), ("t", "a", "new", t[1]), ("t", "a", None, t[2]), ("t", "b", "x", None), ("t", "b", "y", None), ("t", None, "z", t[0]), ("t", "a", "new", t[1])], schema)
    assert rows(one_parent(df), "node", "parent") == sorted([("a", "new"), ("b", "y"), ("old", None), ("new", None), ("x", None), ("y", None)], key=repr)
    assert hierarchy(one_parent(spark.createDataFrame([], schema))).count() == 0


def test_ids(spark):
    df = spark.createDataFrame([(" S00-A ",), ("runs/agent/s00-a.jsonl",), ("C:\\x\\S00-a.JSONL",), ("\t",), (None,), ("dir/",)], "x string")
    assert [r[0] for r in df.select(bare_id(F.col("x"))).collect()] == ["s00-a"] * 3 + [None] * 3


def test_long_chain_and_hub(spark):
    n = 50_000
    chain = spark.range(n).select(F.lit("t").alias("tree"), F.format_string("c%06d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("c%06d", F.col("id") - 1)).alias("parent"))
    hub = spark.range(n // 2).select(F.lit("t").alias("tree"), F.format_string("h%06d", "id").alias("node"), F.lit("c000010").alias("parent"))
    out = hierarchy(chain.unionByName(hub), paths=False)
    deep = out.where("node LIKE 'c%'").select(F.col("depth") == F.substring("node", 2, 6).cast("bigint"), F.col("root") == "c000000", F.col("n_descendants") == n - 1 - F.col("depth") + F.when(F.col("depth") <= 10, n // 2).otherwise(0))
    assert deep.where(" AND ".join(f"`{c}`" for c in deep.columns)).count() == n
    assert out.where("node LIKE 'h%' AND depth = 11 AND n_descendants = 0").count() == n // 2


def test_descendant_lists_in_parts(spark):
    links = [("t", f"k{i:03d}", "top" if i < 60 else f"k{i - 60:03d}", None) for i in range(200)] + [("t", "top", "over", None)]
    nodes = one_parent(spark.createDataFrame(links, "tree string, node string, parent string, at timestamp_ntz"))
    got = Peeling(nodes).descendants(part=7)
    assert got.groupBy("node").count().where("node IN ('top', 'over')").collect()[0]["count"] in (200, 201)
    want = {("top", f"k{i:03d}", 1 + i // 60) for i in range(200)} | {("over", f"k{i:03d}", 2 + i // 60) for i in range(200)} | {("over", "top", 1)}
    want |= {(f"k{i:03d}", f"k{j:03d}", (j - i) // 60) for i in range(200) for j in range(i + 60, 200, 60)}
    assert set(rows(got, "node", "descendant", "distance")) == want and got.count() == len(want)
