"""Connected components of a bipartite membership table by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skein.session import drop_table, materialize

#: A tie gets a salt for each so many of its items, so that no task joins more of one.
ITEMS_A_SALT = 1 << 16
#: Times a round replaces each parent by its parent's parent: a hooked chain shrinks by four to this power.
JUMPS = 2


def _least_of_tie(edges: DataFrame) -> DataFrame:
    """edges(item, tie) with `low`, the smallest item of the tie. A tie of a third of all rows is spread over salts."""
    low = edges.groupBy("tie").agg(F.min("item").alias("low"), F.max("item").alias("high"), F.count(F.lit(1)).alias("_n")).where("low < high")
    low = low.withColumn("_salts", F.call_function("div", F.col("_n"), F.lit(ITEMS_A_SALT)) + 1)
    wide = low.select("tie", "low", "_salts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("_salt"))
    # How many salts a tie has is the same at every one of them; hot ties alone have more than one.
    hot = F.broadcast(low.where("_salts > 1").select("tie", F.col("_salts").alias("_hot")))
    salted = edges.join(hot, "tie", "left").withColumn("_salt", F.pmod(F.xxhash64("item"), F.coalesce("_hot", F.lit(1).cast("bigint"))))
    return salted.join(wide, ["tie", "_salt"]).select("item", "tie", "low")


def _jumped(parents: DataFrame) -> DataFrame:
    up = parents.select(F.col("item").alias("parent"), F.col("parent").alias("_next"))
    return parents.join(up, "parent", "left").select("item", F.coalesce("_next", "parent").alias("parent"))


def components(members: DataFrame) -> DataFrame:
    """(item, component) of members(item, tie): items that share a tie, directly or through others, are one component,
    named by its smallest item. Rows with a null item are left out; a null tie ties nothing.

    A round hooks every item onto the smallest item among its ties, shortcuts the parent table by doubling, and carries
    the ties over to the parents, where ties of a single item disappear. A parent needn't be a root yet: it keeps the ties
    that hooked it, and is hooked again in the next round. Parents are smaller than their children, so there are no
    circles; the table of ties shrinks with every round. A round writes its parents and its ties, and nothing else
    runs; it is the last when no item hooks.
    """
    items = members.where(F.col("item").isNotNull()).select("item").distinct()
    edges = materialize(members.where(F.col("item").isNotNull() & F.col("tie").isNotNull()).select("item", "tie").distinct(), "ties")
    maps: list[DataFrame] = []
    while True:
        hooked = _least_of_tie(edges).groupBy("item").agg(F.min("low").alias("parent")).where("parent < item")
        told = Observation()
        parents = materialize(hooked.observe(told, F.count(F.lit(1)).alias("n")), "parents")
        if not told.get["n"]:
            break
        flat = parents
        for _ in range(JUMPS):
            flat = _jumped(flat)
        flat = materialize(flat, "parents")
        drop_table(parents)
        maps.append(flat)
        after = materialize(edges.join(flat, "item", "left").select(F.coalesce("parent", "item").alias("item"), "tie").distinct(), "ties")
        drop_table(edges)
        edges = after
    out = items.withColumn("component", F.col("item"))
    for parents in maps:
        out = out.join(parents.select(F.col("item").alias("component"), F.col("parent").alias("_up")), "component", "left").select("item", F.coalesce("_up", "component").alias("component"))
    return out
