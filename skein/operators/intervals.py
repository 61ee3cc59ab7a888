"""Half-open integer intervals: unions, differences, intersections and gaps, cut into buckets so that no key is one task.

An interval that spans buckets is cut at their borders, which changes no length. Null, empty and reversed intervals
count for nothing.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clipped(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """rows(keys, lo, hi) with one row for each bucket of `width` an interval touches."""
    held = rows.where("lo < hi")
    low = F.call_function("div", F.col("lo") - F.pmod(F.col("lo"), F.lit(width)), F.lit(width))
    high = F.call_function("div", F.col("hi") - 1 - F.pmod(F.col("hi") - 1, F.lit(width)), F.lit(width))
    parts = held.select("*", F.explode(F.sequence(low, high)).alias("_bucket"))
    return parts.withColumn("lo", F.greatest("lo", F.col("_bucket") * width)).withColumn("hi", F.least("hi", (F.col("_bucket") + 1) * width))


def merged(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The disjoint stretches (keys, lo, hi) that rows(keys, lo, hi) cover, cut at bucket borders."""
    parts = clipped(rows.select(*keys, "lo", "hi"), keys, width).distinct()
    order = Window.partitionBy(*keys, "_bucket").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = parts.withColumn("_new", F.when(reach >= F.col("lo"), 0).otherwise(1))
    numbered = numbered.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_bucket", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_bucket", "_island")


def union_length(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, length) covered by rows(keys, lo, hi)."""
    parts = merged(rows, keys, width)
    return parts.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("length"))


def segments(base: DataFrame, other: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, lo, hi, in_base, in_other) of the stretches between the borders of two tables of intervals(keys, lo, hi)."""
    a = clipped(base.select(*keys, "lo", "hi"), keys, width).select(*keys, "_bucket", "lo", "hi", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = clipped(other.select(*keys, "lo", "hi"), keys, width).select(*keys, "_bucket", "lo", "hi", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = a.unionByName(b)
    borders = both.select(*keys, "_bucket", F.col("lo").alias("at"), "a", "b").unionByName(both.select(*keys, "_bucket", F.col("hi").alias("at"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    steps = borders.groupBy(*keys, "_bucket", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*keys, "_bucket").orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*keys, F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), (F.sum("a").over(run) > 0).alias("in_base"), (F.sum("b").over(run) > 0).alias("in_other"))
    return swept.where(F.col("hi").isNotNull())


def lengths(base: DataFrame, other: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, only_base, shared, only_other) of two tables of intervals."""
    size = F.col("hi") - F.col("lo")
    return segments(base, other, keys, width).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("in_base") & ~F.col("in_other"), size)), F.lit(0)).alias("only_base"),
        F.coalesce(F.sum(F.when(F.col("in_base") & F.col("in_other"), size)), F.lit(0)).alias("shared"),
        F.coalesce(F.sum(F.when(~F.col("in_base") & F.col("in_other"), size)), F.lit(0)).alias("only_other"),
    )


def _sweep(keys: list[str], claim: list[str]):
    """Lengths by claim inside one bucket: borders in order, a heap of the claims that are open."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.astype(object).where(group.notna(), None)
        claims = list(zip(*(group[c] for c in claim)))
        ranks = [tuple((v is not None, v) for v in c) for c in claims]  # nulls come first, as in structs
        order = {c: n for n, c in enumerate(sorted(set(ranks)))}
        numbers = [order[c] for c in ranks]
        names = {n: c for n, c in zip(numbers, claims)}
        starts = sorted(zip(group["lo"], group["hi"], numbers))
        held: list[tuple[int, int]] = []
        length: dict[int, int] = {}
        at, k = None, 0
        while k < len(starts) or held:
            while held and at is not None and held[0][1] <= at:
                heapq.heappop(held)
            if not held:
                if k == len(starts):
                    break
                at = starts[k][0]
            while k < len(starts) and starts[k][0] <= at:
                heapq.heappush(held, (starts[k][2], starts[k][1]))
                k += 1
            owner, end = held[0]
            if end <= at:
                continue
            upto = end if k == len(starts) else min(end, starts[k][0])
            length[owner] = length.get(owner, 0) + upto - at
            at = upto
        out = pd.DataFrame([names[n] for n in length], columns=claim)
        for c in keys:
            out[c] = group[c].iloc[0]
        return out.assign(length=list(length.values()))[[*keys, *claim, "length"]]

    return run


def first_claims(rows: DataFrame, keys: list[str], width: int, claim: list[str]) -> DataFrame:
    """(keys, claim, length): each stretch covered by rows(keys, lo, hi, claim) counts once, for the smallest claim on it.

    A sweep over the borders of each bucket, so that intervals and stretches are never paired.
    """
    parts = clipped(rows.select(*keys, *claim, "lo", "hi"), keys, width)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, *claim]) + ", length bigint"
    told = parts.groupBy(*keys, "_bucket").applyInPandas(_drop_bucket(_sweep(keys, claim)), schema)
    return told.groupBy(*keys, *claim).agg(F.sum("length").alias("length"))


def _drop_bucket(run):
    return lambda group: run(group.drop(columns="_bucket"))


def band_join(points: DataFrame, bands: DataFrame, on: list[str], width: int, at: str = "at", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of points(on, at) and bands(on, lo, hi) with lo <= at <= hi.

    A band is repeated for each bucket of `width` it touches, a point lies in one; the buckets make the join an equality
    join, so no pair outside a bucket is looked at. Bands of null or reversed ends match nothing.
    """
    wide = bands.where(F.col(lo) <= F.col(hi))

    def number(c):
        return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))

    wide = wide.withColumn("_band", F.explode(F.sequence(number(F.col(lo)), number(F.col(hi)))))
    narrow = points.withColumn("_band", number(F.col(at)))
    return narrow.join(wide, [*on, "_band"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_band")
