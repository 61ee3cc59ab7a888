"""Splits that keep related records together: tied groups go whole, the totals come as close to the shares as they can."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.components import components
from skein.session import materialize

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


#: Bits of one bitset of totals: groups beyond it are placed before, the largest first.
MAX_BITS = 1 << 23
#: Nearest totals of one split that are tried together with those of the next.
TRIED = 8


def _steps(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(size, groups) with multiplicities split into powers of two and a rest, so that all counts can be put together."""
    out = []
    for size, count in sorted(sizes.items(), reverse=True):
        take = 1
        while count > 0:
            k = min(take, count)
            out.append((size, k))
            count -= k
            take *= 2
    return out


class Totals:
    """The totals up to `limit` that some of the groups reach, as one bitset after every step.

    Only every root-th bitset is kept; those between are made again when a choice is traced back, so that memory
    is twice the root of the steps times `limit` bits.
    """

    def __init__(self, sizes: dict[int, int], limit: int):
        self.steps, self.mask = _steps(sizes), (1 << (limit + 1)) - 1
        self.every = max(1, math.isqrt(len(self.steps)))
        bits, self.kept = 1, []
        for n, (size, k) in enumerate(self.steps):
            if n % self.every == 0:
                self.kept.append(bits)
            bits = self._after(bits, size, k)
        self.bits = bits

    def _after(self, bits: int, size: int, k: int) -> int:
        return bits | ((bits << (size * k)) & self.mask)

    def nearest(self, target: int, n: int) -> list[int]:
        """Up to `n` reachable totals, the closest to `target` first, of equals the smaller."""
        low, high = self.bits & ((1 << (target + 1)) - 1), self.bits >> (target + 1)
        below, above, base = [], [], target + 1
        while low and len(below) < n:
            at = low.bit_length() - 1
            below.append(at)
            low ^= 1 << at
        while high and len(above) < n:
            at = (high & -high).bit_length() - 1
            above.append(base + at)
            high >>= at + 1
            base += at + 1
        return sorted(below + above, key=lambda t: (abs(t - target), t))[:n]

    def trace(self, total: int) -> dict[int, int]:
        """{size: number of groups} that make up a reachable total."""
        out: dict[int, int] = {}
        for block in range(len(self.kept) - 1, -1, -1):
            part = self.steps[block * self.every : (block + 1) * self.every]
            before = [self.kept[block]]
            for size, k in part[:-1]:
                before.append(self._after(before[-1], size, k))
            for bits, (size, k) in zip(reversed(before), reversed(part)):
                if not (bits >> total) & 1:
                    out[size] = out.get(size, 0) + k
                    total -= size * k
        return out


def pick(sizes: dict[int, int], target: int) -> dict[int, int]:
    """{size: number of groups} whose total is as close to `target` as any, of equals the smaller total."""
    total = sum(s * c for s, c in sizes.items())
    totals = Totals(sizes, min(total, 2 * target + 1))
    return totals.trace(totals.nearest(target, 1)[0])


def _joint(sizes: dict[int, int], targets: list[int]) -> tuple[int, list[dict[int, int]]]:
    """(deviation, picks) for the splits but the last: of the nearest totals of the first, the one with which the others come closest."""
    if not targets:
        return 0, []
    total = sum(s * c for s, c in sizes.items())
    totals = Totals(sizes, min(total, 2 * targets[0] + 1))
    best = None
    for t in totals.nearest(targets[0], TRIED if len(targets) > 1 else 1):
        if best and abs(t - targets[0]) >= best[0]:
            break
        mine = totals.trace(t)
        off, rest = _joint({s: c - mine.get(s, 0) for s, c in sizes.items()}, targets[1:])
        if best is None or off + abs(t - targets[0]) < best[0]:
            best = off + abs(t - targets[0]), [mine, *rest]
    return best


def plan_split(sizes: dict[int, int], shares: dict[str, float], max_bits: int = MAX_BITS) -> dict[int, list[tuple[str, int]]]:
    """For each size, (split, number of groups) in order; the largest share takes what the others leave.

    The smallest groups, up to a total of `max_bits` items, are left to the bitsets. Larger ones are placed first, the largest
    size first: each split takes as many groups of a size as fit under its target, so that what is still missing is
    below a group of that size for each, and the small groups fill it up.
    """
    total = sum(s * c for s, c in sizes.items())
    left, plan = dict(sizes), {s: [] for s in sizes}
    order = sorted(shares, key=lambda k: (shares[k], k))
    missing = {name: round(shares[name] / sum(shares.values()) * total) for name in order[:-1]}
    fine, kept = {}, 0
    for size in sorted(sizes):
        take = min(sizes[size], (max_bits - kept) // size) if total > max_bits else sizes[size]
        fine[size], kept = take, kept + take * size
    for size in sorted(sizes, reverse=True):
        rough = sizes[size] - fine[size]
        whole = sum(missing.values()) or 1
        for name in sorted(missing, key=lambda k: -missing[k]) if rough else ():
            # No split takes more of the rough groups than its part of what all still miss leaves to the others.
            count = min(rough, missing[name] // size, -(-(sizes[size] - fine[size]) * missing[name] // max(whole, 1)))
            if count:
                plan[size].append((name, count))
                missing[name] -= count * size
                rough -= count
                left[size] -= count
        if rough:
            plan[size].append((order[-1], rough))
            left[size] -= rough
    for name, mine in zip(missing, _joint(fine, list(missing.values()))[1]):
        for size, count in mine.items():
            plan[size].append((name, count))
            left[size] -= count
    for size, count in left.items():
        if count:
            plan[size].append((order[-1], count))
    return plan


def ranked_within(df: DataFrame, key: str, by: str, name: str = "rank_no", rows_a_bucket: int = 1 << 16) -> DataFrame:
    """`df` with a dense number from 0 within `key`, in the order of a hash of `by` (unique within the key), then `by`.

    A key of a third of all rows is no single task's work: rows are numbered inside hash buckets of about `rows_a_bucket`, and
    the sizes of the buckets before are added.
    """
    buckets = max(1, -(-df.count() // rows_a_bucket))
    df = materialize(df.withColumn("_rank_bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")), "ranks")
    sizes = df.groupBy(F.col(key).alias("_rank_key"), F.col("_rank_bucket").alias("_rank_at")).agg(F.count(F.lit(1)).alias("_rank_n"))
    earlier = Window.partitionBy("_rank_key").orderBy("_rank_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0))).drop("_rank_n")
    inside = F.row_number().over(Window.partitionBy(key, "_rank_bucket").orderBy(F.xxhash64(by), by)) - 1
    joined = df.withColumn("_rank_in", inside).join(starts, F.col(key).eqNullSafe(F.col("_rank_key")) & (F.col("_rank_bucket") == F.col("_rank_at")))
    return joined.withColumn(name, (F.col("_rank_before") + F.col("_rank_in")).cast("bigint")).drop("_rank_key", "_rank_before", "_rank_in", "_rank_bucket", "_rank_at")


def grouped_split(members: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(item, component, group_size, split) of members(item, tie).

    Components come from hooking and shortcutting; the driver sees only how many groups there are of each size (at
    most the root of twice the number of items), and chooses how many of each size go where by subset-sum bitsets.
    Which groups of a size those are follows from a rank by hash, so a new run gives the same split. A group larger
    than a split's share goes to the split whose total it brings closest. Empty tables give an empty result.
    """
    shares = shares or SHARES
    comp = materialize(components(members), "components")
    groups = comp.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    sizes = {r["group_size"]: r["n"] for r in groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_split(sizes, shares) if sizes else {}
    spans = []
    for size, parts in plan.items():
        at = 0
        for name, count in parts:
            spans.append((size, at, at + count, name))
            at += count
    spark = members.sparkSession
    table = spark.createDataFrame(spans, "_size bigint, _from bigint, _to bigint, split string")
    ranked = ranked_within(groups, "group_size", "component")
    placed = ranked.join(table, (F.col("group_size") == F.col("_size")) & (F.col("rank_no") >= F.col("_from")) & (F.col("rank_no") < F.col("_to")))
    return comp.join(placed.select("component", "group_size", "split"), "component").select("item", "component", "group_size", "split")
