"""Ordered analytics that don't put a whole key into one task.

A key's rows are cut into buckets of the order column; windows run inside (key, bucket), and one summary row a bucket
carries what came before. A key of a third of all rows is thereby spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize

DAY_S = 86_400


def time_bucket(ts: Column, seconds: int = DAY_S) -> Column:
    """The number of the stretch of `seconds` a timestamp (with or without zone) lies in."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.call_function("div", micros - F.pmod(micros, F.lit(seconds * 1_000_000)), F.lit(seconds * 1_000_000))


def _inside(key: str, order: list[str]):
    return Window.partitionBy(key, "_bucket").orderBy(*order)


def last_before(df: DataFrame, key: str, order: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """`df` with, for each name of `values`, the last non-null of that expression in earlier rows of the same key."""
    rows = df.withColumn("_bucket", time_bucket(F.col(order[0])) if bucket is None else bucket)
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    before = _inside(key, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(before) for n in values})
    position = F.struct(*order)
    ends = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}") for n in values])
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({f"_c_{n}": F.last(f"_e_{n}", ignorenulls=True).over(earlier) for n in values}).drop(*[f"_e_{n}" for n in values])
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    joined = joined.withColumns({n: F.coalesce(n, f"_c_{n}") for n in values})
    return joined.drop("_bucket", "_key", "_at", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def next_after(df: DataFrame, key: str, order: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """`df` with, for each name of `values`, the first non-null of that expression in later rows of the same key."""
    rows = df.withColumn("_bucket", time_bucket(F.col(order[0])) if bucket is None else bucket)
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    after = _inside(key, order).rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({n: F.first(f"_v_{n}", ignorenulls=True).over(after) for n in values})
    position = F.struct(*order)
    starts = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(*[F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}") for n in values])
    later = Window.partitionBy("_key").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    carried = starts.withColumns({f"_c_{n}": F.first(f"_e_{n}", ignorenulls=True).over(later) for n in values}).drop(*[f"_e_{n}" for n in values])
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    joined = joined.withColumns({n: F.coalesce(n, f"_c_{n}") for n in values})
    return joined.drop("_bucket", "_key", "_at", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """`df` with the sum of `value` over the rows of the key up to and with each row."""
    rows = df.withColumn("_bucket", time_bucket(F.col(order[0])) if bucket is None else bucket).withColumn("_v", value)
    rows = rows.withColumn(name, F.sum("_v").over(_inside(key, order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.sum("_v").alias("_t"))
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_c", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    joined = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)) + F.col("_c")).drop("_bucket", "_key", "_at", "_v", "_c")


def exact_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(key, one column for each share): percentiles of the non-null values of each key, exact, linear between ranks.

    A sketch brackets each percentile; rows below a bracket are counted, and only the distinct values inside it are ordered
    (about a 1,000th of a key's rows for each share, fewer where values repeat). A key of a third of all rows is no single
    task's set of values.
    """
    held = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    slack = 4.0 / accuracy
    ends = [x for p in shares.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    told = held.groupBy("_key").agg(F.percentile_approx("_v", [float(x) for x in ends], accuracy).alias("_ends"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = F.col("_n") <= accuracy  # a place more or less is more than the slack: all values are inside
    brackets = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.lit(p).alias("share"),
            F.when(few | F.lit(p <= slack), F.col("_least")).otherwise(F.col("_ends")[2 * i]).alias("low"),
            F.when(few | F.lit(p + slack >= 1), F.col("_most")).otherwise(F.col("_ends")[2 * i + 1]).alias("high"),
        )
        for i, (name, p) in enumerate(shares.items())
    ])
    wanted = told.select("_key", "_n", brackets.alias("_b"))
    rows = held.join(wanted.withColumnRenamed("_key", "_k2"), F.col("_key").eqNullSafe(F.col("_k2"))).drop("_k2")
    placed = rows.select("_key", "_n", "_v", F.explode("_b").alias("b")).select("_key", "_n", "b.name", "b.share", "b.low", F.when(F.col("_v") >= F.col("b.low"), F.col("_v")).alias("_v"), (F.col("_v") > F.col("b.high")).alias("_above"))
    placed = placed.where(~F.col("_above"))
    counts = placed.groupBy("_key", "_n", "name", "share", "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy("_key", "name").orderBy(F.col("_v").asc_nulls_first())
    upto = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("share") * (F.col("_n") - 1)
    first = lambda r: F.min(F.when((F.col("_upto") > r) & F.col("_v").isNotNull(), F.col("_v")))
    ends = upto.groupBy("_key", "name").agg(first(F.floor(rank)).alias("_a"), first(F.ceil(rank)).alias("_b"), F.first(rank - F.floor(rank)).alias("_f"))
    each = ends.select("_key", "name", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("_p"))
    return each.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("_p"))).alias(n) for n in shares])


def ranks(df: DataFrame, by: str, order: list[Column], name: str = "rank_no") -> DataFrame:
    """`df` with the exact number from 1 of each row within `by`, in the given order (which should leave no ties).

    Rows are range-partitioned by key and order, so that a key of a third of all rows is many partitions; they are numbered
    inside those, and how many the partitions before hold of a key is added. Null keys are a key of their own.
    """
    ranged = df.repartitionByRange(F.col(by), *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(ranged, "ranks")
    sizes = rows.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_by", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    joined = rows.withColumn("_inside", inside).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_range", "_inside", "_by", "_at", "_before")
