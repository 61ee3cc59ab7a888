"""Graded retrieval metrics as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NDCG_AT, RR_AT, P_AT, R_AT = (5, 10), (10, 50), (5, 10), (10, 50, 100)


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics of each query of queries(query_id) from run(query_id, id, score) and qrels(query_id, id, grade).

    Ranks go by score falling, then id. Queries without a relevant document have null nDCG, RR and recall.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    depth = max(*NDCG_AT, *RR_AT, *P_AT, *R_AT)
    ranked = run.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= depth)
    hits = ranked.join(qrels.where("grade > 0"), ["query_id", "id"])
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_r") + 1.0)
    got = hits.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("_r") <= k, gain)).alias(f"_dcg{k}") for k in NDCG_AT],
        F.min("_r").alias("_first"),
        *[F.count_if(F.col("_r") <= k).alias(f"_hit{k}") for k in sorted({*P_AT, *R_AT})],
    )
    most = _ideal(qrels)
    rows = queries.select("query_id").distinct().join(most, "query_id", "left").join(got, "query_id", "left")
    some, zero = F.col("n_relevant").isNotNull(), F.lit(0.0)
    return rows.select(
        "query_id",
        *[F.when(some, F.coalesce(F.col(f"_dcg{k}"), zero) / F.col(f"_ideal{k}")).alias(f"ndcg_{k}") for k in NDCG_AT],
        *[F.when(some, F.when(F.col("_first") <= k, 1.0 / F.col("_first")).otherwise(zero)).alias(f"rr_{k}") for k in RR_AT],
        *[(F.coalesce(F.col(f"_hit{k}"), F.lit(0)) / float(k)).alias(f"p_{k}") for k in P_AT],
        *[F.when(some, F.coalesce(F.col(f"_hit{k}"), F.lit(0)) / F.col("n_relevant")).alias(f"r_{k}") for k in R_AT],
    )


def _ideal(qrels: DataFrame) -> DataFrame:
    """(query_id, n_relevant, ideal gains): how many documents each grade has is all that the best order depends on."""
    counts = qrels.where("grade > 0").groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("_from", F.coalesce(above, F.lit(0)))

    def upto(k: int):
        # The places of a grade's documents among the first k.
        at = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda r: (r > F.col("_from")) & (r <= F.col("_from") + F.col("_n")))
        worth = F.aggregate(at, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + F.lit(1.0)))
        return F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) * worth).alias(f"_ideal{k}")

    return placed.groupBy("query_id").agg(F.sum("_n").alias("n_relevant"), *[upto(k) for k in NDCG_AT])


def metric_names() -> list[str]:
    return [f"ndcg_{k}" for k in NDCG_AT] + [f"rr_{k}" for k in RR_AT] + [f"p_{k}" for k in P_AT] + [f"r_{k}" for k in R_AT]


def by_slice(metrics: DataFrame, slices: DataFrame) -> DataFrame:
    """Means over slices(query_id, slice) and overall; null metrics leave the mean, zeros stay."""
    named = metrics.join(slices.select("query_id", "slice").distinct(), "query_id").unionByName(metrics.withColumn("slice", F.lit("overall")))
    return named.groupBy("slice").agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(m).alias(m) for m in metric_names()])


def gates(base: DataFrame, candidate: DataFrame, slack: float = 0.01) -> DataFrame:
    """(slice, metric, base, candidate, passed): a metric passes when it isn't more than `slack` below the base."""

    def long(df, name):
        return df.select("slice", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in metric_names()])).alias("m")).select("slice", "m.metric", f"m.{name}")

    return long(base, "base").join(long(candidate, "candidate"), ["slice", "metric"]).withColumn("passed", F.coalesce(F.col("candidate") >= F.col("base") - slack, F.col("base").isNull()))


def extended_run(final: DataFrame, prefetch: DataFrame, limit: int) -> DataFrame:
    """final(query_id, id, rank) first, then what prefetch adds, up to `limit`, scored by the places left."""
    both = final.select("query_id", "id", F.lit(0).alias("_p"), "rank").unionByName(prefetch.select("query_id", "id", F.lit(1).alias("_p"), "rank"))
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("_p", "rank")).alias("_at"))
    w = Window.partitionBy("query_id").orderBy("_at", "id")
    kept = first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return kept.select("query_id", "id", F.col("position").cast("bigint").alias("position"), (F.lit(limit) - F.col("position") + 1).cast("double").alias("score"))


def recall_diagnostics(queries: DataFrame, run: DataFrame, members: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = R_AT) -> DataFrame:
    """Recall of each query of queries(query_id) by episode at each depth and by chunk at the deepest.

    run(query_id, id, rank) holds chunks, members(id, episode) says whose they are, relevant(query_id, episode) what was sought; an
    episode ranks where its first chunk does, and every chunk of a relevant episode is relevant. Null where nothing is relevant.
    """
    deepest = max(depths)
    wanted = relevant.where(F.col("episode").isNotNull()).select("query_id", "episode").distinct()
    placed = run.join(members.select("id", "episode"), "id")
    best = placed.groupBy("query_id", "episode").agg(F.min("rank").alias("_at"))
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_at")))
    got = ranked.join(wanted, ["query_id", "episode"]).groupBy("query_id").agg(*[F.count_if(F.col("_r") <= k).alias(f"_e{k}") for k in depths])
    chunks = placed.where(F.col("rank") <= deepest).join(wanted, ["query_id", "episode"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("_c"))
    sizes = members.groupBy("episode").agg(F.count(F.lit(1)).alias("_n"))
    total = wanted.join(sizes, "episode", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("_episodes"), F.sum("_n").alias("_chunks"))
    rows = queries.select("query_id").distinct().join(total, "query_id", "left").join(got, "query_id", "left").join(chunks, "query_id", "left")

    def share(found: str, of: str):
        return F.when(F.col(of) > 0, F.coalesce(F.col(found), F.lit(0)) / F.col(of))

    return rows.select("query_id", *[share(f"_e{k}", "_episodes").alias(f"r_{k}") for k in depths], share("_c", "_chunks").alias(f"chunk_r_{deepest}"))


def means(metrics: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """(slice, metric, mean, positive_mean) over groups(query_id, slice): nulls are left out of both, zeros of the second."""
    long = metrics.select("query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])).alias("m")).select("query_id", "m.metric", "m.v")
    return long.join(groups.select("query_id", "slice").distinct(), "query_id").groupBy("slice", "metric").agg(F.avg("v").alias("mean"), F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("positive_mean"))
