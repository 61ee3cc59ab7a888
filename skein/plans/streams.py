"""Streaming queries over events, each to the end of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.streaming.operators import file_stream, late_revisions, once_only, run_to_end, upsert_stream


def _events(spark: SparkSession, d: str) -> DataFrame:
    return file_stream(spark, f"{d}/events.parquet")


def stream_rolling_counts(spark, d):
    """Events by day and type, kept in a table that every micro-batch updates."""
    def merge(previous, batch):
        fresh = batch.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        both = fresh if previous is None else fresh.unionByName(previous)
        return both.groupBy("day", "event_type").agg(F.sum("n").alias("n"))

    return upsert_stream(_events(spark, d), merge)


def stream_dedupe(spark, d):
    """Events of which each comes twice, counted once."""
    e = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_to_end(once_only(e, "ts", ["event_id"]).select("event_id", "user_id", "event_type"))


def stream_late_revision(spark, d):
    """Events accepted up to eleven days late: what comes after the day was sealed makes further revisions."""
    e = _events(spark, d).select(F.to_date("ts").alias("day"), F.date_add(F.to_date("ts"), (F.col("event_id") % 12).cast("int")).alias("accepted"))
    out = late_revisions(e, "day", "accepted")
    w = Window.partitionBy("day").orderBy("point")
    return out.select(F.col("day").cast("string").alias("day"), F.row_number().over(w).cast("bigint").alias("revision"), F.sum("added").over(w).alias("n"))


QUERIES = {f.__name__: f for f in (stream_rolling_counts, stream_dedupe, stream_late_revision)}
SQL = {
    "stream_rolling_counts": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT event_id, user_id, event_type FROM events",
    "stream_late_revision": """WITH p AS (SELECT ts::DATE AS day, CASE WHEN event_id % 12 < 8 THEN 0 ELSE event_id % 12 END AS point, count(*) AS added FROM events GROUP BY ALL)
SELECT day::VARCHAR AS day, row_number() OVER (PARTITION BY day ORDER BY point) AS revision, sum(added) OVER (PARTITION BY day ORDER BY point)::BIGINT AS n FROM p""",
}
