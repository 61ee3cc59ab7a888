"""Streaming counterparts: rolling counts, once-only counting, late revisions and bounded catch-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import delete_path, fresh_path


def run_to_end(stream: DataFrame, mode: str = "append", max_batches_path: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return the table it wrote; the sink and its checkpoint lie in the shared folder."""
    spark = stream.sparkSession
    base = max_batches_path or fresh_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def file_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the rows of a parquet table, a folder or one file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path if whole else f"{path[:-1]}[{path[-1]}]")


def versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the complete versions under `base`, rising."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(base)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(fs_path(base))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(fs_path(f"{base}/{n}/_SUCCESS")))


def upsert_stream(stream: DataFrame, merge, base: str | None = None) -> DataFrame:
    """foreachBatch into versioned tables: `merge(previous or None, batch)` gives the next version, named by its batch, so a
    repeated batch does no harm. Which version is the last is read from the folder `base`, beside the checkpoint, so that
    a restarted stream goes on from it. Returns the last version; older ones than the two last are removed."""
    spark = stream.sparkSession
    base = base or fresh_path(spark, "versions")

    def step(batch: DataFrame, number: int) -> None:
        done = versions(spark, base)
        if done and done[-1] >= number:
            return
        previous = spark.read.parquet(f"{base}/v{done[-1]}") if done else None
        merge(previous, batch).write.mode("overwrite").parquet(f"{base}/v{number}")
        for old in done[:-1]:
            delete_path(spark, f"{base}/v{old}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/v{versions(spark, base)[-1]}")


def rolling_counts(events: DataFrame, ts: str, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts by tumbling window and key, final once the watermark has passed the window."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    out = timed.groupBy(F.window("_ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n")


def once_only(events: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first of repeated rows within the delay."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(keys).drop("_ts")


def late_revisions(stream: DataFrame, day: str, accepted: str, provisional_days: int = 8) -> DataFrame:
    """(day, revision, n): rows accepted before the day is sealed are its revision 1, each later day of acceptance makes one
    more. Nothing is dropped for being late."""
    offset = F.datediff(accepted, day)

    def merge(previous, batch):
        fresh = batch.select(F.col(day).alias("day"), F.when(offset < provisional_days, 0).otherwise(offset).cast("bigint").alias("point"))
        fresh = fresh.groupBy("day", "point").agg(F.count(F.lit(1)).alias("added"))
        if previous is not None:
            fresh = fresh.unionByName(previous)
        return fresh.groupBy("day", "point").agg(F.sum("added").alias("added"))

    return upsert_stream(stream, merge)
