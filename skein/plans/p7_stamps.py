"""Problem 7: stamps of codex, pi and opencode as moments in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.timestamps import PLAIN_UTC, StampDictionary, normalize, with_zone
from skein.session import allow_duplicate_keys, materialize, parse_line, shared_dir, table


def stamp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(runtime, row_key, raw, host) of every stamp; null stamps and lines that are not JSON are left out."""
    allow_duplicate_keys(spark)
    codex = table(spark, sf_dir, "codex_records").select(F.lit("codex").alias("runtime"), F.col("rec_id").cast("string").alias("row_key"), F.col("rec_timestamp").alias("raw"), "host")
    pi = table(spark, sf_dir, "pi_records").select("rec_id", "host", parse_line(F.col("record")).alias("v"))
    stamp = F.try_variant_get("v", "$.timestamp", "variant")
    simple = F.schema_of_variant(stamp).rlike("^(STRING|BIGINT|DECIMAL)")
    number = F.try_variant_get(stamp, "$", "decimal(38,9)").cast("string")
    raw = F.when(simple, F.try_variant_get(stamp, "$", "string")).otherwise(F.when(F.schema_of_variant(stamp) == "DOUBLE", number))
    pi = pi.select(F.lit("pi").alias("runtime"), F.col("rec_id").cast("string").alias("row_key"), raw.alias("raw"), "host")
    oc = table(spark, sf_dir, "oc_session").select(F.lit("opencode").alias("runtime"), F.col("id").alias("row_key"), F.col("time_created").alias("raw"), "host")
    return codex.unionByName(pi).unionByName(oc).where(F.col("raw").isNotNull())


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary is kept from run to run: spark.skein.stamps.dir, else a fixed place in the shared folder. Its rows depend
    on raw text and zone alone, so that tables may share it; the name changes when the rules of parsing do."""
    return f"{spark.conf.get('spark.skein.stamps.dir', None) or shared_dir(spark)}/skein-stamps-v1"


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(with_zone(stamp_rows(spark, sf_dir), table(spark, sf_dir, "host_zones")), "stamps")
    dictionary = StampDictionary(spark, dictionary_path(spark))
    return normalize(rows, dictionary.extend(rows.select("raw", "zone")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps that denote a moment and aren't already plain UTC seconds."""
    rows = normalized(spark, sf_dir).where(F.col("epoch_ms").isNotNull() & ~F.col("raw").rlike(PLAIN_UTC))
    return rows.select("runtime", "row_key", "epoch_ms").distinct()


def p7_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp with its moment, null where it denotes none."""
    return normalized(spark, sf_dir).select("runtime", "row_key", "raw", "zone", "epoch_ms", F.timestamp_millis("epoch_ms").cast("timestamp_ntz").alias("moment"))


QUERIES = {"p7_found": p7_found, "p7_moments": p7_moments}
SQL: dict[str, str] = {}
