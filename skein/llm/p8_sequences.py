"""Problem 8: documents in training sequences of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.packing import CAPACITY, pack, token_counts
from skein.session import table


def p8_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, tokens, the least number of sequences there could be, and the share of room that is used."""
    loads = p8_sequences(spark, sf_dir).groupBy("sequence_id").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("load").alias("n_tokens"), F.ceil(F.sum("load") / CAPACITY).alias("least"), F.max("load").alias("largest"), (F.sum("load") / F.count(F.lit(1)) / CAPACITY).alias("fill"))


QUERIES = {"p8_sequences": p8_sequences, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
